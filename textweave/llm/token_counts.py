"""Token counts of byte-level BPE by rank-synchronous merging.

Texts are cut into pre-tokens by the pattern of the vocabulary. The pre-tokens that a worker
has not counted yet lie end to end in one array of symbols; in each round every pre-token finds
its lowest-ranked pair, and all of them merge theirs at once. The symbols that survive are the
count. A pair that a merge makes always ranks after the merge itself, so merging all places of
the lowest pair at once gives what merging them one by one gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.words import CACHED_WORDS, pieces

#: The pattern of byte-level pre-tokens. Fixed value: it comes with the vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Merges:
    """The merges of a vocabulary as sorted arrays, with the counts of pre-tokens seen."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model = given["model"]
        if model["type"] != "BPE" or given["normalizer"] or model["end_of_word_suffix"] or model["ignore_merges"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer and word ends is needed")
        ids = model["vocab"]
        self.first = np.array([ids[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        special = sorted((t["content"] for t in given["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PRE_TOKENS)
        self.counts: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merge_all(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols left of each of the non-empty ``tokens``."""
        none = len(self.keys)
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), counts)
        while True:
            ranks = np.full(len(symbols), none)
            same = owner[1:] == owner[:-1]
            ranks[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(ranks, starts)
            going = np.repeat(lowest < none, np.diff(np.r_[starts, len(symbols)]))
            if not going.any():
                return counts
            best = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
            # Pre-tokens without a pair are done: their counts stand, and they leave the array.
            symbols, owner, ranks, best = symbols[going], owner[going], ranks[going], best[going]
            hit = ranks == best
            # Of overlapping places, as in "aaa", every second one from the left merges.
            run = np.flatnonzero(hit)
            head = np.r_[True, np.diff(run) != 1] if len(run) else np.zeros(0, bool)
            offset = np.arange(len(run)) - np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))
            at = run[offset % 2 == 0]
            symbols[at] = self.merged[best[at]]
            counts -= np.bincount(owner[at], minlength=len(counts))
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and the number of special tokens in it."""
        if self.special is None:
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        found = self.pattern.findall(parts[0])
        for part in parts[1:]:
            found += self.pattern.findall(part)
        return found, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cut = [self.pre_tokens(text) for text in texts]
        wanted = {token for tokens, _ in cut for token in tokens}
        if len(self.counts) > CACHED_WORDS:
            self.counts = {}
        new = [t for t in wanted if t not in self.counts]
        if new:
            self.counts.update(zip(new, self.merge_all([t.encode() for t in new]).tolist(), strict=True))
        look = self.counts.__getitem__
        return [sum(map(look, tokens)) + special for tokens, special in cut]


@lru_cache(maxsize=2)
def loaded(path: str) -> Merges:
    return Merges(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id_column, n_bytes, n_tokens, over_limit)`` of every row, in one pass without a shuffle.

    ``vocabulary`` is the path of a byte-level BPE file that every executor has. Special strings
    inside a text are one token each, as the tokenizers library has it by default; none is added.
    A null text counts as empty: 0 bytes, 0 tokens. Rows given twice are counted twice, a null id
    stays null, an empty table gives an empty result, and other columns are not read. A worker
    holds a few MB of text at a time, or one text where that is longer.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = loaded(vocabulary)
        for batch in batches:
            for piece in pieces(batch):
                numbers = merges.count(piece.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(numbers, pa.int64())], ["id", "n_bytes", "n_tokens"]
                )

    text = F.coalesce(F.col(text_column), F.lit(""))
    given = docs.select(F.col(id_column).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    schema = f"id {dict(docs.dtypes)[id_column]}, n_bytes bigint, n_tokens bigint"
    return given.mapInArrow(counted, schema).select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

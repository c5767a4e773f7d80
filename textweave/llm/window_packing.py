"""Packing of token streams into windows, in order, by dynamic programming.

The documents of an input partition are one stream of tokens. A block of it is cut into windows of
at most ``limit`` tokens: cuts are at ends of documents (free), at ends of sentences (a small
penalty), or, where neither comes for long, in between (a large one). The cost of a window is its
padding, a constant, and the penalty of the cut that ends it.

With ``best[b]`` the least cost up to cut ``b``, a padded window from ``a`` costs
``best[a] + limit - (b - a)``: the least ``best[a] + a`` among the cuts in reach, which a monotone
queue gives in constant time. Windows of exactly 256, 512, ... tokens are not padded; these few
transitions are looked up one by one.

No token is moved between machines: a partition packs what it reads, and at most one window of
each block is short of tokens.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.token_counts import byte_letters
from textweave.llm.words import Cached, pieces

#: Words kept in a worker's memory before those that came in one batch only are given up.
MOST_WORDS = 400_000
#: Pre-tokens kept with their ids; they are needed for new words only.
MOST_PRE_TOKENS = 100_000


@dataclass(frozen=True)
class Settings:
    """Costs are in tokens of padding. ``block`` is how many tokens a worker packs at once, at least."""

    limit: int = 2048
    end_id: int = 1
    window_cost: float = 64.0
    sentence_cut: float = 4.0
    other_cut: float = 48.0
    longest_gap: int = 256
    least_unpadded: int = 256
    block: int = 1 << 18


#: The vocabulary's pattern of pre-tokens. Fixed value: it comes with the vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters alone are the same after normalization, but for capitals. Special
#: tokens have a "<" and are not among them.
PLAIN = re.compile("[!-;=-~\u00a1-\u024f]+")


class Tokens:
    """Token ids of blank-separated words, kept for the words seen.

    Normalizer and pre-tokenizer of the vocabulary never look over ASCII blanks, so the ids of a
    text are those of its words. Words of plain Latin letters are cut into pre-tokens here and given
    to the tokenizer's model one pre-token at a time; all others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pattern = self.tokenizer.model, regex.compile(PRE_TOKENS)
        given = json.loads(self.tokenizer.to_str())
        cut = (given["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        lower = given["normalizer"]["normalizers"][-1] == {"type": "Lowercase"}
        self.known_form = cut == PRE_TOKENS and lower and all("<" in t["content"] for t in given["added_tokens"])
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.pre = Cached(self.model_ids, MOST_PRE_TOKENS)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.stop, self.used = np.zeros(1 << 14, bool), 0
        self.again = np.zeros(1 << 14, bool)

    def keep_frequent(self) -> None:
        """Give up the words that did not come again; all of them where most did."""
        words, old = list(self.place), (self.ids, self.start, self.size, self.stop)
        kept = np.flatnonzero(self.again[: len(words)])
        self.clear()
        if not 0 < len(kept) <= MOST_WORDS // 2:
            return
        ids, start, size, stop = old
        sizes = size[kept]
        ends = np.cumsum(sizes)
        self.ids, self.used = ids[np.repeat(start[kept] - ends + sizes, sizes) + np.arange(ends[-1])], int(ends[-1])
        self.start, self.size, self.stop, self.again = ends - sizes, sizes, stop[kept], np.zeros(len(kept), bool)
        self.place = {words[i]: n for n, i in enumerate(kept.tolist())}

    def model_ids(self, pre_token: str) -> list[int]:
        if not pre_token.isascii():
            pre_token = pre_token.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(pre_token)]

    def word_ids(self, word: bytes) -> list[int]:
        text = word.decode()
        if not (self.known_form and PLAIN.fullmatch(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        text = text.lower()
        if text.isalpha():  # most words are one pre-token, or one and a mark
            return self.pre[text]
        if text[:-1].isalpha() and text[-1] in ",.":
            return self.pre[text[:-1]] + self.pre[text[-1]]
        return [i for token in self.pattern.findall(text) for i in self.pre[token]]

    def add(self, words: list[bytes]) -> None:
        found = list(map(self.word_ids, words))
        n, flat = len(self.place), list(chain.from_iterable(found))
        while n + len(words) > len(self.start):
            self.start, self.size, self.stop, self.again = (np.r_[x, np.zeros_like(x)] for x in (self.start, self.size, self.stop, self.again))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(len(self.ids), 1 << 16), np.uint32)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.stop[n : n + len(words)] = [w.rstrip(b"\"')]").endswith((b".", b"!", b"?")) for w in words]
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        self.used += len(flat)

    def encode(self, texts: pa.Array | list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each binary text its ids, and the places after those that end a sentence.

        Words stay in Arrow; only those that differ become Python objects.
        """
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        split = pc.ascii_split_whitespace(texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()))
        words, counts = split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        given = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at the ends of a text leave empty words
        word_ends = np.r_[0, np.cumsum(given)][np.cumsum(counts)]
        coded = words.filter(pa.array(given)).dictionary_encode()
        different = coded.dictionary.view(texts.type).to_pylist()
        if len(self.place) > MOST_WORDS:
            self.keep_frequent()
        at = np.fromiter(map(self.place.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new):
            at[new] = np.arange(len(new)) + len(self.place)
            self.add([different[i] for i in new.tolist()])
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        bounds = np.r_[0, ends][word_ends].tolist()
        ids = self.ids[np.repeat(self.start[at] - ends + sizes, sizes) + np.arange(bounds[-1] if bounds else 0)]
        stops = ends[self.stop[at]]
        stop_bounds = np.searchsorted(stops, bounds, side="right").tolist()
        begin = stop_begin = 0
        for end, stop_end in zip(bounds, stop_bounds, strict=True):
            yield ids[begin:end], stops[stop_begin:stop_end] - begin
            begin, stop_begin = end, stop_end


@lru_cache(maxsize=2)
def loaded(path: str) -> Tokens:
    return Tokens(path)


def cuts(document_ends: np.ndarray, sentence_ends: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """All places where a stream may be cut, 0 first, and the penalty of each."""
    places = np.unique(np.r_[0, document_ends, sentence_ends])
    gaps = np.diff(places)
    more = np.maximum(0, (gaps - 1) // settings.longest_gap)
    step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
    between = np.repeat(places[:-1], more) + step * settings.longest_gap
    places = np.union1d(places, between)
    penalty = np.full(len(places), settings.other_cut)
    penalty[np.isin(places, sentence_ends)] = settings.sentence_cut
    penalty[np.isin(places, document_ends)] = 0.0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, settings: Settings) -> np.ndarray:
    """The chosen places, first and last included, with the least total cost."""
    limit, at, pen = settings.limit, places.tolist(), penalty.tolist()
    exact = []
    size = settings.least_unpadded
    while size < limit:
        exact.append(size)
        size *= 2
    index = {p: i for i, p in enumerate(at)}
    best, came = [0.0] * len(at), [0] * len(at)
    keys = [0.0] * len(at)
    queue: deque[int] = deque([0])
    keys[0] = best[0] + at[0]
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - limit:
            queue.popleft()
        i = queue[0]
        cost = keys[i] + limit - here
        for size in exact:
            k = index.get(here - size)
            if k is not None and best[k] < cost:
                i, cost = k, best[k]
        best[j] = cost = cost + pen[j] + settings.window_cost
        came[j] = i
        keys[j] = key = cost + here
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    chosen, j = [len(at) - 1], len(at) - 1
    while j:
        j = came[j]
        chosen.append(j)
    return places[chosen[::-1]]


def pack_block(ids: np.ndarray, document_ends: np.ndarray, sentence_ends: np.ndarray, settings: Settings) -> dict[str, np.ndarray]:
    """The pieces of a block in order: document, its start in it, length, sequence, place there, crc32."""
    chosen = best_cuts(*cuts(document_ends, sentence_ends, settings), settings)
    starts = np.union1d(chosen[:-1], np.r_[0, document_ends[:-1]])
    lengths = np.diff(np.r_[starts, document_ends[-1]])
    document = np.searchsorted(document_ends, starts, side="right")
    sequence = np.searchsorted(chosen, starts, side="right") - 1
    data = ids.astype("<u4").tobytes()
    return {
        "document": document,
        "start": starts - np.r_[0, document_ends][document],
        "length": lengths,
        "ids_crc32": np.fromiter((zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)), np.int64, len(starts)),
        "sequence": sequence,
        "offset": starts - chosen[sequence],
        "sequence_length": np.diff(chosen)[sequence],
        "first": starts,
    }


def pack(
    docs: DataFrame, vocabulary: str, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row for each piece: ``id_column, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length``.

    ``vocabulary`` is the path of a tokenizer file that every executor has; each document gets
    ``end_id`` at its end. ``with_ids`` adds the ids of the piece. Every token is in exactly one
    piece; a sequence is contiguous from 0 and has at most ``limit`` tokens.

    A null or empty text is the end id alone. Rows given twice are two documents. Null ids stay
    null. Very long texts are cut like any other. An empty table gives an empty result; other
    columns are not read. A worker holds the tokens of a block and of one document beyond it.
    """
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker have left
        tokens = loaded(vocabulary)
        task = TaskContext.get()
        sequences = (task.partitionId() if task else 0) << 36
        held: list[tuple[object, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences
            sizes = np.array([len(ids) for _, ids, _ in held])
            ends = np.cumsum(sizes)
            ids = np.concatenate([ids for _, ids, _ in held])
            marks = np.concatenate([stops + end - n for (_, _, stops), end, n in zip(held, ends, sizes, strict=True)])
            out = pack_block(ids, ends, marks, settings)
            keys = pa.array([k for k, _, _ in held]).cast(kind).take(pa.array(out["document"]))
            columns = [out["start"], out["length"], out["ids_crc32"], sizes[out["document"]], sequences + out["sequence"], out["offset"], out["sequence_length"]]
            sequences += int(out["sequence"][-1]) + 1
            columns = [keys, *map(pa.array, columns)]
            if with_ids:
                bounds = pa.array(np.r_[out["first"], len(ids)].astype(np.int32))
                columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

        for batch in batches:
            kind = batch.column(0).type
            for piece in pieces(batch):
                for key, (ids, stops) in zip(piece.column(0).to_pylist(), tokens.encode(piece.column(1)), strict=True):
                    held.append((key, np.append(ids, np.uint32(settings.end_id)), stops[stops < len(ids)]))
                    size += len(ids) + 1
                    if size >= settings.block:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    kind_of = dict(docs.dtypes)[id_column]
    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    schema = f"id {kind_of}, " + ", ".join(f"{n} bigint" for n in names[1:]) + ", ids array<int>" * with_ids
    return given.mapInArrow(packed, schema).withColumnRenamed("id", id_column)

"""Removal of repeated word windows by level-wise doubling.

Windows are judged first at a short length. Those that repeat there are alone extended to twice
the length and judged again, and so on up to the wanted length, or until none is left.

At a level below the last one, a window of the wanted length is represented by the smallest hash
of the shorter windows inside it: equal windows have equal representatives, so a window whose
representative occurs once in the corpus cannot repeat. Only a sixth of all places represents a
window. Hashes are counted by partial sums; what comes back to a document is the list of its
hashes that occur once (each occurs in one document), so a passage in a third of all documents is
one row for each task and no key is joined. At the wanted length windows are compared by 95 bits.

The documents are shuffled once, by row key; all levels and the removal read that shuffle again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.words import hashed, mixed, pieces, sliding_min, windows, word_hashes
from textweave.operators.ordering import numbered
from textweave.session import materialise

_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TWICE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class Words:
    """The words of some texts end to end, with the hashes of their windows."""

    def __init__(self, texts: list[bytes | None], hashes, window: int) -> None:
        self.split = [(text or b"").split() for text in texts]
        counts = np.fromiter(map(len, self.split), np.int64, len(texts))
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.words = hashed([w for words in self.split for w in words], hashes)
        #: Text of each place, and whether a window of the wanted length fits in from there.
        self.text = np.repeat(np.arange(len(texts)), counts)
        n = max(0, len(self.words) - window + 1)
        self.fits = np.arange(n) + window <= self.ends[self.text[:n]]

    def levels(self, seed: int, base: int, length: int) -> np.ndarray:
        """Hashes of the windows of ``length`` = ``base`` doubled some times."""
        out = windows(self.words, base, _SEEDS[seed])
        have = base
        while have < length:
            n = max(0, len(out) - have)
            out = mixed(out[:n] * _TWICE[seed] + out[have : have + n])
            have *= 2
        return out

    def representatives(self, base: int, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes at ``length``, the representative of each window, and the places that represent."""
        short = self.levels(0, base, length)
        width = window - length + 1
        least = sliding_min(short, width)[: len(self.fits)]
        chosen = np.zeros(len(short), bool)
        for k in range(width):
            chosen[k : k + len(least)] |= self.fits & (short[k : k + len(least)] == least)
        return short, least, chosen


#: Bits of a place in the corpus that count the words of a document.
START_BITS = 26


def _lists(rows: DataFrame, by: str, name: str) -> DataFrame:
    """One row for each ``by`` with the list of its values. Rows are shuffled before lists are made of them."""
    return rows.repartition(by).groupBy(by).agg(F.collect_list("value").alias(name))


def remove_repeats(
    docs: DataFrame, window: int = 20, base: int = 10, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False
) -> DataFrame:
    """``(id_column, n_words, n_removed, kept_sha256)`` of every row; with ``with_text`` also ``kept_text``.

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a row
    with a smaller id, or earlier in the same row. Windows are judged on the input. ``window`` is
    ``base`` doubled some times. Windows do not reach over the end of a text; texts with fewer words
    than a window lose nothing. A null text has no words.

    Null ids come before all others. Rows with one id and different texts are ordered by a hash of
    both; rows with one id and one text are one document given twice, with equal results. An
    empty table gives an empty result; other columns are not read. A worker holds some MB of text
    at a time, or one text where that is longer; a text has at most 2 ** 26 words.
    """
    levels = [base]
    while levels[-1] * 2 <= window:
        levels.append(levels[-1] * 2)
    if levels[-1] != window:
        raise ValueError("window must be base times a power of two")
    text = F.col(text_column).cast("binary")
    given = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.xxhash64(F.col(id_column), F.coalesce(text, F.lit(b""))).alias("key"), text.alias("text")
    )
    # Documents by number, in the order in which their windows count as earlier.
    ranks = given.groupBy("key").agg(F.min("id").alias("id"))
    ranks = numbered(ranks, [F.col("id").asc_nulls_first(), F.col("key")], "rank").select("key", "rank")
    ranks = materialise(ranks, "ranks")

    def judged(piece: pa.RecordBatch, hashes, upto: int) -> tuple[Words, np.ndarray]:
        """The words of a piece, and the windows that repeat at all levels before ``upto``."""
        words = Words(piece.column(2).to_pylist(), hashes, window)
        alive = words.fits.copy()
        for k, length in enumerate(levels[:upto]):
            if not alive.any():
                break
            once = piece.column(piece.schema.get_field_index(f"once{k}")).flatten().to_numpy().view(np.uint64)
            alive &= ~np.isin(words.representatives(base, length, window)[1], once)
        return words, alive

    def short_windows(level: int):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = word_hashes()
            for batch in batches:
                for piece in pieces(batch):
                    words, alive = judged(piece, hashes, level)
                    words.fits &= alive
                    short, _, chosen = words.representatives(base, levels[level], window)
                    keys = piece.column(1).take(pa.array(words.text[: len(short)][chosen]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(short[chosen].view(np.int64))], ["key", "value"])

        return emit

    def whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for piece in pieces(batch):
                words, alive = judged(piece, hashes, len(levels) - 1)
                at = np.flatnonzero(alive)
                one = words.levels(0, base, window)[at].view(np.int64)
                two = (words.levels(1, base, window)[at] >> np.uint64(33)).astype(np.int32)
                of = words.text[at]
                start = at - words.starts[of]
                if len(start) and start.max() >> START_BITS:
                    raise ValueError(f"a text has more than 2 ** {START_BITS} words")
                rank = piece.column(piece.schema.get_field_index("rank")).to_numpy()
                place = (rank[of] << START_BITS) + start
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (one, two, place))), ["one", "two", "place"])

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for piece in pieces(batch):
                words, alive = judged(piece, hashes, len(levels) - 1)
                stay = piece.column(piece.schema.get_field_index("stay"))
                own = stay.flatten().to_numpy()
                sizes = pc.fill_null(pc.list_value_length(stay), 0).to_numpy(zero_copy_only=False)
                alive[own + np.repeat(words.starts, sizes)] = False
                change = np.zeros(len(words.words) + 1, np.int32)
                at = np.flatnonzero(alive)
                change[at] += 1
                np.subtract.at(change, at + window, 1)
                keep = np.cumsum(change[:-1]) == 0
                kept = [b" ".join(compress(w, keep[s:e].tolist())) for w, s, e in zip(words.split, words.starts, words.ends, strict=True)]
                gone = np.bincount(words.text[~keep], minlength=len(kept))
                columns = [
                    piece.column(0),
                    pa.array([len(w) for w in words.split], pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ]
                if with_text:
                    columns.append(pa.array([k.decode() for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.replace(" bigint", "").replace(" string", "").split(", "))

    schema = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    source = given
    for level in range(len(levels) - 1):
        counted = source.mapInArrow(short_windows(level), "key bigint, value bigint").groupBy("value")
        once = counted.agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n = 1").select("key", "value")
        source = source.join(_lists(once, "key", f"once{level}").hint("merge"), "key", "left").select(*_first(source), f"once{level}")
    ranked = source.join(ranks.hint("merge"), "key")
    first = (
        ranked.select(*_first(source), "rank")
        .mapInArrow(whole_windows, "one bigint, two int, place bigint")
        .groupBy("one", "two")
        .agg(F.min("place").alias("place"))
        .select(F.shiftright("place", START_BITS).alias("rank"), F.col("place").bitwiseAND((1 << START_BITS) - 1).cast("int").alias("value"))
    )
    stay = _lists(first, "rank", "stay").join(ranks.hint("merge"), "rank").select("key", "stay")
    judged_docs = source.join(stay.hint("merge"), "key", "left").select(*_first(source), "stay")
    return judged_docs.mapInArrow(removed, schema).withColumnRenamed("id", id_column)


def _first(source: DataFrame) -> list[str]:
    """The columns with id, key and text first, as the tasks take them by place."""
    return ["id", "key", "text", *[c for c in source.columns if c not in ("id", "key", "text")]]

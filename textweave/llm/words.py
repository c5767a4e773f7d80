"""Words of UTF-8 texts and hashes of word runs, for use inside tasks.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return: what ``bytes.split()`` gives.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

#: Distinct words kept in a worker's memory before the table is started anew.
CACHED_WORDS = 200_000
#: Bytes of text that a worker turns into arrays at once.
SLICE_BYTES = 4 << 20

_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Cached(dict):
    """A dictionary that computes what is missing and starts anew when it is full."""

    def __init__(self, compute: Callable, limit: int = CACHED_WORDS) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key: Hashable):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def word_hashes(seed: int = 0) -> Cached:
    """64-bit hashes of words, kept for the words seen."""
    return Cached(lambda word: xxhash.xxh64_intdigest(word, seed))


def hashed(words: Sequence, hashes: Cached) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of each number over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Hash of the ``length`` numbers from each place on; the places near the end have none."""
    n = max(0, len(words) - length + 1)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = total * np.uint64(factor) + words[k : k + n]
    return mixed(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours from each place on."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def slices(sizes: Sequence[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``limit`` bytes, or one row where that alone is longer."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def array_pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """An array of texts in slices of a bounded size."""
    for start, end in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        yield texts.slice(start, end - start)


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have a bounded size."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for start, end in slices(sizes):
        yield batch.slice(start, end - start)

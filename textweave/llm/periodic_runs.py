"""Periodic runs of words, found by recompression.

A run is a stretch of words with smallest period ``q`` that cannot be extended with this period. If
it is at least ``max(least, 3 * q)`` words long, it holds that many less ``q`` neighbouring places
whose word equals that ``q`` later, so it holds such a place on the grid of this width. All grid
places of all periods are about ``n log n`` for a text of ``n`` words; those whose words agree are
extended exactly in both directions by the run-length grammar of the text (``recompression``).

A multiple of the smallest period finds the same stretch; the least period of each stretch stays.
Texts of a few megabytes share one grammar, with a symbol of its own between each two. There is no
shuffle; a text takes about 150 bytes a word in the worker that has it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.recompression import extensions, grammar
from textweave.llm.words import pieces, unused

#: Grid places that are extended at once.
BATCH = 1 << 18


def grid(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods where a run may be. Strings begin at ``starts``, the longest first."""
    ends = starts + sizes
    longest = int(sizes[0]) if len(sizes) else 0
    found, periods, n = [], [], 0
    for q in range(1, longest // 3 + 1):
        length = max(least, 3 * q)
        if length > longest:
            break
        upto = int(ends[np.searchsorted(-sizes, -length, side="right") - 1])
        width = length - q
        at = np.flatnonzero(symbols[: upto - q : width] == symbols[q:upto:width])
        if len(at):
            found.append(at * width)
            periods.append(np.full(len(at), q))
            n += len(at)
        if n >= BATCH:
            yield np.concatenate(found), np.concatenate(periods)
            found, periods, n = [], [], 0
    if n:
        yield np.concatenate(found), np.concatenate(periods)


def runs(strings: list[np.ndarray], least: int = 24) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each string of numbers, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in strings]
    order = sorted((i for i, s in enumerate(strings) if len(s) >= least), key=lambda i: -len(strings[i]))
    if not order:
        return out
    names = max(int(strings[i].max()) for i in order) + 1
    sizes = np.array([len(strings[i]) for i in order])
    starts = np.cumsum(sizes + 1) - sizes
    symbols = np.empty(int(starts[-1] + sizes[-1]) + 1, np.int32)
    between = np.append(starts - 1, len(symbols) - 1)
    symbols[between] = names + np.arange(len(between))
    for k, i in enumerate(order):
        symbols[starts[k] : starts[k] + sizes[k]] = strings[i]
    single = np.zeros(len(symbols), bool)
    single[between] = True

    levels = None
    found = np.zeros((0, 3), np.int64)
    for at, q in grid(symbols, starts, sizes, least):
        levels = levels or grammar(symbols, single)
        for k in range(0, len(at), BATCH):
            i, period = at[k : k + BATCH], q[k : k + BATCH]
            forward = extensions(levels, i, i + period, 1)
            back = extensions(levels, i, i + period, -1) - 1  # the place itself agrees
            begin, end = i - back, i + period + forward
            long = end - begin >= np.maximum(least, 3 * period)
            found = np.unique(np.vstack([found, np.stack([begin[long], end[long], period[long]], axis=1)]), axis=0)
    if len(found):
        firsts = np.ones(len(found), bool)
        firsts[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[firsts]
        owner = np.searchsorted(starts, found[:, 0], side="right") - 1
        rows = np.stack([found[:, 0] - starts[owner], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
        for k, row in zip(owner.tolist(), rows.tolist(), strict=True):
            out[order[k]].append(tuple(row))
    return [sorted(each, key=lambda r: (r[0], r[2])) for each in out]


def greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exponent, exactly; of equal ones the first."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def numbered(texts: list[list]) -> list[np.ndarray]:
    """Words as numbers, the same for the same word."""
    names: dict = {}
    return [np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words)) for words in texts]


def tail_repeated(key: int | None, n: int) -> np.ndarray | None:
    """For one id in ten, the number of the word that each word of a text becomes: its tail repeats a stretch."""
    if key is None or n == 0:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % period)


def find_runs(
    docs: DataFrame,
    least: int = 24,
    id_column: str = "doc_id",
    text_column: str = "text",
    prepare: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: ``id_column, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed``.

    ``runs`` lists ``start,length,period`` in lines, by start, then period; ``collapsed`` is the text
    without the words that a run holds after its first period, one space between words. The four
    numbers are those of the run with the greatest exponent, null without runs. ``prepare`` may give
    for an id and a number of words the place of the word that stands at each place; null leaves the
    text as it is.

    Null, empty and blank texts have no words and no runs. Rows given twice come twice; the same is
    true of rows with a null id. An empty table gives an empty result; other columns are not read.
    """
    key = unused(docs.select(text_column), "id")
    numbers = ("n_words", "n_runs", "start", "length", "period", "exponent_milli")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = [(text or b"").split() for text in piece.column(1).to_pylist()]
                strings = numbered(texts)
                if prepare:
                    for i, each in enumerate(piece.column(0).to_pylist()):
                        places = prepare(each, len(texts[i]))
                        if places is not None:
                            strings[i] = strings[i][places]
                            texts[i] = [texts[i][p] for p in places.tolist()]
                rows = []
                for words, each in zip(texts, runs(strings, least), strict=True):
                    best = greatest(each)
                    exponent = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    rows.append((len(words), len(each), *exponent, "".join(f"{s},{n},{q}\n" for s, n, q in each), b" ".join(kept_words(words, each))))
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:6]]
                columns += [pa.array([r[6] for r in rows], pa.string()), pa.array([r[7] for r in rows], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns], [key, *numbers, "runs", "collapsed"])

    given = docs.select(F.col(id_column).alias(key), F.col(text_column).cast("binary").alias("text"))
    schema = ", ".join([f"`{key}` {dict(docs.dtypes)[id_column]}", *(f"{n} bigint" for n in numbers), "runs string", "collapsed string"])
    return given.mapInArrow(found, schema).withColumnRenamed(key, id_column)

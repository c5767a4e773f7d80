"""Recompression of integer strings: a run-length grammar and longest common extensions over it.

A string becomes its grammar in rounds. A round first replaces each maximal block of one symbol by
a new symbol (block compression), then, with the symbols split into left and right ones, each left
symbol and the right symbol after it by a new one (pair compression). Equal substrings are replaced
alike but for a few symbols at their ends, and a round shortens a string by a quarter on average, so
there are about ``log n`` rounds (Jeż, "Recompression: a simple and powerful technique for word
equations", 2016; I, "Longest common extensions with recompression", 2017).

A longest common extension climbs the rounds as long as the symbols on both sides agree, and goes
down again from the first that differ; it takes a few steps a round, and many extensions are
answered at once. Names are given by sorting what they stand for, so nothing rests on hash values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ALL = (1 << 64) - 1


@dataclass
class Level:
    """``symbols`` of one level; ``first`` is the place of the first symbol in the next level's symbol ``up``.

    ``first`` has one more entry, the end. A level without ``up`` is the last. ``blocks`` tells how
    the next level was formed.
    """

    symbols: np.ndarray
    up: np.ndarray | None = None
    first: np.ndarray | None = None
    blocks: bool = False


def _names(keys: np.ndarray, after: int) -> np.ndarray:
    return (np.unique(keys, return_inverse=True)[1] + after).astype(np.int32)


def _join(level: Level, starts: np.ndarray, keys: np.ndarray, at: np.ndarray, next_name: int) -> tuple[Level, int]:
    """The next level, whose symbols begin at ``starts`` and which renames those numbered ``at`` by ``keys``."""
    level.first = np.append(np.flatnonzero(starts), len(level.symbols)).astype(np.int32)
    level.up = (np.cumsum(starts) - 1).astype(np.int32)
    symbols = level.symbols[level.first[:-1]]
    new = _names(keys, next_name)
    symbols[at] = new
    return Level(symbols), next_name + (int(new.max()) - next_name + 1 if len(new) else 0)


def grammar(symbols: np.ndarray, single: np.ndarray) -> list[Level]:
    """Levels of the grammar of ``symbols``, numbers from 0 on.

    ``single`` marks symbols that never join others, such as those between two strings; each of
    them must occur once, and one of them must end the string. They keep their names.
    """
    levels = [Level(symbols.astype(np.int32))]
    fixed = np.zeros(int(symbols.max()) + 1, bool)
    fixed[symbols[single]] = True
    name, limit, turn = len(fixed), len(fixed), 0
    while True:
        # Block compression.
        level = levels[-1]
        s = level.symbols
        starts = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=starts[1:])
        if not starts.all():
            level.blocks = True
            ends = np.append(np.flatnonzero(starts), len(s))
            lengths = np.diff(ends)
            at = np.flatnonzero(lengths > 1)
            keys = s[ends[:-1][at]].astype(np.int64) * (len(symbols) + 1) + lengths[at]
            level, name = _join(level, starts, keys, at, name)
            levels.append(level)
            s = level.symbols
        free = np.ones(len(s), bool)
        low = s < limit
        free[low] = ~fixed[s[low]]
        if not (free[1:] & free[:-1]).any():
            return levels
        # Pair compression, with sides drawn anew until some pair is formed.
        while True:
            turn += 1
            side = ((s.astype(np.uint64) + np.uint64(turn * int(_FIRST) & _ALL)) * _SECOND) >> np.uint64(40)
            left = (((side * _FIRST) >> np.uint64(61)) & np.uint64(1)).astype(bool)
            pair = left[:-1] & ~left[1:] & free[:-1] & free[1:]
            if pair.any():
                break
        starts = np.ones(len(s), bool)
        starts[1:] = ~pair
        places = np.flatnonzero(pair)
        keys = s[places].astype(np.int64) * name + s[places + 1]
        at = (np.cumsum(starts) - 1)[places]
        following, name = _join(level, starts, keys, at, name)
        levels.append(following)


def _climb(levels: list[Level], a: np.ndarray, b: np.ndarray, step: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By level, the extensions that meet a difference there: their numbers and the places of the symbols."""
    met, live = [], np.arange(len(a))
    for level in levels:
        s = level.symbols
        if level.up is None:
            # The last level has no two neighbours that could join: a few steps at most.
            while True:
                same = s[a] == s[b]
                if not same.any():
                    break
                a, b = np.where(same, a + step, a), np.where(same, b + step, b)
            met.append((live, a, b))
            break
        edge_a, edge_b = (level.first[level.up[x] + (step < 0)] - (step < 0) for x in (a, b))
        inside = (a != edge_a) | (b != edge_b)  # not at the near end of its parent
        differ = inside & (s[a] != s[b])
        moved = inside & ~differ
        if moved.any():
            # What is left of the parent, from this side on.
            rest_a, rest_b = (np.abs(level.first[level.up[x[moved]] + (step > 0)] - (step < 0) - x[moved]) for x in (a, b))
            n = np.minimum(rest_a, rest_b)
            a, b = a.copy(), b.copy()
            if level.blocks:
                short = rest_a != rest_b
            else:
                n, short = np.ones_like(n), np.zeros(len(n), bool)
            a[moved] += step * n
            b[moved] += step * n
            differ[np.flatnonzero(moved)[short]] = True
        met.append((live[differ], a[differ], b[differ]))
        go = ~differ
        live, a, b = live[go], level.up[a[go]], level.up[b[go]]
    return met


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
    """How many symbols agree from places ``a`` and ``b`` on, to the right or, with ``step = -1``, to the left.

    ``a`` and ``b`` differ everywhere. A place that is itself the last or first of the string may
    be given; to the left the string must begin with a single symbol.
    """
    met = _climb(levels, a.astype(np.int64), b.astype(np.int64), step)
    live, x, y = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        if depth < len(met):
            more, more_x, more_y = met[depth]
        else:
            more = more_x = more_y = np.zeros(0, np.int64)
        if depth < len(levels) - 1 and len(live):
            # From two symbols that differ to the symbols they stand for.
            ends_x, ends_y = level.first[x + 1], level.first[y + 1]
            begin_x, begin_y = level.first[x], level.first[y]
            n = np.minimum(ends_x - begin_x, ends_y - begin_y)
            x, y = (begin_x, begin_y) if step > 0 else (ends_x - 1, ends_y - 1)
            same = level.symbols[x] == level.symbols[y]
            if not level.blocks:
                n = np.ones_like(n)
            n = np.where(same, n, 0)
            x, y = x + step * n, y + step * n
        live, x, y = np.append(live, more), np.append(x, more_x), np.append(y, more_y)
    out = np.empty(len(a), np.int64)
    out[live] = np.abs(x - a[live])
    return out

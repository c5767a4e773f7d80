"""Extensions and runs against plain comparison of all places and periods."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frames import odd
from textweave.llm import periodic_runs
from textweave.llm.recompression import extensions, grammar
from textweave.llm.registered import op12_periodic_runs
from textweave.llm.tables import load

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=24):
    """All maximal stretches of every period, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i + q - start >= max(least, 3 * q):
                    found.setdefault((start, i + q), q)
                start = i + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


strings = st.one_of(
    st.lists(st.integers(0, 2), max_size=120),
    st.builds(lambda a, p, k, b: a + p * k + b, *[st.lists(st.integers(0, 3), max_size=9)] * 2, st.integers(0, 40), st.lists(st.integers(0, 3), max_size=9)),
    st.builds(lambda p, i, v: [v if k == i else x for k, x in enumerate(p * 30)], st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(0, 150), st.integers(0, 2)),
)


@settings(max_examples=250, deadline=None)
@given(st.lists(strings, max_size=6))
def test_runs_are_those_of_plain_comparison(many):
    assert periodic_runs.runs([np.array(s, np.int32) for s in many]) == [plain_runs(s) for s in many]


@settings(max_examples=150, deadline=None)
@given(strings, st.integers(0, 10_000))
def test_extensions_are_exact_in_both_directions(string, seed):
    body = np.array([9, *string, 8, *string, 7])
    levels = grammar(body, np.isin(body, [7, 8, 9]))
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, len(body) - 1, (2, 40))
    a, b = a[a != b], b[a != b]
    for step in (1, -1):
        for i, j, n in zip(a, b, extensions(levels, a, b, step), strict=True):
            assert all(body[i + step * k] == body[j + step * k] for k in range(n))
            assert body[i + step * n] != body[j + step * n]


def test_long_periodic_texts_take_time_in_proportion():
    n = 400_000
    block = np.arange(50_000)
    texts = [np.zeros(n, np.int32), np.tile(np.arange(3), n // 3), np.tile(block, 8)]
    assert periodic_runs.runs(texts) == [[(0, n, 1)], [(0, n // 3 * 3, 3)], [(0, n, 50_000)]]


def test_query_against_plain_comparison(spark):
    found = {r["doc_id"]: r for r in op12_periodic_runs(spark, SF).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    seen = 0
    for doc_id, text in load(spark, SF, "documents").select("doc_id", "text").collect():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, row = plain_runs(words), found[doc_id]
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        assert row["n_words"] == n and row["n_runs"] == len(runs)
        assert row["runs_sha256"] == digest("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert row["collapsed_sha256"] == digest(" ".join(w for i, w in enumerate(words) if i not in gone))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        seen += len(runs)
    assert seen > 10


@pytest.mark.parametrize("prepare", [None, periodic_runs.tail_repeated])
def test_awkward_table(spark, prepare):
    docs = odd(spark)
    found = periodic_runs.find_runs(docs, prepare=prepare)
    rows = found.collect()
    assert len(rows) == docs.count() and all(r["runs"] is not None and r["collapsed"] is not None for r in rows)
    assert periodic_runs.find_runs(docs.filter("false")).count() == 0


def test_ties_go_to_the_first_run():
    assert periodic_runs.greatest([(0, 24, 8), (30, 30, 10), (70, 24, 8)]) == (0, 24, 8)
    assert periodic_runs.greatest([]) is None

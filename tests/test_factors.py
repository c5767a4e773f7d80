"""Factors of sparse matrices against numpy, and exact counts of frequent items."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.plans import factors, frequent


def cooccurring(texts, window, min_count):
    often = {w for w, n in Counter(w for t in texts for w in t or []).items() if n >= min_count}
    found = Counter()
    for t in texts:
        for i, a in enumerate(t or []):
            for j in range(max(0, i - window), min(len(t), i + window + 1)):
                if i != j and a in often and t[j] in often:
                    found[a, t[j]] += 1
    return found


def texts_of(n, words, seed=3):
    rng = np.random.default_rng(seed)
    return [[f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 40)) if x < words] for _ in range(n)] + [None, [], ["w1"]]


def test_word_vectors_span_what_the_exact_ones_span(spark):
    texts = texts_of(300, 40)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, tokens array<string>")
    counts = factors.cooccurrences(df, "tokens", 3, 4)
    want = cooccurring(texts, 3, 4)
    assert {(r.word, r.context): r.n for r in counts.collect()} == want

    weights = factors.positive_information(counts)
    got = {(r.word, r.context): r.weight for r in weights.collect()}
    total, margin = sum(want.values()), Counter()
    for (a, _), n in want.items():
        margin[a] += n
    exact = {p: np.log(n * total / (margin[p[0]] * margin[p[1]])) for p, n in want.items()}
    assert got == pytest.approx({p: x for p, x in exact.items() if x > 1e-12})

    words = sorted({a for a, _ in got})
    at = {w: i for i, w in enumerate(words)}
    m = np.zeros((len(words), len(words)))
    for (a, b), x in got.items():
        m[at[a], at[b]] = x
    vectors = {r.word: r.vector for r in factors.word_vectors(weights, 5, iterations=6, extra=25).collect()}
    ours = np.array([vectors[w] for w in words])
    values, basis = np.linalg.eigh(m)
    best = np.argsort(-np.abs(values))[:5]
    assert ours @ ours.T == pytest.approx(basis[:, best] * np.abs(values[best]) @ basis[:, best].T, abs=1e-5)


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_pairs_are_counted_where_texts_are_read(spark, monkeypatch, bits):
    """Few rows leave the texts, whether or not the hash tells rare words; nulls hold their places."""
    monkeypatch.setattr(factors, "HASH_BITS", bits)
    monkeypatch.setattr(factors, "COUNTED_TOKENS", 200)
    texts = [*texts_of(200, 30), ["x", None, "x", "é"] * 3, ["é"] * 5, *[[f"once{i}", "x"] for i in range(50)]]
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(3)
    counts = factors.cooccurrences(df, "tokens", 3, 4)
    want = cooccurring([[w if w is not None else f"null{i}-{j}" for j, w in enumerate(t or [])] for i, t in enumerate(texts)], 3, 4)
    assert {(r.word, r.context): r.n for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_products_in_blocks(spark, size):
    """Vectors meet blocks of entries; no entry is joined with a vector of its own."""
    rng = np.random.default_rng(8)
    entries = [(None if i == 0 else f"r{i}", j, float(rng.normal())) for i in range(12) for j in range(9) if rng.random() < 0.5]
    entries += [("r3", 4, 0.5), ("r3", 4, 0.25), ("r4", None, 3.0)]
    table = spark.createDataFrame(entries, "row string, column int, value double")
    matrix = factors.in_blocks(table, "row", "column", size)
    assert (matrix.blocks.count() > 3) == (size == 7)
    right = spark.createDataFrame([(j, [float(j), 1.0 - j]) for j in range(9)], "column int, x array<double>")
    left = spark.createDataFrame([(f"r{i}", [i + 0.5, -1.0 * i]) for i in range(1, 12)], "row string, x array<double>")
    want, turned = {}, {}
    for r, c, v in entries:
        if c is not None:
            want[r] = want.get(r, 0) + v * np.array([c, 1.0 - c])
            i = int(r[1:]) if r else 0
            turned[c] = turned.get(c, 0) + v * np.array([i + 0.5, -1.0 * i]) * (r is not None)
    got = {r.row: r.x for r in factors.product(matrix, right, 2, "row", "column").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    got = {r.column: r.x for r in factors.product(matrix, left, 2, "column", "row", turned=True).collect()}
    assert got.keys() == turned.keys() and all(got[k] == pytest.approx(turned[k]) for k in turned)


def test_word_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "word string, context string, weight double")
    assert factors.word_vectors(empty, 3).count() == 0


def test_triangular_factors_merge_in_a_tree(spark):
    x = np.random.default_rng(1).normal(size=(500, 4))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(80)
    r = factors.triangular_factor(df, 4)
    assert r.T @ r == pytest.approx(x.T @ x)


def test_components_equal_the_exact_ones(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    x = np.array([r.embedding for r in table.orderBy("vec_id").collect()], dtype=float)
    found = factors.principal_components(factors.sparse_entries(table, "vec_id", "embedding"), 5, iterations=10, extra=50)
    centred = x - x.mean(0)
    exact = np.linalg.svd(centred, compute_uv=False)[:5] ** 2 / (len(x) - 1)
    assert found.variances == pytest.approx(exact, rel=1e-6)
    scores = np.array([r.x for r in found.scores.orderBy("row").collect()])
    assert np.cov(scores.T) == pytest.approx(np.diag(exact), abs=1e-4 * exact[0])


def test_components_of_a_wide_sparse_table(spark):
    """200,000 columns, three of which vary together."""
    rng = np.random.default_rng(5)
    strong = rng.normal(size=400) * 50
    entries = [(i, c, float(strong[i] * s)) for i in range(400) for c, s in ((7, 1.0), (100_000, -1.0), (199_999, 2.0))]
    entries += [(i, int(c), 1.0) for i in range(400) for c in rng.integers(0, 200_000, 20)]
    table = spark.createDataFrame(entries, "row int, column int, value double").groupBy("row", "column").agg(F.sum("value").alias("value"))
    found = factors.principal_components(table, 1, iterations=4, extra=3)
    assert found.variances[0] == pytest.approx(6 * np.var(strong, ddof=1), rel=1e-2)
    top = {r.column: abs(r.x[0]) for r in found.loadings.collect()}
    assert sorted(top, key=top.get)[-3:][::-1][0] == 199_999 and {7, 100_000} <= set(sorted(top, key=top.get)[-3:])


@pytest.mark.parametrize(("parts", "size"), [(1, 0), (3, 5), (40, 60)])
def test_most_frequent_is_exact(spark, parts, size):
    rng = np.random.default_rng(2)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 4000)] + ["tie1"] * 30 + ["tie0"] * 30 + [None] * 500
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(parts)
    want = sorted(Counter(w for w in words if w is not None).items(), key=lambda p: (-p[1], p[0]))[:20]
    assert [tuple(r) for r in frequent.most_frequent(df, "word", 20, size).collect()] == want


def test_most_frequent_of_flat_and_empty_tables(spark):
    flat = spark.range(3000).select(F.col("id").cast("string").alias("word"))
    want = [(w, 1) for w in sorted(str(i) for i in range(3000))[:4]]
    assert [tuple(r) for r in frequent.most_frequent(flat, "word", 4, 4, largest=64).collect()] == want
    assert frequent.most_frequent(flat.limit(0), "word", 4).count() == 0


def test_summary_bound_holds(spark):
    rng = np.random.default_rng(4)
    words = [f"w{int(x)}" for x in rng.zipf(1.2, 5000)]
    summary = frequent.heavy_hitters(spark.createDataFrame([(w,) for w in words], "word string").repartition(50), "word", 30).collect()
    kept = {r.item: r.n for r in summary if r.item is not None}
    assert len(kept) <= 30 and sum(r.total for r in summary) == len(words)
    missed = (len(words) - sum(kept.values())) / 31
    for word, n in Counter(words).items():
        assert n - missed <= kept.get(word, 0) <= n

"""Threshold joins against all pairs compared plainly; splits against components found plainly."""

import numpy as np
import pyarrow as pa
import pytest

from textweave.plans import splits, threshold


def brute(weights):
    """Cosine of all pairs of records with tokens."""
    vectors = {}
    for key, token, weight in weights:
        if weight:
            vectors.setdefault(key, {})[token] = weight
    length = {k: np.sqrt(sum(w * w for w in v.values())) for k, v in vectors.items()}
    return vectors, {
        (a, b): sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items()) / length[a] / length[b]
        for a in vectors
        for b in vectors
        if a != b
    }


def made(seed=1, n=150):
    """A token in every record, copies of one record, near copies, records without tokens."""
    rng = np.random.default_rng(seed)
    rows = []
    for key in range(n):
        tokens = {0, *((rng.pareto(0.9, 12) * 3).astype(int) % 60)}
        if key % 5 == 0:
            tokens = {0, 1, 2, 3, 70 + (key % 3 == 0)}
        rows += [(key, f"t{t}", float(1 + t % 4)) for t in tokens]
    return [*rows, (n, "t0", 0.0), (n + 1, None, None), (n + 2, "t0", 1.0)]


@pytest.mark.parametrize(("least", "cells"), [(0.5, 1_000_000), (0.8, 50), (1.0, 50)])
def test_pairs_are_those_of_plain_comparison(spark, least, cells):
    rows = made()
    df = spark.createDataFrame(rows, "key int, token string, weight double")
    found = threshold.similar_records(df, "key", least, cells)
    vectors, cosines = brute(rows)
    classes = {r["key"]: r["class_id"] for r in found.classes.collect()}
    assert classes == {k: min(x for x in vectors if vectors[x] == v) for k, v in vectors.items()}
    pairs = {(r["id1"], r["id2"]): r["cosine"] for r in found.pairs.collect()}
    heads = set(classes.values())
    near = {p for p, c in cosines.items() if p[0] < p[1] and p[0] in heads and p[1] in heads and c >= least + 1e-9}
    assert near <= set(pairs) and all(abs(cosines[p] - c) < 1e-9 and c >= least for p, c in pairs.items())
    known, new = (df.filter(f"key % 2 = {i}").select("key") for i in (0, 1))
    across = {(r["id1"], r["id2"]) for r in threshold.similar_to_known(df, known, new, "key", least, cells).pairs.collect()}
    expected = {(classes[a], classes[b]) for (a, b), c in cosines.items() if a % 2 == 1 and b % 2 == 0 and c >= least + 1e-9 and classes[a] != classes[b]}
    both = {classes[a] for a in classes if a % 2 == 1} & {classes[b] for b in classes if b % 2 == 0}
    assert expected | {(c, c) for c in both} <= across and len(across) <= len(expected) + len(both) + 5


def test_only_pairs_within_the_bound_are_formed(spark):
    """Records that share a frequent token only never meet."""
    rows = [(k, t, 1.0) for k in range(300) for t in ("common", f"own{k}", f"more{k}")] + [(300, "own7", 1.0), (300, "more7", 1.0)]
    found = threshold.prefixes(spark.createDataFrame(rows, "key int, token string, weight double"), "key", 0.8)
    assert found.filter("token = 'common'").count() == 0
    left, right = (found.withColumnRenamed("key", n) for n in ("id1", "id2"))
    met = threshold.candidates(left, right, 0.8).filter("id1 < id2").distinct()
    assert [tuple(r) for r in met.collect()] == [(7, 300)]


def test_blocks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(made(3, 60), "key int, token string, weight double")
    whole = {tuple(r)[:2] for r in threshold.similar_records(df, "key", 0.6).pairs.collect()}
    monkeypatch.setattr(threshold, "BLOCK_TOKENS", 40)
    assert {tuple(r)[:2] for r in threshold.similar_records(df, "key", 0.6).pairs.collect()} == whole


def test_vectors_are_shuffled_once_whatever_the_number_of_blocks(spark, monkeypatch):
    """A block is sent to the tasks; the vectors that meet it are read, not dealt out to it."""
    written = []
    frame = type(spark.range(0))
    real = frame.mapInArrow

    def seen(self, *given, **named):
        out = real(self, *given, **named)
        if "cosine" in out.columns:
            written.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(frame, "mapInArrow", seen)
    monkeypatch.setattr(threshold, "BLOCK_TOKENS", 100)
    df = spark.createDataFrame(made(3, 60), "key int, token string, weight double")
    threshold.similar_records(df, "key", 0.6).pairs.count()
    assert len(written) > 3 and not any("Exchange" in plan for plan in written)


def test_reads_are_gathered_by_tokens(monkeypatch):
    monkeypatch.setattr(threshold, "READ_TOKENS", 10)
    sizes = [[3, 4, 2, 9], [12, 1], [], [1, 1, 1]]
    batches = [pa.RecordBatch.from_pydict({"codes": pa.array([list(range(n)) for n in s], pa.list_(pa.int32()))}) for s in sizes]
    found = [[len(x) for x in t.column("codes").to_pylist()] for t in threshold._gathered(iter(batches))]
    assert [n for t in found for n in t] == [n for s in sizes for n in s]
    assert all(sum(t) <= 10 or len(t) == 1 or sum(t[:-1]) <= 10 for t in found) and len(found) >= 3


def test_few_pairs_are_compared_in_full():
    """What two vectors share in their prefixes, and the lengths beyond, leave few pairs but those that reach the threshold."""
    rng = np.random.default_rng(2)
    vectors = [np.unique(rng.integers(0, 3000, 60)) for _ in range(150)]
    vectors += [np.unique(np.r_[v[:50], rng.integers(0, 3000, 10)]) for v in vectors]
    weights = 1.0 / np.sqrt(1.0 + np.arange(3000) / 300)
    sizes = [len(v) for v in vectors]
    flat = np.concatenate(vectors)
    lengths = np.array([np.sqrt((weights[v] ** 2).sum()) for v in vectors])
    block = threshold.Block(None, np.r_[0, np.cumsum(sizes)], flat, weights[flat], lengths)
    other = threshold.Block(*block)
    table = np.zeros((len(vectors), 3000))
    for row, v in zip(table, vectors, strict=True):
        row[v] = weights[v]
    exact = table @ table.T / np.outer(lengths, lengths)
    for most in (100, 1_000_000):
        for right, all_pairs in ((block, np.triu(exact, 1)), (other, exact)):
            left = list(threshold.block_pairs(block, right, 0.7, most))
            i, j, cosine = (np.concatenate(x) for x in zip(*threshold.block_cosines(block, right, iter(left)), strict=True))
            assert np.allclose(cosine, exact[i, j])
            near = set(zip(*np.nonzero(all_pairs >= 0.7 + 1e-9), strict=True))
            assert near <= set(zip(i, j, strict=True)) and len(i) == len(set(zip(i, j, strict=True))) <= 2 * len(near)


def test_thresholds_and_empty_tables(spark):
    empty = spark.createDataFrame([], "key string, token string, weight double")
    assert threshold.similar_records(empty, "key", 0.5).pairs.count() == 0
    for wrong in (0, -1, 1.5):
        with pytest.raises(ValueError, match="threshold"):
            threshold.similar_records(empty, "key", wrong)


def tied(pairs):
    label = {x: x for p in pairs for x in p}
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {x: new if v == old else v for x, v in label.items()}
    return label


@pytest.mark.parametrize("shares", [(0.9, 0.1), (0.5, 0.3, 0.2)])
def test_no_record_is_in_two_parts(spark, shares):
    rng = np.random.default_rng(4)
    pairs = [(f"r{a}", f"r{b}") for a, b in rng.integers(0, 400, (180, 2))] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    rows = [(*p, i) for i, p in enumerate(pairs)] + [(None, "r1", -1), ("r1", None, -2)] + [(*pairs[0], -3)]
    split = splits.split_pairs(spark.createDataFrame(rows, "crime_id1 string, crime_id2 string, n int"), shares).collect()
    assert sorted(r["n"] for r in split) == sorted(r[2] for r in rows)
    label, part = tied(pairs), {}
    for r in split:
        assert (r["part"] is None) == (r["n"] in (-1, -2))
        if r["part"] is not None:
            assert part.setdefault(label[r["crime_id1"]], r["part"]) == r["part"]
    largest = max(sum(label[a] == c for a, _ in pairs) for c in part)
    for i, share in enumerate(shares):
        got = sum(r["part"] == i for r in split)
        assert abs(got - share / sum(shares) * (len(pairs) + 1)) <= largest + 2


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(chain, "a bigint, b bigint")
    found = {r["id"]: r["component"] for r in splits.record_components(df, "a", "b").collect()}
    assert found == tied(chain)
    assert splits.component_parts(df.limit(0), first="a", second="b").count() == 0

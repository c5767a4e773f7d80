from collections import defaultdict
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F
from textweave.llm import vector_graph
from textweave.llm.vector_graph import Search, Settings, near_duplicates, robust_pruned, tied, unit

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def corpus(n=900, size=24, seed=2):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    while i < n:
        centre, label = rng.normal(size=size), int(rng.integers(0, 3)) if i > 250 else 1
        members = 220 if i == 0 else int(rng.integers(1, 6))
        for _ in range(members):
            v = centre + rng.normal(size=size) * np.linalg.norm(centre) / np.sqrt(size) * 0.12
            rows.append((i, [float(x) for x in np.float32(v)], label))
            i += 1
    return rows


def brute(rows, threshold):
    counts, names = defaultdict(int), {r[0]: r[0] for r in rows}
    by = defaultdict(list)
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[label, len(v)].append((i, np.array(v, float)))
    find = lambda x: x if names[x] == x else find(names[x])
    for group in by.values():
        m = unit(np.stack([v for _, v in group]))
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1)), strict=True):
            i, j = group[a][0], group[b][0]
            counts[i] += 1
            counts[j] += 1
            i, j = find(i), find(j)
            names[max(i, j)] = min(i, j)
    return {i: (counts[i], find(i)) for i in names}


def check(spark, rows, settings):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("x"), "shard": F.lit("y")})
    got = {r.vec_id: r for r in near_duplicates(df, settings=settings).collect()}
    want = brute(rows, 0.98)
    assert set(got) == set(want)
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    found, true = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.97 * true
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(r.audited_recall > 0.9 for r in got.values())


def test_recall_against_brute_force(spark):
    check(spark, corpus(), replace(Settings(), shard=64))


def test_blocks_and_slices_lose_no_link(spark):
    check(spark, corpus(), replace(Settings(), shard=64, block=100, slice=40))


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1),
        (8, [float("inf"), 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], None), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [-0.0, 1.0], 1), (15, [0.0, 1.0], 1),
    ]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    linked = {1: (2, 1), 2: (2, 1), 3: (2, 1), 14: (1, 14), 15: (1, 14)}
    assert got == {i: linked.get(i, (0, i)) for i, _, _ in rows}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_search_reaches_the_range():
    rng = np.random.default_rng(0)
    x = unit(np.r_[rng.normal(size=(300, 16)), np.ones((40, 16)) + 0.1 * rng.normal(size=(40, 16))])
    lists = robust_pruned(x, 32, 12, 1.2)
    search = Search(x, np.concatenate(lists), np.array([len(l) for l in lists]), 0)
    rows, nodes = search.within(x, np.full(len(x), -1), 0.9, 0.9, 24)
    true = x @ x.T >= 0.9
    assert len(rows) == len(set(zip(rows.tolist(), nodes.tolist(), strict=True))) and true[rows, nodes].all()
    assert len(rows) >= 0.95 * true.sum()


def test_forest_ties_the_same():
    a, b = tied(np.array([5, 9, 1, 7]), np.array([9, 3, 7, 1]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {5: 3, 9: 3, 7: 1}


def test_small_settings_still_index_every_row(spark):
    rows = corpus(300)
    nodes = vector_graph.nodes_of(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label")
    s = replace(Settings(), shard=16, max_centroids=3, fit_rows=30)
    members = vector_graph.memberships(nodes, vector_graph.centroids(spark, nodes, s), s)
    assert members.filter("primary").count() == nodes.count() == len(rows)


def clump(n, size=24, seed=4):
    """Vectors within the threshold of each other, all in one label."""
    rng = np.random.default_rng(seed)
    centre = unit(rng.normal(size=(1, size)))
    return [(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(centre + rng.normal(size=(n, size)) * 0.08 / np.sqrt(size))]


def test_a_clump_of_many_shards_is_found_whole(spark):
    rows = clump(1000)
    narrow = replace(Settings(), shard=32, overlap=2, candidates=12, degree=4)
    df = spark.createDataFrame(rows, SCHEMA)
    for settings in (narrow, replace(narrow, merge=0.9999)):  # one shard, or many that lead to each other
        nodes = vector_graph.nodes_of(df, "vec_id", "embedding", "label")
        counts, links = vector_graph.link_counts(nodes, 0.98, settings)
        want = sum(n for n, _ in brute(rows, 0.98).values())
        got = counts.agg(F.sum("found")).first()[0]
        assert 0.97 * want <= got <= want


def test_labels_with_low_recall_are_compared_exactly(spark):
    rows = corpus()
    poor = replace(Settings(), shard=64, block=100, slice=40, overlap=1, candidates=1, degree=1, beam=1, near=0.999)
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), settings=poor, least_recall=1.0).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == brute(rows, 0.98)
    assert all(r.audited_recall == 1 for r in got.values())


def test_audit_looks_for_linked_nodes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v, 1) for i, v in enumerate(rng.normal(size=(400, 24)).tolist())]
    few = replace(Settings(), audit_rows=2, audit_most=2)
    assert near_duplicates(spark.createDataFrame(rows, SCHEMA), settings=few).first().audited_recall is None
    rows += [(1000 + i, [x * (1 + 0.01 * i) + 0.01 * j for j, x in enumerate(rows[0][1])], 1) for i in range(1, 3)]
    nodes = vector_graph.nodes_of(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label")
    none = spark.createDataFrame([], "node bigint, found bigint")
    true, whole = vector_graph.audit_sample(nodes, none, 0.98, replace(few, audit_most=4096))
    assert vector_graph.audit(true, none, whole) == 0

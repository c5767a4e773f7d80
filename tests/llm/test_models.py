import math
import random
import tracemalloc

import numpy as np
import pytest
from frames import clashing, docs, odd
from pyspark.sql import functions as F
from textweave.llm import ftrl_toxicity, soft_mixing
from textweave.llm.ftrl_toxicity import Settings

BAD = ["grubble", "snorf", "blick"]


def toxic_rows(n=900, seed=4):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{draw.randint(0, 300)}" for _ in range(draw.randint(10, 80))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(draw.randint(0, len(words)), draw.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    made = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in ftrl_toxicity.toxicity(docs(spark, rows), made).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 100
    assert np.mean([got[i].predicted == dict(labels)[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = ftrl_toxicity.keep_clean(clashing(docs(spark, rows)), made)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}
    assert kept.columns == clashing(docs(spark, [])).columns


def test_labels_of_held_out_rows_are_not_seen(spark):
    rows, labels = toxic_rows(300)
    held = {r.doc_id for r in docs(spark, rows).filter(ftrl_toxicity.held_out(F.col("doc_id"))).collect()}
    wrong = [(i, 1 - y if i in held else y) for i, y in labels]
    scores = [
        {r.doc_id: r.score for r in ftrl_toxicity.toxicity(docs(spark, rows), spark.createDataFrame(l, "doc_id bigint, toxic int")).collect()}
        for l in (labels, wrong)
    ]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labels", [[], [(4, 1), (None, 1), (6, None), (99, 0)]])
def test_toxicity_of_odd_rows(spark, labels):
    df = odd(spark, 2_000)
    got = ftrl_toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert not labels or len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert ftrl_toxicity.toxicity(docs(spark, []), spark.createDataFrame(labels, "doc_id bigint, toxic int")).count() == 0


def test_shrinkage_leaves_the_words_that_matter():
    rows, labels = toxic_rows(800)
    at, weights, bias = ftrl_toxicity.learn([t for _, t in rows], [y for _, y in labels], Settings())
    hashes = ftrl_toxicity.word_hashes()
    places = {int(ftrl_toxicity.word_features(ftrl_toxicity.hashed([w], hashes), Settings().bits)[0, 0]) for w in BAD}
    largest = set(at[np.argsort(-weights)[:3]].tolist())
    assert largest == places and bias < 0


DOMAINS = {"sport": 0.7, "law": 0.3}


def domain_rows(n=400, seed=6):
    draw = random.Random(seed)
    vocabulary = {"sport": [f"s{i}" for i in range(40)], "law": [f"l{i}" for i in range(40)]}
    rows, labels = [], []
    for i in range(n):
        domain = "law" if i % 3 else "sport"
        other = "sport" if i % 3 else "law"
        words = [draw.choice(vocabulary[domain if draw.random() < 0.8 else other]) for _ in range(draw.randint(5, 90))]
        rows.append((i, " ".join(words)))
        labels.append((i, domain))
    return rows, labels


def test_mixing_meets_its_targets(spark):
    rows, labels = domain_rows()
    got = soft_mixing.rates(docs(spark, rows), spark.createDataFrame(labels[:200], "doc_id bigint, domain string"), DOMAINS).toPandas()
    p = np.stack(got.posterior)
    totals = (got.rate.to_numpy() * got.n_tokens.to_numpy()) @ p
    assert np.allclose(totals / totals.sum(), [0.7, 0.3], atol=2e-3) and np.isclose(totals.sum(), got.n_tokens.sum(), rtol=2e-3)
    assert (got.rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    right = [("sport", "law")[int(q.argmax())] == dict(labels)[i] for i, q in zip(got.doc_id, p, strict=True)]
    assert np.mean(right) > 0.95


def projected(p, t, aims, least, most, steps=20_000):
    """The same least squares by plain small steps."""
    moves = (p * t[:, None]).T @ p
    metric = np.linalg.inv(moves + 1e-9 * t.sum() * np.eye(p.shape[1]))
    r = np.clip(np.ones(len(t)), least, most)
    for _ in range(steps):
        r = np.clip(r - 0.5 * p @ metric @ ((t * r) @ p - aims), least, most)
    return (t * r) @ p


def test_rates_equal_brute_force_under_bounds(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    t = rng.integers(1, 200, 300)
    members = spark.createDataFrame([(i, i, 1, int(n), [float(x) for x in q]) for i, (q, n) in enumerate(zip(p, t, strict=True))], "doc_id bigint, key bigint, copies bigint, n_tokens bigint, posterior array<double>")
    for least, most, shares in ((0.0, 1.5, [0.85, 0.1, 0.05]), (0.0, 16.0, [0.98, 0.01, 0.01])):
        got = soft_mixing.fitted_rates(members, dict(zip("abc", shares, strict=True)), least, most).toPandas().sort_values("doc_id")
        r = got.rate.to_numpy()
        assert (r >= least).all() and (r <= most).all()
        want = projected(p, t, np.array(shares) * t.sum(), least, most)
        assert np.allclose((r * t) @ p, want, atol=5e-3 * t.sum())


def test_mixing_of_odd_rows(spark):
    df = odd(spark, 2_000)
    labels = spark.createDataFrame([(4, "sport"), (6, "law"), (None, "law"), (7, None), (8, "other")], "doc_id bigint, domain string")
    rated = soft_mixing.rates(df, labels, DOMAINS)
    found = {(r.doc_id, r.n_tokens): r for r in rated.collect()}
    assert found[(4, 2)].copies == 2 and found[(1, 0)].n_tokens == 0 and (None, 3) in found
    assert all(math.isfinite(r.rate) and r.rate >= 0 for r in found.values())
    kept = soft_mixing.mixed(df, soft_mixing.rates(df, labels, DOMAINS, least=1.0, most=3.0))
    assert kept.columns == df.columns and kept.count() >= df.count()
    empty = soft_mixing.rates(docs(spark, []), labels, DOMAINS)
    assert empty.count() == 0 and soft_mixing.mixed(docs(spark, []), empty).count() == 0


def test_mixing_is_native(spark):
    rows, labels = domain_rows(30)
    rated = soft_mixing.posteriors(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, domain string"), list(DOMAINS))
    plan = rated._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_a_rare_domain_reaches_its_target(spark):
    rows = [(i, "k", 1, 100, [1.0, 0.0] if i else [0.0, 1.0]) for i in range(2000)]
    members = spark.createDataFrame(rows, "doc_id bigint, key string, copies bigint, n_tokens bigint, posterior array<double>")
    one = soft_mixing.fitted_rates(members, {"a": 0.95, "b": 0.05}).filter("doc_id = 0").first()
    assert abs(one.rate * 100 - one.aims[1]) < 0.01 * one.aims[1] and abs(one.reached[1] - one.aims[1]) < 0.01 * one.aims[1]
    capped = soft_mixing.fitted_rates(members, {"a": 0.95, "b": 0.05}, most=16.0).filter("doc_id = 0").first()
    assert capped.rate == 16 and abs(capped.reached[1] - 1600) < 1


def test_learning_holds_only_the_places_that_are_learned():
    texts = ["bad words here"] * 8 + ["good words there"] * 8
    tracemalloc.start()
    at, weights, _ = ftrl_toxicity.learn(texts, [1] * 8 + [0] * 8, Settings())
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(at) and peak < 4 << 20
    assert len(ftrl_toxicity.learn([], [], Settings())[0]) == 0

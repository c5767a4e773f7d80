import hashlib
import itertools
from collections import Counter, defaultdict

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textweave.catalog import linking
from textweave.plans import linkage as k
from textweave.plans import similarity
from textweave.operators import learn


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(f"g{g}", f"c{c}") for g in range(12) for c in range(g, g + 2 + g % 4)]
    return spark.createDataFrame(rows, "group string, crime_id string")


def members(groups):
    found = defaultdict(set)
    for row in groups.collect():
        found[row.group].add(row.crime_id)
    return found


def test_positive_pairs_in_full(groups):
    expected = {
        (a, b, g, 1 / len(m)) for g, m in members(groups).items() for a, b in itertools.combinations(sorted(m), 2)
    }
    rows = k.positive_pairs(groups).collect()
    assert {(r.crime_id1, r.crime_id2, r.group, r.weight) for r in rows} == expected
    assert len(rows) == len(expected) and {r["class"] for r in rows} == {1}


def test_cells_do_not_change_the_pairs(groups):
    whole, cut = (sorted(map(tuple, k.positive_pairs(groups, cell_pairs=n).collect())) for n in (1_000_000, 3))
    assert whole == cut


def test_a_group_of_five_thousand(spark):
    n = 5000
    groups = spark.range(n).select(F.lit("g").alias("group"), F.format_string("c%05d", "id").alias("crime_id"))
    found = k.positive_pairs(groups).agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    assert found.n == n * (n - 1) // 2 and found.w == pytest.approx((n - 1) / 2)


def test_negative_pairs(groups):
    of = members(groups)
    in_groups = defaultdict(set)
    for group, ids in of.items():
        for c in ids:
            in_groups[c].add(group)
    runs = [
        sorted(map(tuple, k.negative_pairs(groups.repartition(n), per_member=5).collect())) for n in (1, 7)
    ]
    assert runs[0] == runs[1]
    assert len(runs[0]) == 5 * sum(map(len, of.values()))
    for c1, c2, group, weight, label in runs[0]:
        assert c1 in of[group] and in_groups[c2] - {group} and (weight, label) == (1.0, 0)
    other = sorted(map(tuple, k.negative_pairs(groups, per_member=5, seed=2).collect()))
    assert other != runs[0]


def test_negative_pairs_take_all_other_groups_if_there_are_no_more(spark):
    """With one record for each other group, the record drawn shows which groups were taken."""
    rows = [("own", "a"), ("own", "b")] + [(f"g{i}", f"x{i}") for i in range(6)]
    groups = spark.createDataFrame(rows, "group string, crime_id string")
    pairs = k.negative_pairs(groups, per_member=99).where("crime_id1 = 'a'").collect()
    assert sorted(r.crime_id2 for r in pairs) == [f"x{i}" for i in range(6)]
    some = k.negative_pairs(groups, per_member=4).where("crime_id1 = 'a'").collect()
    assert len({r.crime_id2 for r in some}) == 4
    one = spark.createDataFrame([("own", "a"), ("own", "b")], "group string, crime_id string")
    assert k.negative_pairs(one).count() == 0


def drawn(seed, *values):
    given = "|".join([str(seed), *[v for v in values if v is not None]])
    return int(hashlib.md5(given.encode()).hexdigest()[:12], 16)


def negatives(rows, k, seed=1):
    """The definition, one pair at a time."""
    order = sorted(rows, key=lambda r: (drawn(seed, r[0]), r[0], drawn(seed, r[1]), r[1] or ""))
    of = {}
    for group, c in order:
        of.setdefault(group, []).append(c)
    names, found = list(of), []
    for group, c in order:
        for i in range(min(k, len(names) - 1)):
            shift = (drawn(seed, c, group) % (len(names) - 1) + i) % (len(names) - 1)
            other = of[names[(names.index(group) + 1 + shift) % len(names)]]
            found.append((c, other[drawn(seed + 1, c, group, str(i)) % len(other)], group, 1.0, 0))
    return Counter(found)


@pytest.mark.parametrize("n_groups, per_member", [(2, 1), (7, 4), (7, 99), (2100, 3)])
def test_negative_pairs_are_those_of_the_definition(spark, n_groups, per_member):
    """Large groups, whose records no block holds, give theirs too; so do rows given twice and null records."""
    rows = [(f"g{g}", f"c{c}") for g in range(n_groups) for c in range(1 + g % 4)] + [("g0", "c0"), ("g1", None)]
    groups = spark.createDataFrame(rows, "group string, crime_id string")
    expected = negatives(rows, per_member)
    for most_held in (0, 2, 256):
        assert Counter(map(tuple, k.negative_pairs(groups, per_member=per_member, most_held=most_held).collect())) == expected


def test_unlinked_pairs_are_formed_after_the_shuffles(groups):
    plan = k.negative_pairs(groups, per_member=5)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate explode(sequence(") < plan.index("Join")


def test_tasks_of_unlinked_pairs_are_counted_by_pairs(groups, monkeypatch):
    """Few rows are shuffled and many pairs are made of them: Spark must not merge the tasks by their bytes."""
    monkeypatch.setattr(k, "TASK_PAIRS", 10)
    found = k.negative_pairs(groups, per_member=5)
    assert found.count() == groups.count() * 5
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-groups.count() * 5 // 10)}), REPARTITION_BY_NUM" in executed


def test_default_number_of_negatives(groups):
    sizes = [len(m) for m in members(groups).values()]
    linked = sum(n * (n - 1) // 2 for n in sizes)
    assert k.negatives_per_member(groups, 2) == -(-linked // len(sizes)) * 2


def test_excluding_linked_pairs(groups):
    linked = {frozenset(p) for m in members(groups).values() for p in itertools.combinations(m, 2)}
    pairs = k.negative_pairs(groups, per_member=8, exclude_linked=True).collect()
    assert pairs and all(r.crime_id1 != r.crime_id2 and frozenset(r[:2]) not in linked for r in pairs)


def test_test_pairs(spark):
    known = spark.createDataFrame([("k1", "x"), ("k2", "y"), ("k3", None)], "crime_id string, place string")
    new = spark.createDataFrame([("n1", "x"), ("n2", "z"), ("n3", None)], "crime_id string, place string")
    assert [tuple(r) for r in k.test_pairs(known, new, ["place"]).collect()] == [("n1", "k1", 1.0, 1)]
    many = spark.range(300).select(F.format_string("r%d", "id").alias("crime_id"), (F.col("id") % 3).alias("place"))
    pairs = k.test_pairs(many, many.limit(60), ["place"], cell_pairs=50).collect()
    assert len(set(pairs)) == len(pairs) == 60 * 100
    assert [r.n_pairs for r in k.block_sizes(known, new, ["place"]).collect()] == [1]
    with pytest.raises(ValueError):
        k.test_pairs(known, new, [])


def features(spark):
    return spark.createDataFrame(
        [("a", "1", 10, 23, ["tv"]), ("b", "1", 13, 1, ["tv", "radio"]), ("c", "UNKNOWN", 10, None, [])],
        "crime_id string, locationType string, ordinalDate int, time int, propertyStolenWordnet array<string>",
    )


def pair_table(spark, *pairs):
    return spark.createDataFrame([(*p, 1.0, 1) for p in pairs], "crime_id1 string, crime_id2 string, weight double, class int")


def test_pair_features(spark):
    pairs = pair_table(spark, ("a", "b"), ("a", "c"), ("a", "zz"))
    df = k.pair_features(pairs, features(spark))
    assert df.columns == ["locationType", "ordinalDate", "time", "propertyStolenWordnet", "weight", "class", "crime_pair"]
    found = {r.crime_pair: tuple(r)[:4] for r in df.collect()}
    assert found == {"a+b": (1, 3, 2, 1 / 6), "a+c": (None, 0, None, None)}
    assert [tuple(r)[:2] for r in k.unmatched_pairs(pairs, features(spark)).collect()] == [("a", "zz")]


def test_pair_features_with_word_similarities(spark):
    similar = spark.createDataFrame([("tv", "tv", 3.0), ("tv", "radio", 1.0)], "a string, b string, sim double")
    df = k.pair_features(pair_table(spark, ("a", "b"), ("a", "c")), features(spark), similar=similar)
    assert {r.crime_pair: r.propertyStolenWordnet for r in df.collect()} == {"a+b": 2.0, "a+c": None}


def test_additive_similarity_counts_repeated_words(spark):
    words = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z"), (2, "x")], "key int, word string")
    similar = spark.createDataFrame([("x", "z", 0.5), ("x", "x", 1.0)], "a string, b string, sim double")
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "id1 int, id2 int")
    found = {(r.id1, r.id2): r.score for r in similarity.additive_similarity(pairs, words, similar, "key").collect()}
    assert found == {(1, 2): (2 * 0.5 + 2 * 1.0) / 6, (2, 1): 2 * 1.0 / 6}


def test_cosine_pairs(spark):
    weights = spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", 2.0), (2, "b", 3.0), (3, "c", 1.0), (4, "a", 0.0)], "key int, token string, weight double"
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 1)], "id1 int, id2 int")
    found = {(r.id1, r.id2): r.cosine for r in similarity.cosine_pairs(weights, pairs, "key").collect()}
    assert found[1, 2] == found[2, 1] == pytest.approx(2 / 5**0.5)
    assert found[1, 3] == 0 and found[1, 4] is None


def test_scale_pairs(spark, tmp_path):
    rows = [(1, 5, None, 1.0), (2, None, None, None), (4, 5, None, 3.0)]
    raw = spark.createDataFrame(
        [(*r, 1.0, 1, f"p{i}") for i, r in enumerate(rows)],
        "x int, same int, empty int, f double, weight double, class int, crime_pair string",
    )
    done = k.scale_pairs(raw)
    assert done.raw.columns == ["x", "same", "f_imputed", "weight", "class", "crime_pair"]
    found = {r.crime_pair: list(r.v) for r in done.scaled.select("crime_pair", vector_to_array("feature_vec").alias("v")).collect()}
    assert found["p0"] == pytest.approx([0, 0.5, 0]) and found["p1"] == pytest.approx([1 / 3, 0.5, 0.5])
    learn.save_model(done.model, str(tmp_path / "m"))
    again = k.scale_pairs(raw.where("x = 4"), learn.load_model(str(tmp_path / "m")))
    assert list(again.scaled.first().feature_vec) == pytest.approx([1, 0.5, 1])


def test_whole_number_means_round_half_to_even(spark):
    raw = spark.createDataFrame([(2, 1.0, 1, "a"), (3, 1.0, 1, "b"), (None, 1.0, 1, "c")], "x int, weight double, class int, crime_pair string")
    assert {r.crime_pair: r.x for r in k.scale_pairs(raw).raw.collect()}["c"] == 2


def reports(spark):
    rows = [
        (f"c{i}", ["Farm", "Residential"][i % 2], f"{1 + i % 28:02d}/03/2017", f"{1 + i % 12}:30 PM", str(5000 + i % 3),
         str(100 + i), f"NARRATIVE: POE - DOOR. ROOM {'MESSY' if i % 2 else 'TIDY'}. word{i % 5} word{i % 7} * PROPERTY STOLEN: TV")
        for i in range(40)
    ]
    return spark.createDataFrame(
        rows, "crime_id string, location_type string, occurrence_start_date string, occurrence_start_time string, "
        "nztm_location_northing string, nztm_location_easting string, narrative string"
    )


def test_report_features_order_and_levels(spark):
    df = k.report_features(reports(spark).limit(1))
    assert df.columns == ["crime_id", *[n for n, f in k.FEATURES.items() if f.derive]]
    row = df.where("crime_id = 'c0'").first()
    assert (row.messy, row.entryPoint, row.locationType) == (0, "POINT OF ENTRY-DOOR", "1")


def test_link_reports(spark):
    edges = spark.createDataFrame([(f"c{i}", f"p{i % 6}") for i in range(40)], "crime_id string, person_id string")
    tags = spark.createDataFrame([("tv", "NN")], "token string, tag string")
    found = k.link_reports(reports(spark), edges, tags=tags, per_member=3, num_features=1 << 10)
    assert set(found.areas) == {"logistic", "bayes"} and all(0 <= a <= 1 for a in found.areas.values())
    rows = found.scores.collect()
    assert {r.model for r in rows} == {"logistic", "bayes"} and all(0 <= r.score <= 1 for r in rows)


def test_linkage_scores_draws_the_default_number_of_unlinked_pairs(spark, tmp_path, monkeypatch):
    """Twenty parts with eight orders each: 28 linked pairs a group, so every member is paired with all 19 other groups."""
    lines = [(100 * part + i, part) for part in range(1, 21) for i in range(8)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "red blue")], "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    orders = spark.createDataFrame([(o, o) for o, _ in lines], "o_orderkey bigint, o_custkey bigint")
    orders.withColumn("o_orderdate", F.lit("1999-01-02").cast("date")).write.parquet(f"{tmp_path}/orders.parquet")
    made = []

    class Reached(Exception):
        pass

    def stopped(pairs, *_):
        made.append(pairs)
        raise Reached

    monkeypatch.setattr(k, "pair_features", stopped)
    with pytest.raises(Reached):
        linking.linkage_scores(spark, str(tmp_path))
    assert {r["class"]: r["count"] for r in made[0].groupBy("class").count().collect()} == {0: 160 * 19, 1: 20 * 28}


def test_candidate_pairs_reuse_the_training_scale(spark):
    df = k.report_features(reports(spark)).withColumn("block", F.col("locationType"))
    known, new = df.where("ordinalDate % 3 = 0"), df.where("ordinalDate % 3 > 0")
    fresh = k.candidate_pairs(known, new, ["block"])
    again = k.candidate_pairs(known, new, ["block"], model=fresh.model)
    assert sorted(map(str, fresh.scaled.collect())) == sorted(map(str, again.scaled.collect()))


def test_no_python_workers_in_report_features(spark):
    plan = k.report_features(reports(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan

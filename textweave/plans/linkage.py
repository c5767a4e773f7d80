"""Record linkage: reports to features, pairs, pair features, models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, MinMaxScaler, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.functions import distance as d
from textweave.functions import reports as r
from textweave.operators import features as ft
from textweave.operators import learn, text
from textweave.operators.evaluate import area
from textweave.operators.ordering import numbered
from textweave.operators.pairing import CELL_PAIRS, grid_join
from textweave.operators.relational import columns_by_type, merge_right_wins
from textweave.operators.sampling import split_by_hash
from textweave.plans.overlap import group_sizes, group_statistics, overlap_groups
from textweave.plans.similarity import additive_similarity
from textweave.session import materialise

PAIR_COLUMNS = ("weight", "class", "crime_pair")
#: Groups in a block of unlinked pairs, at most, and records of a group that a block holds, at most.
BLOCK_GROUPS, MOST_HELD = 256, 256
#: Unlinked pairs that a task forms, about.
TASK_PAIRS = 1 << 22


class Feature(NamedTuple):
    """How a report feature is derived, and how two reports are compared by it."""

    inputs: tuple[str, ...]
    derive: Callable[..., Column] | None
    compare: Callable[[Column, Column], Column] | None
    dtype: str | None


# Names, order and source columns of the report features.
FEATURES = {
    "locationType": Feature(("location_type",), r.location_type, d.nominal, "int"),
    "ordinalDate": Feature(("occurrence_start_date",), r.ordinal_date, d.absolute, "int"),
    "time": Feature(("occurrence_start_time",), r.hour, d.hours_apart, "int"),
    "entryLocation": Feature(("narrative",), r.entry_location, d.nominal, "int"),
    "entryPoint": Feature(("narrative",), r.entry_point, d.nominal, "int"),
    "dayOfWeek": Feature(("occurrence_start_date",), r.day_of_week, d.weekdays_apart, "int"),
    "northingEasting": Feature(
        ("nztm_location_northing", "nztm_location_easting"), r.packed_position, d.packed_straight_line, "int"
    ),
    "methodOfEntry": Feature(("narrative",), r.method_of_entry, None, None),
    "messy": Feature(("methodOfEntry",), r.messy, d.nominal, "int"),
    "propertySecure": Feature(("narrative",), r.property_secure, d.nominal, "int"),
    "propertyStolenWordnet": Feature((), None, d.list_similarity, "double"),
    "cosineTFIDF": Feature((), None, d.vector_cosine, "double"),
    "cosineTFIDF2": Feature((), None, d.vector_cosine, "double"),
}


def report_features(
    reports: DataFrame, key: str = "crime_id", tags: DataFrame | None = None, stem: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """Key and all features of the reports; features they bring already stay, and so do the columns of ``keep``.

    ``tags`` is a tagger's table ``(token, tag)``; without it the list of stolen
    property is left out.
    """
    df = reports.na.fill({"narrative": ""})
    if tags is not None:
        df = df.join(text.stolen_property(df, key, "narrative", tags, stem=stem), key)
    pending = {name: f for name, f in FEATURES.items() if f.derive is not None}
    while pending:
        ready = {n: f.derive(*map(F.col, f.inputs)) for n, f in pending.items() if not set(f.inputs) & set(pending)}
        df = df.withColumns(ready)
        pending = {n: f for n, f in pending.items() if n not in ready}
    brought = [c for c in reports.columns if c in FEATURES]
    return df.select(key, *keep, *brought, *[c for c in FEATURES if c in df.columns and c not in brought])


def text_vectors(
    reports: DataFrame, input_col: str = "narrative", stem: bool = True, num_features: int = ft.FEATURE_SPACE
) -> DataFrame:
    """Add the TF-IDF vectors of words (``cosineTFIDF``) and of word pairs (``cosineTFIDF2``)."""
    df = text.normalise(reports.na.fill("", [input_col]), input_col, "_words", stem)
    df = text.remove_stop_words(df, "_words", "_kept")
    # Stems and tokens are formed once; both fits and the result read them from here.
    df = materialise(text.ngram(df, "_kept", "_pairs"), "tokens")
    for tokens, output in (("_kept", "cosineTFIDF"), ("_pairs", "cosineTFIDF2")):
        df = ft.idf(ft.hashing_tf(df, tokens, f"{tokens}_tf", num_features), f"{tokens}_tf", output).table
    return df.drop("_words", "_kept", "_pairs", "_kept_tf", "_pairs_tf")


def positive_pairs(groups: DataFrame, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Linked pairs: ``(crime_id1, crime_id2, group, weight, class)`` with class 1.

    A group of n records gives all its n(n-1)/2 pairs with weight 1/n. Their number is quadratic by
    definition: ``group_statistics`` tells it beforehand from counts. The work on a large group is
    cut into cells of about ``cell_pairs`` pairs, which does not change the result.
    """
    sized = groups.select("group", "crime_id").join(group_sizes(groups), "group")
    first = sized.select("group", "size", F.col("crime_id").alias("crime_id1"))
    second = groups.select("group", F.col("crime_id").alias("crime_id2"))
    pairs = grid_join(first, second, ["group"], "crime_id1", "crime_id2", cell_pairs).where("crime_id1 < crime_id2")
    return pairs.select("crime_id1", "crime_id2", "group", (1 / F.col("size")).alias("weight"), F.lit(1).alias("class"))


def drawn(seed: int, *columns: str | Column) -> Column:
    """A number below 2^48 from the first digits of the MD5 of seed and columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *columns)), 1, 12), 16, 10).cast("bigint")


def negatives_per_member(groups: DataFrame, select_ratio: int = 1) -> int:
    """Unlinked pairs for each record: ``n_select`` of ``group_statistics``."""
    return int(group_statistics(groups, select_ratio).first()["n_select"] or 0)


def _blocks(members: DataFrame, numbers: DataFrame, width: int, most_held: int) -> DataFrame:
    """Of each ``width`` groups in their order: sizes, first rows, the records in one list and where each group's begin in it, or -1."""
    groups = F.array_sort(F.collect_list(F.struct("number", "size", "start")))
    block = F.floor(F.col("number") / width).cast("bigint").alias("block")
    facts = numbers.groupBy(block).agg(groups.alias("_groups"))
    kept = members.alias("m").join(numbers.where(F.col("size") <= most_held).alias("n"), F.expr("m.group <=> n.group"))
    records = kept.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("m.row", "m.crime_id"))).alias("_records"))
    fits = F.transform("_groups", lambda g: F.when(g["size"] <= most_held, g["size"]).otherwise(0))
    before = F.transform("_groups", lambda _, i: F.aggregate(F.slice(fits, 1, i), F.lit(0).cast("bigint"), lambda s, x: s + x))
    held = F.transform(before, lambda x, i: F.when(F.get("_groups", i)["size"] <= most_held, x).otherwise(-1))
    return facts.join(records, "block", "left").select(
        "block", F.col("_groups.size").alias("sizes"), F.col("_groups.start").alias("starts"), held.alias("held"), F.col("_records.crime_id").alias("ids")
    )


def _spans(members: DataFrame, total: int, k: int, width: int) -> DataFrame:
    """``(crime_id, group, block, first, last, ahead)``: the draws ``first`` to ``last`` of a member fall into the block.

    Draw i takes the group numbered ``i + ahead``. Own number and start leave up to four runs with
    the same ``ahead``, as both the distance and the number begin anew at their ends.
    """
    number, start = F.col("number"), F.col("start")

    def cut(i: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(k).cast("bigint"), i))

    around, again = cut(total - 1 - start), cut(2 * total - 2 - number - start)
    ends = [F.lit(0).cast("bigint"), cut(total - 1 - number - start), around, again, F.lit(k).cast("bigint")]
    ahead = [number + start + d for d in (1, 1 - total, 2 - total, 2 - 2 * total)]
    runs = F.array(*[F.struct(a.alias("a"), b.alias("b"), d.alias("d")) for a, b, d in zip(ends, ends[1:], ahead, strict=False)])
    run = members.select("crime_id", "group", F.explode(F.filter(runs, lambda r: r["a"] < r["b"])).alias("r")).select("crime_id", "group", "r.*")
    lowest, highest = ((x / width).cast("bigint") for x in (F.col("a") + F.col("d"), F.col("b") - 1 + F.col("d")))
    spans = run.withColumn("block", F.explode(F.sequence(lowest, highest)))
    first = F.greatest("a", F.col("block") * width - F.col("d"))
    return spans.select(
        "crime_id", "group", "block", first.alias("first"), (F.least("b", (F.col("block") + 1) * width - F.col("d")) - 1).alias("last"), F.col("d").alias("ahead")
    )


def negative_pairs(
    groups: DataFrame, select_ratio: int = 1, per_member: int | None = None, seed: int = 1, exclude_linked: bool = False,
    most_held: int = MOST_HELD,
) -> DataFrame:
    """Unlinked pairs with weight 1 and class 0, in the columns of :func:`positive_pairs`.

    Each member of a group is paired with one member of k other groups. Groups stand
    in hashed order and the k follow each other in it from a hashed start, so they are
    distinct and never the member's own; the same seed gives the same pairs for any
    partitioning. All draws are digits of MD5, so that other engines can repeat them. If there are not k other groups, all of them are taken. A record in
    several groups may be paired with itself or with a record it is linked to through
    another group, labelled 0 all the same, unless ``exclude_linked``; the training
    default keeps such pairs.

    The groups stand in blocks of their order. A member goes to the few blocks that hold its k
    groups and is paired there, so pairs are formed after the shuffle. Records of groups
    of more than ``most_held`` are not kept in the block; they are joined by row number.
    """
    k = negatives_per_member(groups, select_ratio) if per_member is None else per_member
    shuffled = groups.select("group", "crime_id", drawn(seed, "group").alias("_g"))
    order = [F.col("_g"), F.col("group"), drawn(seed, "crime_id"), F.col("crime_id")]
    members = materialise(numbered(shuffled, order, "row").drop("_g"), "members")
    starts = members.groupBy("group").agg(F.min("row").alias("start"), F.count("*").alias("size"))
    numbers = materialise(numbered(starts, [F.col("start")], "number").withColumn("number", F.col("number") - 1), "numbers")
    total, rows = numbers.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    k = min(k, total - 1)
    if k < 1:
        return members.limit(0).select(
            F.col("crime_id").alias("crime_id1"), F.col("crime_id").alias("crime_id2"), "group",
            F.lit(1.0).alias("weight"), F.lit(0).alias("class"),
        )
    width = max(1, min(BLOCK_GROUPS, total // 1024))
    blocks = materialise(_blocks(members, numbers, width, most_held), "blocks")
    start = F.pmod(drawn(seed, "crime_id", "group"), F.lit(total - 1))
    placed = members.join(numbers.select("group", "number"), "group").select("crime_id", "group", "number", start.alias("start"))
    # What is shuffled is small next to the pairs made of it, so tasks are counted by pairs, not by bytes.
    tasks = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * k // TASK_PAIRS))
    sides = [side.repartition(tasks, "block") for side in (_spans(placed, total, k, width), blocks)]
    met = sides[0].join(sides[1], "block").withColumn("i", F.explode(F.sequence("first", "last")))
    index = (F.col("i") + F.col("ahead") - F.col("block") * width).cast("int")
    draw = F.pmod(drawn(seed + 1, "crime_id", "group", F.col("i").cast("string")), F.get("sizes", index))
    held = F.get("held", index)
    made = [F.col("crime_id").alias("crime_id1"), "crime_id2", "group", F.lit(1.0).alias("weight"), F.lit(0).alias("class")]
    picks = met.where(held >= 0).withColumn("crime_id2", F.get("ids", (held + draw).cast("int"))).select(*made)
    if not numbers.where(F.col("size") > most_held).isEmpty():
        others = met.where(F.exists("held", lambda x: x < 0)).where(held < 0).select("crime_id", "group", (F.get("starts", index) + draw).alias("row"))
        picks = picks.unionByName(others.join(members.select("row", F.col("crime_id").alias("crime_id2")), "row").select(*made))
    return _unlinked(picks, members) if exclude_linked else picks


def _unlinked(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Drop pairs of one record with itself and pairs that share any group."""
    distinct = pairs.select("crime_id1", "crime_id2").distinct()
    of_first = members.select(F.col("crime_id").alias("crime_id1"), F.col("group").alias("shared"))
    of_second = members.select(F.col("crime_id").alias("crime_id2"), F.col("group").alias("shared"))
    linked = distinct.join(of_first, "crime_id1").join(of_second, ["crime_id2", "shared"], "left_semi")
    return pairs.where("crime_id1 <> crime_id2").join(
        linked.select("crime_id1", "crime_id2").distinct(), ["crime_id1", "crime_id2"], "left_anti"
    )


def test_pairs(
    known: DataFrame, new: DataFrame, block_on: Sequence[str], key: str = "crime_id", cell_pairs: int = CELL_PAIRS
) -> DataFrame:
    """New records with the known records that agree on all ``block_on`` columns.

    Weight 1, class 1 as a placeholder. The blocks replace the product of the two
    tables: choose columns with many values, as a block gives new times known pairs.
    A block of many pairs is cut on both sides into cells of about ``cell_pairs`` pairs.
    """
    if not block_on:
        raise ValueError("test pairs need columns to block on")
    blocks = list(block_on)
    # Ids and block columns are written once; whatever derived them is not run again.
    sides = [t.select(*blocks, F.col(key).alias("id"), F.lit(n).alias("_new")) for t, n in ((known, 0), (new, 1))]
    both = materialise(sides[0].unionByName(sides[1]), "blocks")
    left, right = (both.where(f"_new = {n}").select(*blocks, F.col("id").alias(f"crime_id{2 - n}")) for n in (1, 0))
    return grid_join(left, right, blocks, "crime_id1", "crime_id2", cell_pairs).select(
        "crime_id1", "crime_id2", F.lit(1.0).alias("weight"), F.lit(1).alias("class")
    )


test_pairs.__test__ = False  # not a pytest case


def block_sizes(known: DataFrame, new: DataFrame, block_on: Sequence[str]) -> DataFrame:
    """Pairs each block will give, from counts alone: look here before :func:`test_pairs`."""
    count = [F.count("*").alias("n")]
    left = new.groupBy(*block_on).agg(*count).withColumnRenamed("n", "n_new")
    right = known.groupBy(*block_on).agg(*count).withColumnRenamed("n", "n_known")
    return left.join(right, list(block_on)).withColumn("n_pairs", F.col("n_new") * F.col("n_known"))


def unmatched_pairs(pairs: DataFrame, reports: DataFrame, key: str = "crime_id") -> DataFrame:
    """Pairs that :func:`pair_features` cannot compare, as one of the ids is unknown."""
    ids = reports.select(key).distinct()
    found = pairs.join(ids.withColumnRenamed(key, "crime_id1"), "crime_id1", "left_semi").join(
        ids.withColumnRenamed(key, "crime_id2"), "crime_id2", "left_semi"
    )
    return pairs.join(found.select("crime_id1", "crime_id2").distinct(), ["crime_id1", "crime_id2"], "left_anti")


def pair_features(
    pairs: DataFrame, reports: DataFrame, key: str = "crime_id", similar: DataFrame | None = None
) -> DataFrame:
    """Distance of each pair by each feature, in table order, then ``weight, class, crime_pair``.

    ``similar`` is a word similarity table ``(a, b, sim)`` for the lists of stolen
    property; without it they are compared by equal words.
    """
    used = {n: f for n, f in FEATURES.items() if f.compare is not None and n in reports.columns}
    by_table = similar is not None and "propertyStolenWordnet" in used
    if by_table:
        words = reports.select(key, F.explode("propertyStolenWordnet").alias("word"))
        scores = additive_similarity(pairs, words, similar, key, "crime_id1", "crime_id2")
        pairs = pairs.join(scores.withColumnRenamed("score", "_property"), ["crime_id1", "crime_id2"])

    def side(n: int) -> DataFrame:
        return reports.select(F.col(key).alias(f"crime_id{n}"), *[F.col(c).alias(f"{c}_{n}") for c in used])

    joined = pairs.join(side(1), "crime_id1").join(side(2), "crime_id2")
    distances = [
        (F.col("_property") if by_table and n == "propertyStolenWordnet" else f.compare(F.col(f"{n}_1"), F.col(f"{n}_2")))
        .cast(f.dtype).alias(n)
        for n, f in used.items()
    ]
    return joined.select(*distances, "weight", "class", F.concat("crime_id1", F.lit("+"), "crime_id2").alias("crime_pair"))


class ScaledPairs(NamedTuple):
    scaled: DataFrame
    raw: DataFrame
    model: PipelineModel


def scale_pairs(pairs: DataFrame, model: PipelineModel | None = None) -> ScaledPairs:
    """Fill, assemble and scale pair features.

    Whole-number columns get their rounded mean, floating-point ones theirs in
    ``<column>_imputed``; then one vector, whole-number entries first, scaled to [0, 1].
    ``scaled`` has ``feature_vec, weight, class, crime_pair``; ``raw`` is the filled table.
    Fits on ``pairs`` unless a ``model`` fitted before is given.
    """
    if model is None:
        model = _fit_scaling(pairs)
    filled = PipelineModel(model.stages[:-2]).transform(pairs)
    vectors = PipelineModel(model.stages[-2:]).transform(filled)
    return ScaledPairs(vectors.select("feature_vec", *PAIR_COLUMNS), filled, model)


def _fit_scaling(pairs: DataFrame) -> PipelineModel:
    floats, wholes = columns_by_type(pairs, exclude=PAIR_COLUMNS)
    # One pass over the pairs for all means and counts.
    facts = pairs.agg(
        F.lit(0).alias("_"),
        *[F.bround(F.avg(c), 0).cast("bigint").alias(c) for c in wholes],
        *[F.count(F.nanvl(c, F.lit(None))).alias(c) for c in floats],
    ).first()
    wholes = [c for c in wholes if facts[c] is not None]
    floats = [c for c in floats if facts[c] > 0]
    imputed = [f"{c}_imputed" for c in floats]
    filled = [f"coalesce(`{c}`, {facts[c]}) AS `{c}`" for c in wholes]
    stages: list[Any] = [SQLTransformer(statement=f"SELECT {', '.join([*filled, *floats, *PAIR_COLUMNS])} FROM __THIS__")]
    if floats:
        kept = ", ".join([*wholes, *imputed, *PAIR_COLUMNS])
        stages += [
            Imputer(inputCols=floats, outputCols=imputed),
            SQLTransformer(statement=f"SELECT {kept} FROM __THIS__"),
        ]
    stages += [
        VectorAssembler(inputCols=[*wholes, *imputed], outputCol="raw_feature_vec"),
        MinMaxScaler(inputCol="raw_feature_vec", outputCol="feature_vec"),
    ]
    return Pipeline(stages=stages).fit(pairs)


def training_pairs(
    reports: DataFrame, edges: DataFrame, key: str = "crime_id", select_ratio: int = 1, per_member: int | None = None,
    seed: int = 1, similar: DataFrame | None = None,
) -> ScaledPairs:
    """Scaled features of linked and unlinked pairs of reports."""
    groups = materialise(overlap_groups(edges).select("group", "crime_id"), "groups")
    links = positive_pairs(groups).unionByName(negative_pairs(groups, select_ratio, per_member, seed))
    # Fitting the scaling and the models reads the pairs again and again.
    return scale_pairs(materialise(pair_features(links, reports, key, similar), "pairs"))


def candidate_pairs(
    known: DataFrame, new: DataFrame, block_on: Sequence[str], key: str = "crime_id", model: PipelineModel | None = None,
    similar: DataFrame | None = None,
) -> ScaledPairs:
    """Scaled features of new reports against known ones. Scaled afresh unless a ``model`` is given."""
    reports = merge_right_wins(known, new, key)
    features = materialise(pair_features(test_pairs(known, new, block_on, key), reports, key, similar), "pairs")
    return scale_pairs(features, model)


class Linkage(NamedTuple):
    scores: DataFrame
    logistic: Model
    bayes: Model
    scaling: PipelineModel
    areas: dict[str, float]


def link_reports(
    reports: DataFrame, edges: DataFrame, key: str = "crime_id", tags: DataFrame | None = None,
    similar: DataFrame | None = None, select_ratio: int = 1, per_member: int | None = None, seed: int = 1,
    train: float = 0.8, num_features: int = ft.FEATURE_SPACE, fit_share: float = 1.0,
) -> Linkage:
    """The whole chain: text vectors, features, pairs, scaling, two classifiers, their areas under ROC.

    ``fit_share`` may leave some of the training pairs out of the two fits, by hash; the pairs that
    are scored and give the areas are complete in any case.
    """
    features = materialise(report_features(text_vectors(reports, num_features=num_features), key, tags), "reports")
    pairs = training_pairs(features, edges, key, select_ratio, per_member, seed, similar)
    first, second = split_by_hash(pairs.scaled, ["crime_pair"], train, 1 - train, seed)
    if fit_share < 1:
        first, _ = split_by_hash(first, ["crime_pair"], fit_share, 1 - fit_share, seed + 1)
    columns = dict(featuresCol="feature_vec", labelCol="class")
    logistic = learn.logistic_regression(first, **columns).model
    bayes = learn.naive_bayes(first, **columns).model
    scored = {"logistic": learn.score(logistic, second), "bayes": learn.score(bayes, second)}
    areas = {name: area(table) for name, table in scored.items()}
    scores = [
        learn.positive_score(table).select("crime_pair", "class", "weight", F.lit(name).alias("model"), "score", "prediction")
        for name, table in scored.items()
    ]
    return Linkage(scores[0].unionByName(scores[1]), logistic, bayes, pairs.model, areas)

"""Models and their evaluation."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.catalog.common import load, rounded, tokens
from textweave.functions.text import regex_tokens
from textweave.operators import evaluate, learn
from textweave.operators import features as ft
from textweave.sources.files import spread

PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _labelled_terms(spark: SparkSession, sf: str) -> DataFrame:
    labels = load(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    # Labels first: texts without one are neither tokenized nor hashed.
    texts = load(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")
    words = spread(texts, "doc_id").select("doc_id", "label", regex_tokens(F.col("text")).alias("tokens"))
    df = ft.hashing_tf(words, output_col="features")
    return df.select("doc_id", "features", "label", (1.0 + F.col("label")).alias("weight"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return ft.assemble(lines, PRICES).select("l_orderkey", "l_partkey", "features", "label")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))


def lr_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = learn.logistic_regression(_labelled_terms(spark, sf), regParam=0.1).table
    return learn.positive_score(df).select("doc_id", "label", "prediction", rounded("score", 4))


def nb_scores(spark: SparkSession, sf: str) -> DataFrame:
    return learn.naive_bayes(_labelled_terms(spark, sf)).table.select("doc_id", "label", "prediction")


def nb_priors(spark: SparkSession, sf: str) -> DataFrame:
    """Class priors of the weighted model, next to each document's label."""
    df = _labelled_terms(spark, sf)
    priors = [float(x) for x in learn.naive_bayes(df).model.pi]
    prior = F.element_at(F.array(*[F.lit(x) for x in priors]), F.col("label") + 1)
    return df.select("doc_id", "label", F.round(F.exp(prior), 6).alias("prior"))


def nb_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Multinomial Bayes on four counts of a line: every prediction and its probability."""
    counts = ["l_quantity", "discount", "tax", "l_linenumber"]
    percent = {"discount": F.round(F.col("l_discount") * 100), "tax": F.round(F.col("l_tax") * 100)}
    lines = load(spark, sf, "lineitem").withColumns(percent).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    df = learn.naive_bayes(ft.assemble(lines, counts).select("l_orderkey", "l_linenumber", "features", "label")).table
    return learn.positive_score(df).select("l_orderkey", "l_linenumber", "prediction", rounded("score", 5))


def lr_balance(spark: SparkSession, sf: str) -> DataFrame:
    """At the optimum of a logistic fit with a free intercept the residuals add up to nothing."""
    df = learn.positive_score(learn.logistic_regression(_lines(spark, sf)).table)
    return df.agg(F.count("*").alias("n"), F.round(F.abs(F.avg(F.col("label") - F.col("score"))), 3).alias("mean_residual"))


def kmeans_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Each point is with the nearest of the centres."""
    done = learn.cluster(_points(spark, sf), "kmeans", k=10, seed=1)
    v = vector_to_array("features")
    gaps = [
        F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        for c in done.model.clusterCenters()
    ]
    df = done.table.select("vec_id", "prediction", F.array(*gaps).alias("gaps"))
    nearest = F.element_at("gaps", F.col("prediction") + 1) <= F.array_min("gaps") + 1e-9
    return df.select("vec_id", nearest.alias("nearest"))


def dt_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = learn.decision_tree(_lines(spark, sf)).table
    return df.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Price on quantity: fitted value of each line."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("label"))
    df = learn.linear_regression(ft.assemble(lines, ["l_quantity"])).table
    return df.select("l_orderkey", "l_linenumber", "l_quantity", rounded("prediction", 3))


def scored_again(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted on prices of returned lines, applied to all lines."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", F.col("l_extendedprice").alias("label"))
    table = ft.assemble(lines, ["l_quantity"])
    model = learn.linear_regression(table.where("l_returnflag = 'R'")).model
    return learn.apply_any(model, table).select("l_orderkey", "l_quantity", rounded("prediction", 3))


def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return learn.cluster(_points(spark, sf), "kmeans", k=10, seed=1).table.select("vec_id", "prediction")


def bisecting_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return learn.cluster(_points(spark, sf), "bisecting_kmeans", k=10, seed=1).table.select("vec_id", "prediction")


def gaussian_mixture(spark: SparkSession, sf: str) -> DataFrame:
    points = ft.reduce_dimensions(_points(spark, sf), 4).table.select("vec_id", F.col("pca").alias("features"))
    return learn.cluster(points, "gaussian_mixture", k=4, seed=1, maxIter=20).table.select("vec_id", "prediction")


def topics(spark: SparkSession, sf: str) -> DataFrame:
    df = ft.hashing_tf(tokens(spark, sf), output_col="features")
    found = learn.cluster(df, "lda", seed=1).table
    return found.select("doc_id", F.round(F.array_max(vector_to_array("topicDistribution")), 3).alias("largest_share"))


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity")
    ratings = lines.join(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(
        F.col("o_custkey").cast("int").alias("customer"), F.col("l_partkey").cast("int").alias("part"), F.col("l_quantity").cast("float").alias("rating")
    )
    found = learn.recommend(ratings, "customer", "part", "rating")
    return found.table.select("customer", "part", "rating", rounded("prediction", 2))


def tuned(spark: SparkSession, sf: str) -> DataFrame:
    estimator = LogisticRegression()
    found = learn.tune(_lines(spark, sf), estimator, {"regParam": [0.0, 0.1]}, BinaryClassificationEvaluator())
    return found.table.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def tuned_by_split(spark: SparkSession, sf: str) -> DataFrame:
    estimator = LogisticRegression()
    found = learn.tune(_lines(spark, sf), estimator, {"regParam": [0.0, 0.1]}, BinaryClassificationEvaluator(), train_ratio=0.75)
    return found.table.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def _scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed score with ties and many values: price for each unit, in whole units."""
    return load(spark, sf, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("class"), F.col("l_quantity").alias("weight"),
    )


def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.roc_points(_scored_lines(spark, sf)).select("threshold", rounded("FPR", 9), rounded("TPR", 9))


def roc_points_weighted(spark: SparkSession, sf: str) -> DataFrame:
    points = evaluate.roc_points(_scored_lines(spark, sf), weight="weight")
    return points.select("threshold", rounded("FPR", 9), rounded("TPR", 9))


def f_measures(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.thresholds(_scored_lines(spark, sf))
    return found.select("threshold", rounded("precision"), rounded("recall"), rounded("f_measure"))


def areas(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.areas_under_curves(_scored_lines(spark, sf)).select(rounded("area_under_roc"), rounded("area_under_pr"))


def merged_areas(spark: SparkSession, sf: str) -> DataFrame:
    """States of seven batches of lines, merged: the area, how far it may be off, and that it is not further off."""
    lines = _scored_lines(spark, sf)
    batches = [evaluate.score_state(lines.where(F.col("l_linenumber") == n), bits=8) for n in range(1, 8)]
    found = evaluate.area_of_state(evaluate.merge_score_states(*batches))
    exact = evaluate.areas_under_curves(lines).select("area_under_roc").scalar()
    within = (F.abs(F.col("area_under_roc") - exact) <= F.col("error") + 1e-12).alias("within")
    return found.select(rounded("area_under_roc", 9), rounded("error", 9), within)


def precision_at_10(spark: SparkSession, sf: str) -> DataFrame:
    lines = _scored_lines(spark, sf).withColumn("item", F.struct("l_orderkey", "l_linenumber", "class"))
    found = evaluate.precision_at(lines, "l_partkey", "score", "class", "item", 10)
    return found.select("l_partkey", rounded("precision"))


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    lines = _scored_lines(spark, sf).groupBy("l_partkey", "l_orderkey").agg(
        F.max("score").alias("score"), F.max("class").alias("class")
    )
    found = evaluate.average_precision(lines, "l_partkey", "score", "class", "l_orderkey")
    return found.select("l_partkey", rounded("average_precision"))


QUERIES = {
    "lr_scores": lr_scores,
    "nb_scores": nb_scores,
    "nb_priors": nb_priors,
    "dt_scores": dt_scores,
    "linear_fit": linear_fit,
    "scored_again": scored_again,
    "kmeans": kmeans,
    "kmeans_nearest": kmeans_nearest,
    "nb_lines": nb_lines,
    "lr_balance": lr_balance,
    "bisecting_kmeans": bisecting_kmeans,
    "gaussian_mixture": gaussian_mixture,
    "topics": topics,
    "recommendations": recommendations,
    "tuned": tuned,
    "tuned_by_split": tuned_by_split,
    "roc_points": roc_points,
    "roc_points_weighted": roc_points_weighted,
    "f_measures": f_measures,
    "areas": areas,
    "merged_areas": merged_areas,
    "precision_at_10": precision_at_10,
    "average_precision": average_precision,
}

_SCORED = """
    scored as (select l_partkey, l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity)::double as score,
                      cast(l_returnflag = 'R' as integer) as class, l_quantity as weight from lineitem)"""


def _sql_points(unit: str) -> str:
    return f"""
        {_SCORED},
        steps as (select score as threshold, sum(case when class = 1 then {unit} else 0 end)::double as pos,
                         sum(case when class = 0 then {unit} else 0 end)::double as neg from scored group by score),
        points as (select threshold, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp,
                          sum(pos) over () as all_pos, sum(neg) over () as all_neg
                   from steps window w as (order by threshold desc))"""


ORACLES = {
    "nb_lines": """
        with x as (select l_orderkey, l_linenumber, l_returnflag = 'R' as label, l_quantity as a, round(l_discount * 100) as b,
                          round(l_tax * 100) as c, l_linenumber::double as d from lineitem),
        s as (select label, count(*) as n, sum(a) as a, sum(b) as b, sum(c) as c, sum(d) as d, sum(a + b + c + d) as t from x group by label),
        m as (select label, ln(n + 1.0) as prior, ln(a + 1) - ln(t + 4) as a, ln(b + 1) - ln(t + 4) as b, ln(c + 1) - ln(t + 4) as c,
                     ln(d + 1) - ln(t + 4) as d from s),
        g as (select x.l_orderkey, x.l_linenumber,
                     (p.prior - q.prior) + x.a * (p.a - q.a) + x.b * (p.b - q.b) + x.c * (p.c - q.c) + x.d * (p.d - q.d) as gap
              from x, m p, m q where p.label and not q.label)
        select l_orderkey, l_linenumber, case when gap > 0 then 1.0 else 0.0 end::double as prediction,
               round(1 / (1 + exp(-gap)), 5)::double as score from g""",
    "lr_balance": "select count(*) as n, 0.0::double as mean_residual from lineitem",
    "kmeans_nearest": "select vec_id, true as nearest from embeddings",
    "nb_priors": """
        with w as (select quality as label, sum(1.0 + quality) as w from labels join documents using (doc_id) group by quality)
        select doc_id, quality as label,
               round(((select w.w from w where w.label = quality) + 1.0) / ((select sum(w) from w) + 2.0), 6)::double as prior
        from labels join documents using (doc_id)""",
    "linear_fit": """
        with fit as (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from lineitem)
        select l_orderkey, l_linenumber, l_quantity, round(i + s * l_quantity, 3) as prediction from lineitem, fit""",
    "scored_again": """
        with fit as (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i
                     from lineitem where l_returnflag = 'R')
        select l_orderkey, l_quantity, round(i + s * l_quantity, 3) as prediction from lineitem, fit""",
    "roc_points": f"""
        with {_sql_points("1")}
        select threshold, round(fp / all_neg, 9) as "FPR", round(tp / all_pos, 9) as "TPR" from points""",
    "roc_points_weighted": f"""
        with {_sql_points("weight")}
        select threshold, round(fp / all_neg, 9) as "FPR", round(tp / all_pos, 9) as "TPR" from points""",
    "f_measures": f"""
        with {_sql_points("1")}
        select threshold, round(tp / (tp + fp), 6) as precision, round(tp / all_pos, 6) as recall,
               coalesce(round(2 * (tp / (tp + fp) * (tp / all_pos)) / nullif(tp / (tp + fp) + tp / all_pos, 0), 6), 0) as f_measure from points""",
    "merged_areas": f"""
        with {_SCORED},
        bins as (select score / power(2, floor(log2(score)) - 8)::double as place, floor(log2(score)) as power, "class" from scored),
        counts as (select power, floor(place) as place, count(*) filter ("class" = 1) as pos, count(*) filter ("class" = 0) as neg
                   from bins group by all),
        summed as (select pos::double as pos, neg::double as neg, sum(neg) over (order by power, place) as upto from counts)
        select round(sum(pos * (upto - neg / 2)) / (sum(pos) * sum(neg)), 9) as area_under_roc,
               round(sum(pos * neg / 2) / (sum(pos) * sum(neg)), 9) as error, true as within from summed""",
    "areas": f"""
        with {_sql_points("1")},
        curve as (select *, lag(tp, 1, 0) over (order by threshold desc) as tp0, lag(fp, 1, 0) over (order by threshold desc) as fp0
                  from points)
        select round(sum((fp - fp0) / all_neg * (tp0 + tp) / 2 / all_pos), 6) as area_under_roc,
               round(sum((tp - tp0) / all_pos * (case when tp0 + fp0 > 0 then tp0 / (tp0 + fp0) else tp / (tp + fp) end
                                                 + tp / (tp + fp)) / 2), 6) as area_under_pr
        from curve""",
    "precision_at_10": f"""
        with {_SCORED},
        ranked as (select l_partkey, class, row_number() over (partition by l_partkey order by score desc, l_orderkey,
                          l_linenumber, class) as r from scored)
        select l_partkey, round(sum(class) / 10.0, 6)::double as precision from ranked where r <= 10 group by l_partkey""",
    "average_precision": f"""
        with {_SCORED},
        best as (select l_partkey, l_orderkey, max(score) as score, max(class) as class from scored group by 1, 2),
        ranked as (select l_partkey, class, row_number() over w as r, sum(class) over w as hits
                   from best window w as (partition by l_partkey order by score desc, l_orderkey))
        select l_partkey, round(coalesce(sum(case when class = 1 then hits / r::double end) / nullif(sum(class), 0), 0), 6)
               as average_precision from ranked group by l_partkey""",
}

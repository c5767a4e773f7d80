import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from textweave.operators import features as ft
from textweave.operators import learn


@pytest.fixture(scope="module")
def table(spark):
    rows = [(float(i), float(i % 3), 1 if i > 30 else 0, 1.0 + i % 2, 2.0 * i + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, label int, weight double, target double")
    return ft.assemble(df, ["x", "y"])


def test_classifiers(table):
    for fit in (learn.decision_tree, learn.logistic_regression, learn.naive_bayes):
        done = fit(table)
        assert {"prediction", "probability"} <= set(done.table.columns)
        assert learn.score(done.model, table).count() == 60
    assert learn.decision_tree(table).table.where("prediction = label").count() == 60


def test_weight_is_optional(table):
    assert learn.logistic_regression(table.drop("weight"), maxIter=2).table.count() == 60


def test_naive_bayes_needs_non_negative_features(spark):
    df = ft.assemble(spark.createDataFrame([(-1.0, 0), (1.0, 1)], "x double, label int"), ["x"])
    with pytest.raises(Exception, match="(?i)negative"):
        learn.naive_bayes(df)


def test_linear_regression_defaults(table):
    model = learn.linear_regression(table, labelCol="target").model
    assert model.getStandardization() is False
    assert model.coefficients[0] == pytest.approx(2, abs=1e-6) and model.intercept == pytest.approx(1, abs=1e-5)


def test_clustering(table):
    for method, params in [("kmeans", {"k": 2}), ("bisecting_kmeans", {"k": 2}), ("gaussian_mixture", {"k": 2}), ("lda", {"k": 2, "maxIter": 2})]:
        assert learn.cluster(table, method, seed=1, **params).table.count() == 60
    with pytest.raises(ValueError):
        learn.cluster(table, "spectral")


def test_recommend(spark):
    df = spark.createDataFrame([(u, i, float((u + i) % 3)) for u in range(5) for i in range(4)], "u int, i int, r float")
    assert learn.recommend(df, "u", "i", "r", rank=2, maxIter=2).table.count() == 20


def test_blocks_of_ratings_grow_with_them(spark, monkeypatch):
    assert [learn.rating_blocks(n) for n in (0, 600_000, 12_000_000, 216_000_000)] == [10, 10, 21, 55]
    asked = []
    monkeypatch.setattr(learn, "fit_transform", lambda df, stage, **params: asked.append(params))
    df = spark.range(12_000_000).selectExpr("cast(id % 99 as int) u", "cast(id % 77 as int) i", "1f r")
    learn.recommend(df, "u", "i", "r")
    learn.recommend(df, "u", "i", "r", numUserBlocks=3)
    assert (asked[0]["numUserBlocks"], asked[0]["numItemBlocks"]) == (21, 21)
    assert asked[1]["numUserBlocks"] == 3 and "numItemBlocks" not in asked[1]


def test_tuning(table):
    grid = {"regParam": [0.0, 10.0], "elasticNetParam": [0.0]}
    best = learn.tune(table, LogisticRegression(maxIter=5), grid, BinaryClassificationEvaluator(), folds=2)
    assert best.model.bestModel.getRegParam() in grid["regParam"]
    split = learn.tune(table, LogisticRegression(maxIter=5), grid, BinaryClassificationEvaluator(), train_ratio=0.7)
    assert split.table.count() == 60


def test_models_survive_saving(table, tmp_path):
    model = learn.decision_tree(table).model
    learn.save_model(model, str(tmp_path / "m"))
    loaded = learn.apply_any(learn.load_model(str(tmp_path / "m")), table)
    assert [r.prediction for r in loaded.collect()] == [r.prediction for r in model.transform(table).collect()]
    assert 0 <= learn.positive_score(loaded).first().score <= 1


import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textweave.operators import checks, grouping, ordering, relational, roles, sampling
from textweave.session import shared_folder
from textweave.sources import files, sinks, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tname\n1\tx,y\n2\t\n")
    (tmp_path / "a.csv").write_text("id,date\n1,05/03/2017\n")
    tsv = files.read_table(spark, str(tmp_path / "a.tsv"), "tsv")
    assert tsv.dtypes == [("id", "int"), ("name", "string")] and rows(tsv) == [(1, "x,y"), (2, None)]
    assert files.read_table(spark, str(tmp_path / "a.csv")).dtypes[1] == ("date", "string")
    assert files.read_table(spark, str(tmp_path / "a.csv"), schema="id bigint, date string").dtypes[0] == ("id", "bigint")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_other_formats(spark, tmp_path, fmt):
    spark.range(3).write.format(fmt).save(str(tmp_path / "t"))
    assert rows(files.read_table(spark, str(tmp_path / "t"), fmt)) == [(0,), (1,), (2,)]


def test_ids(spark):
    df = spark.createDataFrame([("b",), ("a",)], "k string")
    assert len({r["_id"] for r in files.with_id(df).collect()}) == 2
    assert {r.k: r["_id"] for r in files.with_id(df, keys=["k"]).collect()} == {"a": 0, "b": 1}
    assert files.with_id(df, hashed=True).schema["_id"].dataType.typeName() == "long"
    own = df.withColumn("_id", F.lit(5))
    assert files.with_id(own) is own


def test_spread_leaves_many_pieces_alone(spark):
    many = spark.range(100).repartition(64)
    assert files.spread(many, "id") is many
    assert files.spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rows_and_sql(spark):
    df = tables.from_rows(spark, [(1, "x")], "id int, v string")
    assert rows(tables.from_sql(spark, "select v from {t} where id = :n", {"n": 1}, t=df)) == [("x",)]
    edges = tables.from_rows(spark, [(1, 2), (1, 2), (None, 2)], "a int, b int")
    assert rows(tables.associations(edges, "a", "b")) == [("1", "2")]


class Reader:
    """Records the options of a database read instead of opening a connection."""

    def __init__(self):
        self.set, self.kind = {}, None

    read = property(lambda self: self)

    def format(self, kind):
        self.kind = kind
        return self

    def option(self, name, value):
        self.set[name] = value
        return self

    def options(self, **values):
        self.set.update(values)
        return self

    def load(self):
        return self


def test_database_options():
    one = tables.from_database(Reader(), "jdbc:x:y", "select 1", {"user": "u"})
    assert one.kind == "jdbc" and one.set["query"] == "select 1" and one.set["user"] == "u"
    many = tables.from_database(Reader(), "jdbc:x:y", "select a from t", partition_column="a", bounds=(0, 9), partitions=3)
    assert many.set["dbtable"] == "(select a from t) source_rows" and many.set["numPartitions"] == 3
    assert "query" not in many.set
    with pytest.raises(ValueError):
        tables.from_database(Reader(), "jdbc:x:y", "q", partition_column="a")


def test_arff(spark, tmp_path):
    df = spark.createDataFrame(
        [(Vectors.dense([0.5, 1.0]), 1.0, 1), (Vectors.sparse(2, [1], [2.0]), 0.5, 0)], ["feature_vec", "weight", "class"]
    )
    sinks.write_arff(df, str(tmp_path / "out"), ["x", "y"])
    data = spark.read.text(str(tmp_path / "out" / "data"))
    assert rows(data) == [("0.0,2.0,0.5,0",), ("0.5,1.0,1.0,1",)]
    header = sinks.arff_header(["x", "y"]).splitlines()
    names = [line.split()[1] for line in header if line.startswith("@ATTRIBUTE")]
    assert names == ["x", "y", "weight", "class"] and header[-1] == "@DATA"


def test_preview_and_summary(spark):
    df = spark.createDataFrame([(i, Vectors.dense(range(20))) for i in range(5)], ["id", "v"])
    shown = sinks.preview(df, 2, [F.desc("id")]).collect()
    assert [r.id for r in shown] == [4, 3] and len(shown[0].v) == 10
    assert sinks.summary(df) == (5, 2, [("id", "bigint"), ("v", "vector")])
    assert sinks.row_count(df).first().n_rows == 5 and len(sinks.to_pandas(df, 3)) == 3
    kept = sinks.cached(df)
    assert kept.is_cached
    kept.unpersist()


def test_joins_and_unions(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "_id int, x string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "_id int, y string")
    assert relational.join_on(a, b).columns == ["_id", "x", "y"] and rows(relational.join_on(a, b)) == [(2, "b", "c")]
    assert rows(relational.join_all([a, b, a.withColumnRenamed("x", "z")])) == [(2, "b", "c", "b")]
    assert rows(relational.union_rows(a, b)) == [(1, "a"), (2, "b"), (2, "c"), (3, "d")]
    assert relational.union_rows(a, b, by_name=True).columns == ["_id", "x", "y"]
    assert rows(relational.merge_right_wins(a, b.withColumnRenamed("y", "x"), "_id")) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        relational.join_on(a, b, "x")


def test_fills_and_types(spark):
    df = spark.createDataFrame([(1, None, 2.0), (None, "s", None)], "i int, Narrative string, f double")
    assert rows(relational.fill_by_column(df, {"narrative": "-"}))[0][1] in ("-", "s")
    assert rows(relational.fill_nulls(df)) == [(0, "s", 0.0), (1, None, 2.0)]
    assert rows(relational.fill_nulls(df, 7, ["i"])) == [(1, None, 2.0), (7, "s", None)]
    assert relational.columns_by_type(df, exclude=["Narrative"]) == (["f"], ["i"])
    assert relational.label_text(df, "i").first().label == "1"
    two = spark.createDataFrame([(2, None), (3, None), (None, None)], "x int, e int")
    assert rows(relational.fill_with_means(two, ["x", "e"])) == [(2, None), (2, None), (3, None)]
    assert relational.plot_columns(df, ["f"], "i").columns == ["f", "label"]


def test_top_rows_and_user_function(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "k string, n int")
    assert [r.k for r in relational.top_rows(df, "n", 2, ["k"]).collect()] == ["c", "a"]
    assert relational.apply_function(lambda x, y, n: x.union(y).limit(n), df, df, n=4).count() == 4


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(2000)
    for pieces in (1, 5):
        train, test = sampling.split_by_hash(df.repartition(pieces), ["id"])
        assert rows(train) == rows(sampling.split_by_hash(df, ["id"])[0])
        assert train.count() + test.count() == 2000 and 1700 < train.count() < 1900
        assert rows(sampling.sample_by_hash(df.repartition(pieces), ["id"])) == rows(sampling.sample_by_hash(df, ["id"]))
    train, test = sampling.random_split(df)
    assert train.count() + test.count() == 2000
    assert 800 < sampling.sample(df).count() < 1200


def test_groups_as_lists(spark):
    df = spark.createDataFrame([(1, 2, 3), (2, 0, 1), (1, 5, 6), (None, 7, 7)], "id bigint, dogs bigint, cats bigint")
    found = {r.id: sorted(map(tuple, r.list)) for r in grouping.group_rows(df).collect()}
    assert found == {1: [(1, 2, 3), (1, 5, 6)], 2: [(2, 0, 1)], None: [(None, 7, 7)]}


def test_every_group_comes_in_sorted_parts(spark):
    data = [("hot", i) for i in range(200)] + [("copies", 1)] * 300 + [("cold", 1)] * 2 + [(None, i) for i in range(60)] + [("edge", i) for i in range(20)]
    df = spark.createDataFrame(data, "id string, v int").repartition(5)
    parts = {(r.id, r.part): [x.v for x in r.list] for r in grouping.group_rows(df, list_rows=20).collect()}
    for key in {k for k, _ in data}:
        own = sorted(v for k, v in data if k == key)
        assert [parts.pop((key, p)) for p in range(-(-len(own) // 20))] == [own[i : i + 20] for i in range(0, len(own), 20)]
    assert not parts
    values = {(r.id, r.part): r["values"] for r in grouping.distinct_lists(df, "id", "v", "values", list_rows=50).collect()}
    assert values["copies", 0] == [1] and values["hot", 3] == list(range(150, 200)) and len(values) == 9


def test_roles(spark):
    df = spark.createDataFrame(
        [(i, i % 2, 5, 1.0, "x", None if i == 0 else 1) for i in range(20)], "id int, flag int, high int, f double, s string, gap int"
    )
    found = {r.column: (r.role, r.n_distinct, r["values"]) for r in roles.column_roles(df).collect()}
    assert found == {
        "id": ("continuous", 20, None), "flag": ("discrete", 2, ["0", "1"]), "high": ("continuous", 1, None),
        "f": ("continuous", None, None), "s": ("meta", None, None), "gap": ("continuous", 1, None),
    }


def test_checks(spark):
    df = spark.createDataFrame([(1, ["a"])], "id int, t array<string>")
    checks.require_column(df, "t", "array<string>")
    checks.require_new_column(df, "new")
    assert checks.columns_at(df, [1, 0]) == ["t", "id"]
    for broken in (
        lambda: checks.require_column(df, "x"), lambda: checks.require_column(df, "id", "string"),
        lambda: checks.require_new_column(df, "id"), lambda: checks.require_input(None),
        lambda: checks.require_shared(df, df.drop("id"), "id"),
    ):
        with pytest.raises(ValueError):
            broken()


def test_running_totals_and_numbers(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    found = ordering.running_totals(df, [F.desc("k")], {"total": F.col("id")}).orderBy(F.desc("k")).collect()
    total = 0
    for row in found:
        total += row.id
        assert row.total == total
    numbers = ordering.numbered(df, [F.col("k")]).collect()
    assert all(r.row_number == r.k + 1 for r in numbers)


def test_written_tables_go_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir())

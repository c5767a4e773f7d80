"""The ARFF data source: round trips, ranges, commit and abort."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textweave.sources.arff import ArffSource, values

ROWS = [
    (1, 0.1, "plain"), (2, None, None), (3, -1e300, "it's, \\ a 'quoted'\nline\twith ünïcödé"), (4, 2.5, ""), (5, 0.0, "?"),
    (6, float("inf"), "@data"), (None, 7.0, "% no comment"),
]


@pytest.fixture
def arff(spark):
    spark.dataSource.register(ArffSource)
    return spark


def back(spark, path, **options):
    return sorted(map(tuple, spark.read.format("arff").options(**options).load(str(path)).collect()), key=str)


@pytest.mark.parametrize("block", [1 << 26, 64, 7])
def test_round_trip_in_any_ranges(arff, tmp_path, block):
    df = arff.createDataFrame(ROWS, "`the id` int, x double, text string").repartition(3)
    df.write.format("arff").mode("append").save(str(tmp_path / "t"))
    read = arff.read.format("arff").option("block", block).load(str(tmp_path / "t"))
    assert read.dtypes == [("the id", "double"), ("x", "double"), ("text", "string")]
    want = sorted(((None if i is None else float(i), x, t) for i, x, t in ROWS), key=str)
    assert sorted(map(tuple, read.collect()), key=str) == want


def test_append_overwrite_and_empty(arff, tmp_path):
    df = arff.range(5).select(F.col("id").cast("double").alias("id"))
    for mode, n in (("append", 5), ("append", 10), ("overwrite", 5)):
        df.write.format("arff").mode(mode).save(str(tmp_path / "t"))
        assert len(back(arff, tmp_path / "t")) == n
    df.limit(0).write.format("arff").mode("overwrite").save(str(tmp_path / "t"))
    assert back(arff, tmp_path / "t") == []


def test_a_failed_write_leaves_nothing(arff, tmp_path):
    df = arff.range(10, numPartitions=2).select(F.when(F.col("id") == 9, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("double").alias("x"))
    with pytest.raises(Exception, match="stop"):
        df.write.format("arff").mode("append").save(str(tmp_path / "t"))
    assert [p for p in Path(tmp_path).rglob("*") if p.is_file()] == []


def test_foreign_file(arff, tmp_path):
    (tmp_path / "f.arff").write_text("% c\n@relation r\n@attribute 'a b' REAL\n@attribute k {x, 'y z'}\n@data\n1,x\n\n?, 'y z'\n% end\n2,?\n")
    assert back(arff, tmp_path / "f.arff") == sorted([(1.0, "x"), (None, "y z"), (2.0, None)], key=str)
    assert values("a,") == ["a", ""] and values("'?',?") == ["?", None]

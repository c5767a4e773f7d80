"""Tables from files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.operators.ordering import numbered

DELIMITERS = {"csv": ",", "tsv": "\t"}


def read_table(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None
) -> DataFrame:
    """Read csv, tsv, parquet, orc or json.

    Delimited files have a header and inferred types. Inference costs an extra
    pass over the files: give a ``schema`` for large ones.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt in DELIMITERS:
        return reader.csv(path, sep=DELIMITERS[fmt], header=True, inferSchema=schema is None)
    return reader.format(fmt).load(path)


#: Tables of more bytes than this are never dealt out by ``spread``.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a small table that comes in fewer pieces than there are cores.

    A small file is read by a few tasks, often one row group by one task. The rows are
    then dealt out by the hash of ``keys``. A table that Spark estimates at more than
    ``SPREAD_BYTES`` is returned as it is whatever the cluster: it is never shuffled here.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < 2 * cores else df


def with_id(
    df: DataFrame, name: str = "_id", keys: Sequence[str | Column] | None = None, hashed: bool = False
) -> DataFrame:
    """Add a bigint row id unless the column is there.

    By default the id is unique but neither consecutive nor stable. With ``keys``
    (a unique key) it is 0, 1, 2, … along them; with ``hashed`` it is a hash of
    the row, equal for equal rows.
    """
    if name in df.columns:
        return df
    if hashed:
        return df.withColumn(name, F.xxhash64(*df.columns))
    if keys is None:
        return df.withColumn(name, F.monotonically_increasing_id())
    order = [F.col(k) if isinstance(k, str) else k for k in keys]
    return numbered(df, order, name).withColumn(name, F.col(name) - 1)

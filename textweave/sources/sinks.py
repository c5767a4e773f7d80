"""Previews, bounded exports and the ARFF writer."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Summary(NamedTuple):
    rows: int
    columns: int
    types: list[tuple[str, str]]


def summary(df: DataFrame) -> Summary:
    return Summary(df.count(), len(df.columns), df.dtypes)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def preview(df: DataFrame, rows: int = 100, order: Sequence[str | Column] = (), entries: int = 10) -> DataFrame:
    """First ``rows`` rows; vectors and numeric arrays show their first ``entries`` values."""
    def shown(field) -> Column:
        if isinstance(field.dataType, VectorUDT):
            return F.slice(vector_to_array(field.name), 1, entries).alias(field.name)
        if field.dataType.simpleString() in ("array<float>", "array<double>"):
            return F.slice(field.name, 1, entries).alias(field.name)
        return F.col(field.name)

    cut = df.orderBy(*order).limit(rows) if order else df.limit(rows)
    return cut.select(*[shown(f) for f in df.schema])


def to_pandas(df: DataFrame, rows: int) -> pd.DataFrame:
    """At most ``rows`` rows on the driver."""
    return df.limit(rows).toPandas()


def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep a table on the executors; the caller unpersists it."""
    return df.persist(level)


def arff_header(attributes: Sequence[str], relation: str = "reports") -> str:
    lines = [f"@RELATION {relation}", ""]
    lines += [f"@ATTRIBUTE {name}  NUMERIC" for name in attributes]
    lines += ["@ATTRIBUTE weight  NUMERIC", "@ATTRIBUTE class {0,1}", "", "@DATA"]
    return "\n".join(lines) + "\n"


def arff_lines(df: DataFrame, vector: str = "feature_vec", decimals: int | None = None) -> DataFrame:
    """One data line per row: vector entries, weight, class."""
    def text(value: Column) -> Column:
        return value.cast("string") if decimals is None else F.format_string(f"%.{decimals}f", value)

    values = F.transform(vector_to_array(vector), text)
    weight = text(F.col("weight").cast("double"))
    return df.select(F.concat_ws(",", values, weight, F.col("class").cast("string")).alias("value"))


def write_arff(df: DataFrame, path: str, attributes: Sequence[str], vector: str = "feature_vec") -> None:
    """Write ``path/header.arff`` as one file and ``path/data`` as one part per partition."""
    spark = df.sparkSession
    header = spark.createDataFrame([(arff_header(attributes).rstrip("\n"),)], "value string")
    header.coalesce(1).write.mode("overwrite").text(f"{path}/header.arff")
    arff_lines(df, vector).write.mode("overwrite").text(f"{path}/data")

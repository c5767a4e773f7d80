"""The tables that the queries and the pipeline read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.session import materialise


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` from the columns ``quality`` and ``toxic``."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")


def one_of_each(docs: DataFrame, keys: Sequence[str], verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are kept by ``verdicts (*keys, kept)``, each document once.

    Nulls are keys like others. Rows with the same keys are one document given twice: of these the
    one whose columns, written as JSON, come first stays. Only the few rows that are given twice are
    grouped.
    """
    counts = verdicts.groupBy(*keys).agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    named = counts.filter(~F.col("kept") | (F.col("n") > 1)).select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "kept")
    named = materialise(named, "dropped")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    once = docs.join(named.hint("merge"), same, "left_anti")
    twice = docs.join(named.filter("kept").hint("merge"), same, "left_semi")
    row = F.struct(*docs.columns)
    first = twice.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return once.union(first.select("_row.*"))

"""Joins, unions, fills, projections and sorted cuts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.operators.checks import require_shared

FLOATS = ("float", "double")


def join_on(left: DataFrame, right: DataFrame, key: str = "_id") -> DataFrame:
    """Inner join on a shared column, kept once."""
    require_shared(left, right, key)
    return left.join(right, [key])


def join_all(tables: Sequence[DataFrame], key: str = "_id") -> DataFrame:
    return reduce(lambda left, right: join_on(left, right, key), tables)


def union_rows(first: DataFrame, second: DataFrame, by_name: bool = False) -> DataFrame:
    """All rows of both, matched by position or by name."""
    if by_name:
        return first.unionByName(second, allowMissingColumns=True)
    return first.union(second)


def merge_right_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, the row of ``second``."""
    require_shared(first, second, key)
    return second.unionByName(first.join(second.select(key).distinct(), key, "left_anti"))


def fill_by_column(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return df.na.fill(dict(values))


def fill_nulls(df: DataFrame, value: Any = 0, subset: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=list(subset) if subset else None)


def columns_by_type(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Names of the floating-point columns, and of the others."""
    kept = [(name, dtype) for name, dtype in df.dtypes if name not in exclude]
    return [n for n, t in kept if t in FLOATS], [n for n, t in kept if t not in FLOATS]


def label_text(df: DataFrame, source: str = "class", target: str = "label") -> DataFrame:
    """A label column as text."""
    return df.withColumn(target, F.col(source).cast("string"))


def plot_columns(df: DataFrame, columns: Sequence[str], label: str = "class") -> DataFrame:
    """The columns of a scatter matrix, with the label as text."""
    return label_text(df, label).select(*columns, "label")


def top_rows(df: DataFrame, measure: str, cutoff: int, ties: Sequence[str | Column]) -> DataFrame:
    """The ``cutoff`` rows with the largest ``measure``; ``ties`` settles equal ones."""
    return df.orderBy(F.desc(measure), *ties).limit(cutoff)


def means_rounded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the mean of each column, rounded half to even; null if all are null."""
    return df.agg(*[F.bround(F.avg(c), 0).cast("bigint").alias(c) for c in columns])


def fill_with_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls by the rounded mean of the column."""
    means = means_rounded(df, columns).first().asDict()
    found = {name: value for name, value in means.items() if value is not None}
    return df.na.fill(found) if found else df


def apply_function(fn: Callable[..., Any], *tables: DataFrame, **params: Any) -> Any:
    """Run the caller's function over tables; the place of a script box."""
    return fn(*tables, **params)

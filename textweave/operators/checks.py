"""Checks made when a plan is built, before any job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_column(df: DataFrame, name: str, dtype: str | None = None) -> None:
    found = dict(df.dtypes).get(name)
    if found is None:
        raise ValueError(f"column {name!r} is not in the input: {df.columns}")
    if dtype is not None and found != dtype:
        raise ValueError(f"column {name!r} is {found}, not {dtype}")


def require_new_column(df: DataFrame, name: str) -> None:
    if name in df.columns:
        raise ValueError(f"column {name!r} exists already")


def require_shared(left: DataFrame, right: DataFrame, key: str) -> None:
    for df in (left, right):
        require_column(df, key)


def require_input(df: DataFrame | None) -> None:
    if df is None:
        raise ValueError("no input table")


def columns_at(df: DataFrame, positions: list[int]) -> list[str]:
    """Names of the columns at ``positions``."""
    return [df.columns[i] for i in positions]

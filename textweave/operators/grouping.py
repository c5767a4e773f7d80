"""Rows of a group as a list, in parts that stay small however large the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.operators.ordering import numbered

LIST_ROWS = 10_000


def group_rows(
    df: DataFrame, group_col: str = "id", output_col: str = "list", columns: Sequence[str] | None = None,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """``(group_col, part, output_col)``: the rows of each group as lists of structs.

    The rows of a group stand in their order; part 0 has the first ``list_rows`` of them, part 1 the
    next, and so on. A null key is a group like any other. Rows are numbered in ranges of the order,
    so no task holds a group, and none is shuffled twice whole.
    """
    columns = list(columns or df.columns)
    row = F.struct(*columns)
    rows = df.select(F.col(group_col).alias("_group"), row.alias("_row"))
    rows = numbered(rows, [F.col("_group"), F.col("_row")], "_place")
    first = rows.groupBy(F.col("_group").alias("_key")).agg(F.min("_place").alias("_first"))
    return (
        rows.join(first, F.col("_group").eqNullSafe(F.col("_key")))
        .groupBy("_group", F.floor((F.col("_place") - F.col("_first")) / list_rows).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("_place", "_row"))).alias("_rows"))
        .select(F.col("_group").alias(group_col), "part", F.col("_rows._row").alias(output_col))
    )


def distinct_lists(df: DataFrame, group_col: str, value_col: str, output_col: str, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(group_col, part, output_col)``: distinct values of each group, sorted over all its parts."""
    lists = group_rows(df.select(group_col, value_col).distinct(), group_col, "_values", [value_col], list_rows)
    return lists.select(group_col, "part", F.col("_values")[value_col].alias(output_col))

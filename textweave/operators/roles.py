"""Which role a column plays: continuous, discrete with its values, or meta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a numeric column with this many distinct values is continuous.
CONTINUOUS_FROM = 13


def column_roles(df: DataFrame) -> DataFrame:
    """``(column, role, n_distinct, values)``, one row per column.

    Numeric columns are continuous if they are floating-point, have nulls, have 13
    distinct values or more, or exceed their number of distinct values; else discrete,
    with the values sorted as text. Everything else is meta. ``n_distinct`` (nulls not
    counted) is given for whole-number columns, where the role needs it.
    """
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.FractionalType, T.DecimalType))]
    fixed = [(f.name, "continuous" if f.name in floating else "meta") for f in df.schema if f.name not in whole]
    spark = df.sparkSession
    schema = "column string, role string, n_distinct bigint, values array<string>"
    result = spark.createDataFrame([(name, role, None, None) for name, role in fixed], schema)
    if not whole:
        return result
    # Distinct values leave each task once: the shuffle carries no repeated value.
    values = (
        df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("v")) for c in whole])))
        .select("col.*")
        .distinct()
    )
    counts = values.groupBy("column").agg(
        F.count("v").alias("n_distinct"), F.max("v").alias("top"), F.bool_or(F.col("v").isNull()).alias("nulls")
    )
    few = (F.col("n_distinct") < CONTINUOUS_FROM) & (F.col("top") <= F.col("n_distinct"))
    discrete = counts.where(few & ~F.col("nulls"))
    # At most 12 values for each column are collected here; one row per column is broadcast.
    listed = (
        values.join(F.broadcast(discrete.select("column")), "column")
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.col("v").cast("string"))).alias("values"))
    )
    judged = counts.join(F.broadcast(listed), "column", "left").select(
        "column",
        F.when(F.col("values").isNull(), "continuous").otherwise("discrete").alias("role"),
        "n_distinct",
        "values",
    )
    return judged.unionByName(result)


def role_state(df: DataFrame) -> DataFrame:
    """Summary of the whole-number columns of a batch: ``(column, sketch, top, nulls)``, one row for each.

    A sketch of distinct values has a few KB, however many rows the batch has. Keep the states of
    all batches and merge them with :func:`merge_role_states`: no earlier batch is read again.
    """
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    if not whole:
        return df.sparkSession.createDataFrame([], "column string, sketch binary, top bigint, nulls boolean")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("v")) for c in whole]))
    return df.select(cells).select("col.*").groupBy("column").agg(
        F.hll_sketch_agg("v").alias("sketch"), F.max("v").alias("top"), F.bool_or(F.col("v").isNull()).alias("nulls")
    )


def merge_role_states(states: DataFrame, *more: DataFrame) -> DataFrame:
    """One state for each column, as if all batches had been one table."""
    for state in more:
        states = states.unionByName(state)
    return states.groupBy("column").agg(
        F.hll_union_agg("sketch").alias("sketch"), F.max("top").alias("top"), F.bool_or("nulls").alias("nulls")
    )


def roles_of_state(state: DataFrame, df: DataFrame) -> DataFrame:
    """``(column, role, n_distinct, values)`` of :func:`column_roles`, from a state of all batches in ``df``.

    Only columns whose sketch has at most four times the threshold are counted again, exactly, by
    reading those columns of ``df``; the others are continuous, and so are columns with nulls.
    For them ``n_distinct`` is the estimate of the sketch. A sketch is exact far beyond the
    threshold while it lists its values, so no discrete column is left out.
    """
    # One row per column of the table.
    judged = state.select("column", F.hll_sketch_estimate("sketch").alias("n"), "nulls").collect()
    near = {row["column"] for row in judged if row["n"] <= 4 * CONTINUOUS_FROM and not row["nulls"]}
    whole = {row["column"] for row in judged}
    schema = "column string, role string, n_distinct bigint, values array<string>"
    sure = [(r["column"], "continuous", r["n"], None) for r in judged if r["column"] not in near]
    recounted = column_roles(df.select(*[c for c in df.columns if c in near or c not in whole]))
    return recounted.unionByName(df.sparkSession.createDataFrame(sure, schema))

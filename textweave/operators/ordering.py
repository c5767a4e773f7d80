"""Running totals and row numbers over a total order, without a one-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweave.session import materialise


def running_totals(df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]) -> DataFrame:
    """Add, for each entry of ``totals``, its running sum along ``order``.

    ``order`` must be a unique key. Rows are cut into ranges of that order; the
    window runs inside each range, and the sum of all earlier ranges is added.
    The range number is pinned by writing the table, as both branches need it.
    """
    own = {f"_own_{name}": value for name, value in totals.items()}
    ranged = materialise(
        df.withColumns(own).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in own])
    # One row per range: bounded by the number of shuffle partitions.
    offsets = per_range.select(
        "_range", *[F.coalesce(F.sum(f"_own_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumns({n: F.sum(f"_own_{n}").over(inside) + F.col(f"_before_{n}") for n in totals})
        .select(*df.columns, *totals)
    )


def numbered(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Number rows 1, 2, 3, … along ``order``; rows that are equal in it stand in any order.

    One shuffle: rows are cut into sorted ranges and written with the number of their range and
    their place in it, which Spark's increasing id holds. The rows of all earlier ranges are added.
    """
    ranged = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges"
    )
    # An increasing id has the partition above 33 bits for the row in it.
    part, place = F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    # One row per range: bounded by the number of shuffle partitions.
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.withColumn("_range", part)
        .join(F.broadcast(offsets), "_range")
        .select(*df.columns, (place + F.col("_before") + 1).alias(name))
    )

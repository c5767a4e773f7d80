"""Joins that give all pairs of a key, with frequent keys cut on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_PAIRS = 1_000_000


def grid_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_by: str, right_by: str, cell_pairs: int = CELL_PAIRS
) -> DataFrame:
    """Inner join on ``keys``, the same rows as ``left.join(right, keys)``.

    A key with more than ``cell_pairs`` pairs is cut into a square grid: the rows of each side are
    dealt out by a hash of ``left_by`` and ``right_by``, and each cell is joined on its own. A row is
    copied as often as the other side is cut, about the square root of the number of cells, so the
    copies stay far below the pairs.
    """
    keys = list(keys)
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).join(right.groupBy(*keys).agg(F.count("*").alias("_m")), keys)
    side = F.ceil(F.sqrt(F.col("_n") * F.col("_m") / F.lit(float(cell_pairs)))).cast("int")
    large = counts.select(*keys, side.alias("_side")).where("_side > 1")

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        sides = F.coalesce("_side", F.lit(1))
        return (
            df.join(large, keys, "left")
            .withColumn(own, F.pmod(F.xxhash64(by), sides).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), sides - 1)))
            .drop("_side")
        )

    cells = dealt(left, left_by, "_i", "_j").join(dealt(right, right_by, "_j", "_i"), [*keys, "_i", "_j"])
    return cells.drop("_i", "_j")

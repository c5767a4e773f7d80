"""Splits of pairs that put no record on both sides.

Records that pairs tie together, over any number of steps, are one component; whole components are
dealt to the parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.operators.ordering import running_totals
from textweave.session import materialise


def record_components(pairs: DataFrame, first: str, second: str, rounds: int = 100) -> DataFrame:
    """``(id, component)``: the smallest id that each record is tied to; ids of any ordered type.

    Each round takes the least label of a record and its neighbours, then the label's own label, so
    the distance that a label has come doubles. Pairs with a null are left out.
    """
    ties = pairs.select(F.col(first).alias("a"), F.col(second).alias("b")).dropna().distinct()
    both = materialise(ties.union(ties.select("b", "a")).distinct(), "ties")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "a").select("a", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        own = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        labels = materialise(
            stepped.join(own, "label").select("a", F.least("label", "further").alias("label"), "before"), "labels"
        )
        if not labels.filter("label <> before").limit(1).count():
            return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))
        labels = labels.select("a", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def component_parts(
    pairs: DataFrame, shares: Sequence[float] = (0.9, 0.1), first: str = "crime_id1", second: str = "crime_id2", seed: int = 12345
) -> DataFrame:
    """``(id, component, part)``: the part of each record, the same for all records of a component.

    Components stand in the order of the MD5 of their name and the seed; each goes to the part in
    which the middle of its pairs falls when all pairs are laid end to end. Parts have their shares of
    the pairs to within half the largest component that meets a border.
    """
    members = materialise(record_components(pairs, first, second), "components")
    ids = members.withColumnsRenamed({"id": first})
    sizes = pairs.join(ids, first).dropna(subset=[second]).groupBy("component").agg(F.count("*").alias("n"))
    place = F.md5(F.concat_ws("|", F.col("component").cast("string"), F.lit(str(seed))))
    laid = materialise(running_totals(sizes.withColumn("place", place), [F.col("place"), F.col("component")], {"upto": F.col("n")}), "laid-components")
    total = laid.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    # Twice the middle, so that it is a whole number.
    middle, border, part = 2 * F.col("upto") - F.col("n"), 0.0, F.lit(0)
    for share in shares[:-1]:
        border += share / sum(shares)
        part = part + (middle >= F.lit(2 * border) * total).cast("int")
    return members.join(laid.select("component", part.alias("part")), "component").select("id", "component", "part")


def split_pairs(
    pairs: DataFrame, shares: Sequence[float] = (0.9, 0.1), first: str = "crime_id1", second: str = "crime_id2", seed: int = 12345
) -> DataFrame:
    """``pairs`` with the column ``part``, 0 for the first share; no record is in pairs of two parts.

    Pairs with a null id have the part null.
    """
    parts = component_parts(pairs, shares, first, second, seed)
    return pairs.join(parts.select(F.col("id").alias(first), F.when(F.lit(True), F.col("part")).alias("part")), first, "left").withColumn(
        "part", F.when(F.col(second).isNotNull(), F.col("part"))
    )

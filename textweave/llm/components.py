"""Connected components of a table of links, by alternating stars.

Kiveris et al., "Connected components in MapReduce and beyond" (2014). Every round is two grouped
minima and two joins over the links left; nothing is gathered on the driver but two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to the least of it and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = both.join(least.hint("merge"), "a").filter("b > a")
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the least of these. Links have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    rest = links.join(least.hint("merge"), "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return rest.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node in ``links (a, b)``: the least node it is tied to.

    Nodes are bigints; nulls and links of a node to itself are left out, so a node without another
    is not in the result. Links given twice count once.
    """
    links = (
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    links = materialise(links, "links")
    before = None
    for _ in range(rounds):
        sums = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sums == before or sums[0] == 0:
            break
        before = sums
        links = materialise(_small_star(_large_star(links)), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    heads = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads)

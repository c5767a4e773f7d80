"""The k most frequent items, exactly, in memory that does not grow with the number of different items."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.session import materialise

#: Summaries merged in one task.
MERGED = 32
SCHEMA = "item string, n bigint, total bigint"


def _cut(counters: Counter, size: int) -> Counter:
    """At most ``size`` counters: the one after them is taken off all. What is lost is known from the sums."""
    if len(counters) <= size:
        return counters
    least = sorted(counters.values(), reverse=True)[size]
    return Counter({item: n - least for item, n in counters.items() if n > least})


def _summaries(size: int, counted: bool):
    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, total = Counter(), 0
        for batch in batches:
            if counted:
                items, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                total += sum(t for t in batch.column(2).to_pylist())
            else:
                found = batch.column(0).value_counts()
                items, numbers = found.field(0).to_pylist(), found.field(1).to_pylist()
                total += batch.num_rows
            for item, n in zip(items, numbers):
                if item is not None:
                    counters[item] += n
            counters = _cut(counters, size)
        # The total stands in a row of its own.
        items = [None, *counters]
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.string()), pa.array([0, *counters.values()], pa.int64()), pa.array([total] + [0] * len(counters), pa.int64())],
            ["item", "n", "total"],
        )

    return summarised


def heavy_hitters(items: DataFrame, item: str, size: int) -> DataFrame:
    """``(item, n, total)``: at most ``size`` counters, each at most the true number; the null row has the total.

    Summaries of the tasks are merged in a tree. An item is counted short, or left out, by at most
    (total - sum of n) / (size + 1).
    """
    given = items.select(F.col(item).cast("string").alias("item")).dropna()
    parts = given.rdd.getNumPartitions()
    found = given.mapInArrow(_summaries(size, False), SCHEMA).withColumn("part", F.spark_partition_id())
    while parts > 1:
        parts = -(-parts // MERGED)
        found = materialise(found, "summaries")
        merged = found.repartition(parts, F.floor(F.col("part") / MERGED)).drop("part")
        found = merged.mapInArrow(_summaries(size, True), SCHEMA).withColumn("part", F.spark_partition_id())
    return materialise(found.drop("part"), "summary")


def most_frequent(items: DataFrame, item: str, k: int, size: int = 0, largest: int = 1 << 20) -> DataFrame:
    """``(item, n)``: the ``k`` most frequent items with their exact numbers, ties by item.

    A second pass counts the items of the summary. They hold the result if the k-th of them is more
    frequent than anything left out can be; if not, the summary is made four times as large. Beyond
    ``largest`` counters, where the k-th item is hardly more frequent than the rest, all items are
    counted by a shuffle. Nulls are not counted.
    """
    size = max(size or 20 * k, k)
    named = items.select(F.col(item).cast("string").alias("item")).dropna()
    while size <= largest:
        summary = heavy_hitters(items, item, size)
        sums = summary.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        missed = (sums.total - sums.n) // (size + 1)
        # At most ``size`` rows, and ``size`` is bounded.
        candidates = F.broadcast(summary.filter("item is not null").select("item"))
        counts = materialise(named.join(candidates, "item").groupBy("item").agg(F.count("*").alias("n")), "candidates")
        best = counts.orderBy(F.desc("n"), "item").limit(k)
        kth = best.agg(F.count("*").alias("rows"), F.min("n").alias("n")).first()
        if missed == 0 or kth.rows == k and kth.n > missed:
            return best
        size *= 4
    return named.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(k)

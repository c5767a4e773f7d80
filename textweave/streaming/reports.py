"""Report features and scores over a stream.

Tokens, report features and scoring with a fitted model look at one row at a time,
so the batch functions serve a stream unchanged and need no state or watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textweave.plans.linkage import report_features


def stream_features(reports: DataFrame, key: str = "crime_id") -> DataFrame:
    if not reports.isStreaming:
        raise ValueError("not a streaming table")
    return report_features(reports, key)


def write_available(stream: DataFrame, path: str, checkpoint: str, apply: Callable[[DataFrame], DataFrame] = stream_features) -> StreamingQuery:
    """Process all rows available now, append them as parquet, then stop."""
    return (
        apply(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start(path)
    )

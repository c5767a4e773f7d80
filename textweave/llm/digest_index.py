"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest: one row for each text ever kept. New rows
are reduced to one row for each digest (partial sums before the shuffle, so a text in a third
of all rows is one row for each task), joined to the index by sort-merge, which moves new rows
only, and the digests that the index lacks are appended.

Only digests are shuffled, never texts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.llm.tables import one_of_each
from textweave.llm.words import unused
from textweave.session import materialise, shared_path

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def text_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, digest)``: SHA-256 of each normalised text."""
    return docs.select(
        F.col(id_column).alias("id"), F.unhex(F.sha2(normalised(F.col(text_column)), 256)).alias("digest")
    )


@dataclass
class DigestIndex:
    """Digests kept so far, each with the id that stands for it."""

    spark: SparkSession
    table: str
    path: str
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """An empty index. ``buckets`` defaults to the session's shuffle partitions."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls.open(spark, path or shared_path(spark, "digest-index"), buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        """The index in ``path``, as an earlier session left it."""
        table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, table, path, buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """``(digest, keep_id)`` of the digests that the index lacks, with their smallest id."""
        first = digests.groupBy("digest").agg(F.min("id").cast("bigint").alias("keep_id"))
        return first.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def add(self, digests: DataFrame) -> None:
        """Append what is new. Running it again on the same rows adds nothing."""
        new = materialise(self.unseen(digests), "new-digests")
        (
            new.repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .mode("append")
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_column, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ``normalised``; the row with the smallest id of equal
    texts stays unless the index has the text already. The rows come to the index in two
    batches, smaller ids first, as a corpus that grows does.

    Null texts count as empty, and empty texts are equal to each other. A row with a null id stays
    only if no row with an id has its text; ``keep_id`` is then null. Rows with the same id, null
    too, and the same text are one document given twice; both are kept if one is.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    digests = materialise(text_digests(docs, id_column, text_column), "digests")
    middle = digests.agg(((F.min("id") / 2) + (F.max("id") / 2)).cast("bigint")).first()[0]
    early = F.col("id") <= F.lit(middle)
    for batch in (early, ~F.coalesce(early, F.lit(False))):
        index.add(digests.filter(batch))
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = materialise(sizes.hint("merge").join(index.rows(), "digest"), "groups")
    return digests.join(groups.hint("merge"), "digest").select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; one row of rows given twice.

    A row is told by its id and its digest, so one id may have several texts. A null id is an id
    like others here: such a row goes if a row with an id has its text.
    """
    digest = unused(docs, "digest")
    verdicts = deduplicate(docs, index, id_column, text_column).select(id_column, F.unhex("text_sha256").alias(digest), "kept")
    marked = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col(text_column)), 256)))
    return one_of_each(marked, [id_column, digest], verdicts).select(*docs.columns)

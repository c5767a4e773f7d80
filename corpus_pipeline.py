"""A training corpus from raw documents: five stages, each written and read again before the next.

Part of the subpackage ``textweave.llm``. Every stage takes all rows that its predecessor kept.
Empty tables pass through; null texts count as empty and null ids never match a label; extra
columns go through all stages but the last unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textweave.llm import ball_hashing, digest_index, ftrl_toxicity, soft_mixing, window_packing
from textweave.llm.tables import domains, load
from textweave.session import shared_path

#: Shares of the tokens that the domains should have. Rates stay between 1 and 4, so nothing is lost.
TARGETS = {"good": 0.9, "low": 0.1}
#: Documents with this score or more are rejected. Clean documents score far below.
REJECTED_FROM = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return ftrl_toxicity.keep_clean(docs, load(spark, sf_dir, "labels"), REJECTED_FROM)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return digest_index.keep_first(docs, digest_index.DigestIndex.create(spark))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ball_hashing.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the domains have their shares; every document stays at least once."""
    rated = soft_mixing.rates(docs, domains(load(spark, sf_dir, "labels")), TARGETS, least=1.0, most=4.0)
    return soft_mixing.mixed(docs, rated)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of the documents, one row for each piece."""
    return window_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing to target weights", mixing),
    ("packing", packing),
]

#: Classifiers, fingerprints and token ids have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the table ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text, its pairs of neighbours, and its pairs with one word between,
hashed into ``2 ** bits`` places; a feature counts once in a text. Each of a fixed number of
shards of the training sample is learned by its own task with per-coordinate rates and L1
shrinkage; the weights are averaged by coordinate. Shrinkage leaves few weights, at most
``2 ** bits``, so they can be sent to every task that scores.

McMahan et al., "Ad click prediction: a view from the trenches" (2013) gives the updates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.words import array_pieces, hashed, mixed, pieces, word_hashes
from textweave.session import materialise

WORD = re.compile(r"\w+")
_NEXT, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that are learned from: those whose hashed id is smallest.

    A shard learns features that at least ``least_seen`` of its texts have, with a shrinkage that
    grows with its rows.
    """

    sample_rows: int = 16_384
    shards: int = 2
    bits: int = 22
    alpha: float = 2.0
    beta: float = 1.0
    l1_per_row: float = 0.001
    l2: float = 0.0
    epochs: int = 10
    least_seen: int = 4


def word_features(words: np.ndarray, bits: int) -> np.ndarray:
    """Places of all n-grams and skip-grams of hashed words; row 0 words, 1 neighbours, 2 skips.

    A place is -1 where a pair would reach over the end.
    """
    out = np.full((3, len(words)), -1, np.int64)
    shift = np.uint64(64 - bits)
    out[0] = (mixed(words) >> shift).astype(np.int64)
    out[1, :-1] = (mixed(words[:-1] * _NEXT + words[1:]) >> shift).astype(np.int64)
    out[2, :-2] = (mixed(words[:-2] * _SKIP + words[2:]) >> shift).astype(np.int64)
    return out


def features_of(text: str, hashes, bits: int) -> np.ndarray:
    """Distinct places of one text."""
    found = word_features(hashed(WORD.findall(text.lower()), hashes), bits).ravel()
    return np.unique(found[found >= 0])


def learn(texts: list[str], labels: list[int], settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and bias after some passes over the texts in the given order."""
    hashes = word_hashes()
    l1 = max(0.5, settings.l1_per_row * len(texts))
    rows = [features_of(t, hashes, settings.bits).astype(np.int32) for t in texts]
    # Only places that enough texts have are kept, numbered in their order.
    places, seen = np.unique(np.concatenate([np.zeros(0, np.int32), *rows]), return_counts=True)
    places = places[seen >= settings.least_seen]
    after = np.r_[places, -1]  # a place beyond the last one is none of them
    for i, at in enumerate(rows):
        near = np.searchsorted(places, at)
        rows[i] = near[after[near] == at].astype(np.int32)
    z, n = np.zeros(len(places)), np.zeros(len(places))
    bias = squares = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        small = np.sign(own) * l1 - own
        return np.where(np.abs(own) <= l1, 0.0, small / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2))

    for _ in range(settings.epochs):
        for at, label in zip(rows, labels, strict=True):
            w = weights(at)
            gap = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
            more = (np.sqrt(n[at] + gap * gap) - np.sqrt(n[at])) / settings.alpha
            z[at] += gap - more * w
            n[at] += gap * gap
            squares += gap * gap
            bias -= settings.alpha / (settings.beta + np.sqrt(squares)) * gap
    at = np.flatnonzero(np.abs(z) > l1)
    return places[at].astype(np.int64), weights(at), bias


def fit(labelled: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> dict[int, float]:
    """Weights by place; the bias has the place -1.

    ``labelled`` is ``(doc_id, label)`` with labels 0 and 1 (others and nulls are left out). Without
    any usable row the weights are empty and every score is one half.
    """
    sample = (
        labelled.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(settings.sample_rows)
    )
    # The sample of (doc_id, label) has a bounded number of rows; texts are not moved to find it.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    order = F.xxhash64("doc_id", F.lit(1))
    rows = materialise(rows.select("doc_id", order.alias("place"), F.pmod(order, F.lit(settings.shards)).alias("shard"), "label", "text"), "toxicity-sample")

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["place", "doc_id", "text"])
        at, w, bias = learn(part["text"].tolist(), part["label"].tolist(), settings)
        return pd.DataFrame({"place": np.r_[-1, at], "weight": np.r_[bias, w] * len(part), "rows": len(part)})

    parts = rows.groupBy("shard").applyInPandas(shard, "place bigint, weight double, rows bigint")
    total = rows.count()
    means = parts.groupBy("place").agg((F.sum("weight") / F.lit(max(total, 1))).alias("weight"))
    # At most 2 ** bits rows, and in practice a few thousand.
    return {r["place"]: r["weight"] for r in means.collect()}


class Scorer:
    """Scores of texts, for use inside a task."""

    def __init__(self, weights: dict[int, float], bits: int) -> None:
        self.bits, self.bias = bits, weights.get(-1, 0.0)
        places = np.array(sorted(p for p in weights if p >= 0), np.int64)
        self.values = np.array([weights[int(p)] for p in places], np.float64)
        self.row = np.zeros(1 << bits, np.int32)
        self.row[places] = np.arange(1, len(places) + 1)
        self.hashes = word_hashes()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            found = word_features(hashed(WORD.findall((text or "").lower()), self.hashes), self.bits)
            at = self.row[found[found >= 0]]
            logits[i] += self.values[np.unique(at[at > 0]) - 1].sum()
        return 1 / (1 + np.exp(-np.clip(logits, -35, 35)))


def scored(docs: DataFrame, weights: dict[int, float], bits: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id_column, score)`` of every row in one pass without a shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, bits)
        for batch in batches:
            for piece in pieces(batch):
                scores = scorer.scores(piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores)], ["id", "score"])

    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return given.mapInArrow(score, f"id {dict(docs.dtypes)[id_column]}, score double").withColumnRenamed("id", id_column)


def keep_clean(docs: DataFrame, labels: DataFrame, rejected_from: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with a score below ``rejected_from``, all columns as they are, in one pass.

    Only the texts go to the workers; the other columns stay where they are.
    """
    weights = fit(usable(labels), docs, settings)

    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(weights, settings.bits)
        for part in texts:
            scores = [scorer.scores(piece.to_pylist()) for piece in array_pieces(part)]
            yield pa.array(np.concatenate([np.zeros(0), *scores]) < rejected_from)

    return docs.filter(F.arrow_udf(clean, "boolean")("text"))


def held_out(doc_id: Column) -> Column:
    """The fifth of all ids that is never learned from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def usable(labels: DataFrame) -> DataFrame:
    """``(doc_id, label)`` of the rows of ``labels (doc_id, toxic)`` that may be learned from."""
    return labels.select("doc_id", F.col("toxic").alias("label")).filter(~held_out(F.col("doc_id")))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Learned from the rows of ``labels (doc_id, toxic)`` that are not held out. A null or empty text
    has no features: its score is that of the bias. Rows given twice are scored twice, alike.
    An empty table gives an empty result; other columns are not read.
    """
    weights = fit(usable(labels), docs, settings)
    return scored(docs, weights, settings.bits).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

"""Collocation: word pairs scored by count, t-score and chi-square."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.functions.text import exploded
from textweave.session import materialise

COUNT, CHI_SQUARE, T_SCORE, CHI_SQUARE_FILTERED = 0, 1, 2, 3


def token_counts(df: DataFrame, tokens: str) -> DataFrame:
    """How often each token occurs in the corpus: ``(key, count)``."""
    return exploded(df, tokens, "key").groupBy("key").agg(F.count("*").alias("count"))


def _adjacent(df: DataFrame, tokens: str) -> DataFrame:
    """Distinct ``(w1, w2)`` with ``n`` occurrences as a pair and ``n_words`` of w1.

    The last token of a text is kept with an empty successor and counts for
    ``n_words`` only. One pass over the texts thus yields pair and word counts.
    """
    words = F.col(tokens)
    followers = F.slice(words, 2, F.size(words))
    rows = df.select(F.inline_outer(F.arrays_zip(words, followers)).alias("w1", "next"))
    return (
        rows.where("w1 is not null")
        .select("w1", F.coalesce("next", F.lit("")).alias("w2"), F.col("next").isNotNull().cast("bigint").alias("pair"))
        .groupBy("w1", "w2")
        .agg(F.sum("pair").alias("n"), F.count("*").alias("n_words"))
    )


def t_score(pair: Column, c1: Column, c2: Column, pairs: Column, words: Column) -> Column:
    observed = pair / pairs
    expected = (c1 / words) * (c2 / words)
    return (observed - expected) / F.sqrt(observed / pairs)


def chi_square(pair: Column, c1: Column, c2: Column, pairs: Column, words: Column) -> Column:
    """Chi-square of the 2x2 table; null where a margin is zero.

    The fourth cell is taken from the number of pairs and the scale from the
    number of words. Doubles throughout: the products overflow a bigint.
    """
    both = pair.cast("double")
    first, second = c1 - both, c2 - both
    neither = pairs - both - first - second
    margins = (both + first) * (both + second) * (first + neither) * (second + neither)
    return F.try_divide(words * F.pow(both * neither - first * second, F.lit(2.0)), margins)


def collocations(
    df: DataFrame, input_col: str = "tokens", sorting_type: int | None = COUNT, cutoff: int = 50
) -> DataFrame:
    """The ``cutoff`` strongest word pairs: ``Bigram, Count, tScore, chiScore``.

    Sorted by count (0), chi-square (1), t-score (2) or chi-square below the
    number of pairs (3); ties go to the alphabetically first pair.
    """
    if sorting_type not in (COUNT, CHI_SQUARE, T_SCORE, CHI_SQUARE_FILTERED):
        raise ValueError(f"unknown sorting type: {sorting_type!r}")
    # Three branches read this aggregate; written once, the texts are read once.
    adjacent = materialise(_adjacent(df, input_col), "adjacent")
    totals = adjacent.agg(
        F.struct(F.sum("n").cast("double").alias("pairs"), F.sum("n_words").cast("double").alias("words"))
    ).scalar()
    words = adjacent.groupBy("w1").agg(F.sum("n_words").alias("c"))
    pairs = adjacent.where("n > 0").select("w1", "w2", "n", F.concat_ws(" ", "w1", "w2").alias("Bigram"))

    if sorting_type == COUNT:
        # Counts need no scores: cut first, so only the kept pairs are joined.
        pairs = pairs.orderBy(F.desc("n"), "Bigram", "w1").limit(cutoff)
    scored = (
        pairs.join(words.select("w1", F.col("c").alias("c1")), "w1")
        .join(words.select(F.col("w1").alias("w2"), F.col("c").alias("c2")), "w2")
        .select("Bigram", "n", "c1", "c2", totals.getField("pairs").alias("b"), totals.getField("words").alias("w"))
    )
    cells = [F.col(c) for c in ("n", "c1", "c2", "b", "w")]
    scored = scored.select(
        "Bigram", F.col("n").alias("Count"), t_score(*cells).alias("tScore"), chi_square(*cells).alias("chiScore"), "b"
    )
    if sorting_type == CHI_SQUARE_FILTERED:
        scored = scored.where("chiScore < b")
    measure = {COUNT: "Count", T_SCORE: "tScore"}.get(sorting_type, "chiScore")
    return scored.orderBy(F.desc(measure), "Bigram").limit(cutoff).drop("b")

"""Token, sentence and stem expressions over text columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.functions import porter

# The ASCII punctuation marks that normalising deletes, the quotation marks
# it sets apart, the fused words it splits, and white space beyond the ASCII blanks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
QUOTES = "([«“‘„»”’])"
FUSED = r"(?<![^\s])(?:(can)(not)|(gim|lem)(me)|(gon|wan)(na)|(got)(ta))(?![^\s])"
BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def regex_tokens(text: Column, pattern: str = r"\s+") -> Column:
    """Lower-cased pieces between matches of ``pattern``, empty pieces dropped."""
    return F.filter(F.split(F.lower(text), pattern), lambda w: w != "")


def exploded(df: DataFrame, tokens: str, name: str, *keys: str | Column) -> DataFrame:
    """``(keys…, name)``: one row for each token.

    A plain explode makes the optimizer filter out empty lists first, for which it
    would compute the tokens of every text twice.
    """
    return df.select(*keys, F.explode_outer(tokens).alias(name)).where(F.col(name).isNotNull())


def normalised_tokens(text: Column) -> Column:
    """Lower-case, delete punctuation, split into words, drop empty ones."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    spaced = F.regexp_replace(F.regexp_replace(plain, QUOTES, " $1 "), BLANKS, " ")
    split_up = F.regexp_replace(spaced, FUSED, "$1$3$5$7 $2$4$6$8")
    return F.filter(F.split(split_up, " "), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(text, r"(?<=[.!?])\s+")


@F.pandas_udf(T.StringType())
def stem_word(words: pd.Series) -> pd.Series:
    return words.map(porter.stem, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_words(lists: pd.Series) -> pd.Series:
    return lists.map(lambda words: [porter.stem(w) for w in words], na_action="ignore")


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Runs of ``n`` tokens joined by a space; none if the list is shorter than ``n``."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))

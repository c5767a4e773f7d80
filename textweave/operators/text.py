"""Text transformers and token tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover, Tokenizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.functions import text as tx
from textweave.operators.checks import require_column, require_new_column

# Words left out of the list of stolen property. "propertypolice" is one
# entry of the form's list; read as two it would remove both "property" and "police".
NOT_PROPERTY = [
    "modus", "operandi", "call", "with", "list", "of", "location", "point", "entry", "value", "propertypolice",
    "stage", "name", "details", "insured", "victim", "address",
]
NOUN_TAGS = ["NN", "NNS"]
PROPERTY_LISTS = "PROPERTY LIST SUMMARY:|PROPERTY STOLEN:"


class NormalizingTokenizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Lower-case, delete punctuation, split, drop empty tokens, stem."""

    stem = Param(Params._dummy(), "stem", "reduce tokens to their stems", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="tokens", stem=True):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="tokens", stem=True)
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCol=None, outputCol=None, stem=None):
        return self._set(**self._input_kwargs)

    def _transform(self, dataset):
        require_column(dataset, self.getInputCol(), "string")
        tokens = tx.normalised_tokens(F.col(self.getInputCol()))
        if self.getOrDefault(self.stem):
            tokens = tx.stem_words(tokens)
        return dataset.withColumn(self.getOutputCol(), tokens)


def _checked(df: DataFrame, stage, dtype: str) -> DataFrame:
    require_column(df, stage.getInputCol(), dtype)
    require_new_column(df, stage.getOutputCol())
    return stage.transform(df)


def tokenize(df: DataFrame, input_col: str = "text", output_col: str = "tokens") -> DataFrame:
    """Lower-case and split at each white-space character; null text is taken as empty."""
    return _checked(df.na.fill("", [input_col]), Tokenizer(inputCol=input_col, outputCol=output_col), "string")


def regex_tokenize(
    df: DataFrame, input_col: str = "text", output_col: str = "tokens", pattern: str = r"\s+",
    min_token_length: int = 1, gaps: bool = True, to_lowercase: bool = True,
) -> DataFrame:
    stage = RegexTokenizer(
        inputCol=input_col, outputCol=output_col, pattern=pattern, minTokenLength=min_token_length, gaps=gaps,
        toLowercase=to_lowercase,
    )
    return _checked(df.na.fill("", [input_col]), stage, "string")


def normalise(df: DataFrame, input_col: str = "text", output_col: str = "tokens", stem: bool = True) -> DataFrame:
    return _checked(df, NormalizingTokenizer(inputCol=input_col, outputCol=output_col, stem=stem), "string")


def remove_stop_words(
    df: DataFrame, input_col: str = "text", output_col: str = "tokens", stop_words: Sequence[str] | None = None,
    case_sensitive: bool = False,
) -> DataFrame:
    words = list(stop_words) if stop_words is not None else StopWordsRemover.loadDefaultStopWords("english")
    stage = StopWordsRemover(inputCol=input_col, outputCol=output_col, stopWords=words, caseSensitive=case_sensitive)
    return _checked(df, stage, "array<string>")


def ngram(df: DataFrame, input_col: str = "text", output_col: str = "tokens", n: int = 2) -> DataFrame:
    return _checked(df, NGram(n=n, inputCol=input_col, outputCol=output_col), "array<string>")


def stem_counts(counts: DataFrame, word: str = "key", count: str = "count") -> DataFrame:
    """Counts by word to counts by stem; each distinct word is stemmed once."""
    return counts.groupBy(tx.stem_word(word).alias("stem")).agg(F.sum(count).alias("count"))


def train_tagger(tagged: DataFrame, token: str = "token", tag: str = "tag") -> DataFrame:
    """Most frequent tag of each token, the alphabetically first on a tie: ``(token, tag)``."""
    counts = tagged.groupBy(F.col(token).alias("token"), F.col(tag).alias("tag")).agg(F.count("*").alias("n"))
    return counts.groupBy("token").agg(F.min(F.struct(-F.col("n"), F.col("tag")))["tag"].alias("tag"))


def tag_tokens(df: DataFrame, key: Sequence[str], tokens: str, tags: DataFrame) -> DataFrame:
    """``(key…, pos, token, tag)``; the tag is null for a token the tagger has not seen."""
    placed = df.select(*key, F.posexplode_outer(tokens).alias("pos", "token")).where("token is not null")
    return placed.join(tags, "token", "left").select(
        *key, "pos", "token", "tag"
    )


def lemmatize(
    df: DataFrame, key: str, tokens: str, lemmas: DataFrame, output_col: str = "lemmas"
) -> DataFrame:
    """``(key, output_col)``: each token replaced by its lemma in ``lemmas`` ``(token, lemma)``, if it has one.

    ``key`` is unique. The lemmas are the caller's table; a text keeps its own tokens, in order.
    """
    found = tag_tokens(df, [key], tokens, lemmas.select("token", F.col("lemma").alias("tag")))
    placed = F.struct("pos", F.coalesce("tag", "token").alias("word"))
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(placed))["word"].alias(output_col))
    return df.select(key).join(lists, key, "left").withColumn(
        output_col, F.coalesce(output_col, F.array().cast("array<string>"))
    )


def stolen_property(
    df: DataFrame, key: str, narrative: str, tags: DataFrame, output_col: str = "propertyStolenWordnet",
    stem: bool = True, fix_removal_list: bool = False,
) -> DataFrame:
    """Nouns of the property lists in a narrative: ``(key, output_col)`` for every row.

    From each part of the text around a list heading, the words before the first
    colon or underscore are normalised and tagged; nouns of three letters or more
    stay, in text order.
    """
    removed = list(NOT_PROPERTY)
    if fix_removal_list:
        removed = [w for w in removed if w != "propertypolice"] + ["property", "police"]
    listed = F.transform(F.split(narrative, PROPERTY_LISTS), lambda part: F.split(part, "[:_]")[0])
    text = F.when(F.col(narrative).contains("PROPERTY"), F.array_join(listed, " ")).otherwise("")
    words = normalise(df.select(key, text.alias("_listed")), "_listed", "_words", stem)
    nouns = (
        words.select(key, F.posexplode_outer("_words").alias("pos", "token"))
        .where((F.length("token") >= 3) & ~F.col("token").isin(removed))
        .join(tags.where(F.col("tag").isin(NOUN_TAGS)), "token")
    )
    # A list holds the words of one narrative at most.
    lists = nouns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token")))["token"].alias(output_col))
    return df.select(key).join(lists, key, "left").withColumn(
        output_col, F.coalesce(output_col, F.array().cast("array<string>"))
    )

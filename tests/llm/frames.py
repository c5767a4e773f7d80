"""Small tables with every awkward case, for the tests of this folder."""

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    """``documents`` from ``(doc_id, text)``."""
    full = [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """With columns named like those that operators use inside."""
    names = ["id", "key", "value", "digest", "rank", "label", "node", "_id", "_key", "mix_id", "mix_key", "mix_times", "word", "bucket", "score", "fingerprint", "rate"]
    return df.withColumns({n: F.lit(n) for n in names if n not in df.columns})


def odd(spark, long_words=30_000):
    """Nulls, blanks, ties, rows given twice, a very long text."""
    long_text = " ".join(f"w{i % 997}x{i % 13}" for i in range(long_words))
    return clashing(
        docs(
            spark,
            [
                (1, None),
                (2, ""),
                (3, " \t\n "),
                (4, "one two"),
                (4, "one two"),
                (5, "one\ttwo"),
                (6, long_text),
                (7, "ünïcödé 日本語 🎉 <|endoftext|> tail"),
                (None, "no id here"),
                (8, "a" * 5000),
            ],
        )
    )

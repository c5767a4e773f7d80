"""Mixing documents to target weights by soft membership.

A naive Bayes classifier learned from a labelled table gives every document its posterior over
domains. Document rates are then fitted by projected-gradient least squares, so that the expected
tokens of each domain, rate x tokens x posterior summed over the documents, meet the targets.
Rates stay between given bounds, zero below by default.

With posteriors p, tokens t and rates r, the totals are m = sum t r p, and G = sum t p p' is how
much they move when rates move along p. The squares (m - T)' G^-1 (m - T) are reduced in the
metric that weighs documents by their tokens; there a step of length 1 never overshoots, without
the bounds one step is exact, and the rate of a document depends on its posterior only. Where
bounds hold rates back, a longer step is tried first, measured by the rates that can still move,
and taken if it brings the totals closer. Each step is an aggregation to a few numbers; everything
else stays in the cluster.

DataFrame expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.words import unused
from textweave.session import materialise

BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that the classifier is learned from (smallest hashed ids).

    ``buckets`` bounds the classifier, a table of that many rows. The evidence of a text counts as
    that of at most ``evidence_words`` words, as words of a text depend on each other; a share of
    ``doubt`` of each posterior is the prior, as labels are not always right.
    """

    sample_rows: int = 16_384
    buckets: int = 32_768
    smoothing: float = 0.1
    evidence_words: float = 32.0
    doubt: float = 0.01
    steps: int = 30
    tolerance: float = 1e-4


def _words(docs: DataFrame, *columns: str) -> DataFrame:
    """One row for each word with its bucket, and one for a text without words."""
    words = F.split(F.trim(F.regexp_replace("text", BLANKS, " ")), " ")
    return docs.select(*columns, F.posexplode(words).alias("at", "word"))


def _bucket(settings: Settings) -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(settings.buckets)).cast("int")


def classifier(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], settings: Settings = Settings()) -> tuple[DataFrame, list[float]]:
    """Log-likelihoods ``(bucket, likelihoods)`` of all buckets, and the log-priors of the domains.

    ``labelled`` is ``(doc_id, domain)``. A domain without labelled rows has the smoothed prior and
    even likelihoods.
    """
    sample = (
        labelled.filter(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "domain")
        .limit(settings.sample_rows)
    )
    # At most sample_rows rows of (doc_id, domain).
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    counts = _words(rows, "domain").filter("word <> ''").groupBy(_bucket(settings).alias("bucket"), "domain").count()
    counts = materialise(counts.groupBy("bucket").pivot("domain", list(domains)).sum("count").na.fill(0), "domain-words")
    known = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    totals = counts.agg(*[F.coalesce(F.sum(F.col(f"`{d}`")), F.lit(0)) for d in domains]).first()
    n_rows = sum(known.values())
    priors = [F.log(F.lit((known.get(d, 0) + 1) / (n_rows + len(domains)))) for d in domains]
    likelihoods = [
        F.log(
            (F.coalesce(F.col(f"`{d}`"), F.lit(0)) + settings.smoothing) / F.lit(total + settings.smoothing * settings.buckets)
        )
        for d, total in zip(domains, totals, strict=True)
    ]
    spark = docs.sparkSession
    grid = spark.range(settings.buckets).select(F.col("id").cast("int").alias("bucket"))
    return grid.join(counts, "bucket", "left").select("bucket", F.array(*likelihoods).alias("likelihoods")), priors


def posteriors(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, key, copies, n_tokens, posterior)``, one row for each id and text.

    ``key`` is a hash of the text, ``copies`` how many rows have this id and text, ``n_tokens`` the
    words of one of them, ``posterior`` an array in the order of ``domains``.
    """
    model, priors = classifier(docs, labelled, domains, settings)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    words = _words(rows, "doc_id", "key").withColumn("bucket", _bucket(settings))
    real = (F.col("word") != "").cast("int")
    # The model has a fixed number of rows.
    sums = (
        words.join(F.broadcast(model), "bucket")
        .groupBy("doc_id", "key")
        .agg(
            F.sum((F.col("at") == 0).cast("bigint")).alias("copies"),
            F.sum(real).alias("words"),
            *[F.sum(real * F.col("likelihoods")[k]).alias(f"log{k}") for k in range(len(domains))],
        )
    )
    scale = F.least(F.lit(settings.evidence_words) / F.greatest("words", F.lit(1)), F.lit(1.0) / F.col("copies"))
    logs = F.array(*[p + F.col(f"log{k}") * scale for k, p in enumerate(priors)])
    weights = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    likely = F.transform("weights", lambda x: x / total)
    prior = F.array(*[F.exp(p) for p in priors])
    posterior = F.zip_with(likely, prior, lambda x, p: (1 - settings.doubt) * x + settings.doubt * p)
    return (
        sums.withColumn("logs", logs)
        .withColumn("weights", weights)
        .select(
            "doc_id",
            "key",
            "copies",
            (F.col("words") / F.col("copies")).cast("bigint").alias("n_tokens"),
            posterior.alias("posterior"),
        )
    )


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small linear system, by elimination with pivots."""
    n = len(right)
    rows = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    for i in range(n):
        best = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for j in range(n):
            if j != i and rows[i][i]:
                f = rows[j][i] / rows[i][i]
                rows[j] = [a - f * b for a, b in zip(rows[j], rows[i], strict=True)]
    return [row[n] / row[i] if row[i] else 0.0 for i, row in enumerate(rows)]


def fitted_rates(
    members: DataFrame, targets: Mapping[str, float], least: float = 0.0, most: float = math.inf, budget: float | None = None, settings: Settings = Settings()
) -> DataFrame:
    """``members`` (see ``posteriors``, domains in the order of ``targets``) with the column ``rate``,
    and in each row ``aims``, the wanted tokens of each domain, and ``reached``, those that the rates give.

    ``budget`` is the wanted number of expected tokens, by default those there are; if rates may not
    fall below one, it is the least number with which no domain has to shrink. Targets out of reach
    are approached as far as the bounds allow. Without tokens every rate is one.
    """
    k = len(targets)
    p = [F.col("posterior")[i] for i in range(k)]
    tokens = (F.col("n_tokens") * F.col("copies")).cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = members.agg(*[F.sum(tokens * x) for x in p], *[F.sum(tokens * p[i] * p[j]) for i, j in pairs]).first()
    have = [x or 0.0 for x in found[:k]]
    total = sum(have)
    if not total:
        nothing = F.array(*[F.lit(0.0)] * k)
        return members.withColumns({"rate": F.lit(1.0), "aims": nothing, "reached": nothing})
    shares = [w / sum(targets.values()) for w in targets.values()]
    if budget is None:
        budget = max((h / s for h, s in zip(have, shares, strict=True) if s), default=total) if least >= 1 else total
    aims = [s * budget for s in shares]

    def square(values: Sequence[float]) -> list[list[float]]:
        out = [[0.0] * k for _ in range(k)]
        for (i, j), x in zip(pairs, values, strict=True):
            out[i][j] = out[j][i] = (x or 0.0) + (i == j) * 1e-9 * total
        return out

    metric = square(found[k:])

    def measured(rate: Column) -> tuple[list[float], list[list[float]]]:
        """Gaps to the targets, and how much the rates that are not at a bound can move the totals."""
        rated = members.withColumn("rate", rate)
        free = F.when((F.col("rate") > least) & (F.col("rate") < most), tokens).otherwise(0.0)
        sums = rated.agg(*[F.sum(tokens * F.col("rate") * x) for x in p], *[F.sum(free * p[i] * p[j]) for i, j in pairs]).first()
        return [n - a for n, a in zip(sums[:k], aims, strict=True)], square(sums[k:])

    def moved(rate: Column, step: Sequence[float]) -> Column:
        along = sum((x * F.lit(y) for x, y in zip(p, step, strict=True)), F.lit(0.0))
        return F.greatest(F.lit(least), F.least(F.lit(most), rate - along))

    def size(gaps: Sequence[float]) -> float:
        return sum(g * x for g, x in zip(gaps, solved(metric, gaps), strict=True))

    rate = F.lit(float(min(max(1.0, least), most)))
    gaps, free = measured(rate)
    for _ in range(settings.steps):
        if max(map(abs, gaps)) <= settings.tolerance * budget:
            break
        blend = [[f + 0.05 * m for f, m in zip(*rows, strict=True)] for rows in zip(free, metric, strict=True)]
        longer = moved(rate, solved(blend, gaps))
        new_gaps, new_free = measured(longer)
        if size(new_gaps) < size(gaps):
            rate = longer
        else:
            rate = moved(rate, solved(metric, gaps))
            new_gaps, new_free = measured(rate)
        done = size(gaps) - size(new_gaps) <= 1e-6 * size(gaps)
        gaps, free = new_gaps, new_free
        if done:
            break
    reached = F.array(*[F.lit(g + a) for g, a in zip(gaps, aims, strict=True)])
    return members.withColumns({"rate": rate, "aims": F.array(*map(F.lit, aims)), "reached": reached})


def rates(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], least: float = 0.0, most: float = math.inf, budget: float | None = None, settings: Settings = Settings()
) -> DataFrame:
    """``(doc_id, key, copies, n_tokens, posterior, rate, aims, reached)`` for each id and text of ``docs (doc_id, text)``.

    ``labelled`` is ``(doc_id, domain)``; ``targets`` gives the wanted share of each domain. Null and
    empty texts have no tokens: their posterior is the prior. Rows given twice are one row here with
    ``copies`` of 2. Null ids are kept; an empty table gives an empty result; other columns of the
    tables are not read. Labels of other domains and null labels are left out.
    """
    members = materialise(posteriors(docs, labelled, list(targets), settings), "posteriors")
    return fitted_rates(members, targets, least, most, budget, settings)


def mixed(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """``docs`` with each row repeated as its rate says, all columns as they are.

    A rate of 2.3 gives two copies, and a third one for three in ten documents, drawn by a hash of
    id and text, so that a run repeated gives the same rows.
    """
    own_id, own_key, given_key, times, copy = (unused(docs, n) for n in ("mix_id", "mix_key", "mix_given", "mix_times", "mix_copy"))
    chance = F.pmod(F.xxhash64(own_id, own_key, F.lit(7)), F.lit(1_000_000)) / 1_000_000
    whole = F.floor("rate")
    wanted = (
        rated.select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), "rate")
        .withColumn(times, (whole + (chance < F.col("rate") - whole).cast("int")).cast("int"))
        .drop("rate")
        .filter(F.col(times) > 0)
    )
    keyed = docs.withColumn(given_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(given_key) == F.col(own_key))
    joined = keyed.join(wanted.hint("merge"), same)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)

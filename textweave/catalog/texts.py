"""Tokens, stems, tags, n-grams, frequencies, collocations."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.catalog.common import SQL_TOKENS, digest, documents, load, rounded, tokens
from textweave.functions import text as tx
from textweave.operators import text
from textweave.plans import collocation


def _fingerprint(df: DataFrame, column: str = "tokens") -> DataFrame:
    return df.select("doc_id", F.size(column).alias("n_tokens"), digest(column).alias("digest"))


def tokenize_simple(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprint(text.tokenize(documents(spark, sf)))


def tokenize_regex(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprint(text.regex_tokenize(documents(spark, sf)))


def tokenize_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprint(text.normalise(documents(spark, sf), stem=False))


def tokenize_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprint(text.normalise(documents(spark, sf)))


def stem_frequency(spark: SparkSession, sf: str) -> DataFrame:
    words = documents(spark, sf).select(tx.normalised_tokens(F.col("text")).alias("tokens"))
    return text.stem_counts(collocation.token_counts(words, "tokens"))


def stop_words(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprint(text.remove_stop_words(tokens(spark, sf), "tokens", "kept"), "kept")


def ngram2(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprint(text.ngram(tokens(spark, sf), "tokens", "pairs"), "pairs")


def ngram3(spark: SparkSession, sf: str) -> DataFrame:
    runs = tokens(spark, sf).withColumn("runs", tx.ngrams(F.col("tokens"), 3))
    return _fingerprint(runs, "runs")


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = documents(spark, sf).select("doc_id", tx.sentences(F.col("text")).alias("parts"))
    return _fingerprint(parts, "parts")


def _tagged_turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = load(spark, sf, "conversations").select("conv_id", "turn", "role", tx.regex_tokens(F.col("text")).alias("tokens"))
    return tx.exploded(turns, "tokens", "token", "conv_id", "turn", F.col("role").alias("tag"))


def tagger_train(spark: SparkSession, sf: str) -> DataFrame:
    return text.train_tagger(_tagged_turns(spark, sf))


def tagger_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of all document tokens, counted for each document."""
    tagged = text.tag_tokens(tokens(spark, sf), ["doc_id"], "tokens", tagger_train(spark, sf))
    return tagged.groupBy("doc_id", F.coalesce("tag", F.lit("none")).alias("tag")).agg(
        F.count("*").alias("n"), F.sum("pos").alias("positions")
    )


def lemmatized(spark: SparkSession, sf: str) -> DataFrame:
    """Words with a final s to the word without it, where the texts have that word too."""
    docs = tokens(spark, sf)
    words = collocation.token_counts(docs, "tokens").select(F.col("key").alias("token"))
    plurals = words.where("token like '_%s'").withColumn("lemma", F.expr("left(token, length(token) - 1)"))
    lemmas = plurals.join(words.withColumnRenamed("token", "lemma"), "lemma", "left_semi")
    return _fingerprint(text.lemmatize(docs, "doc_id", "tokens", lemmas, "lemmas"), "lemmas")


def stolen_property(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "part")
    narratives = parts.select(
        "p_partkey",
        F.concat(
            F.lit("ENTRY BY DOOR. PROPERTY LIST SUMMARY: "), F.upper("p_name"), F.lit(" AND CALL WITH VALUE: UNKNOWN "),
            F.lit("PROPERTY STOLEN:"), F.col("p_name"), F.lit(", THE LIST_"), F.col("p_brand"),
        ).alias("narrative"),
    )
    words = parts.select(F.posexplode(F.split("p_name", " ")).alias("pos", "token"))
    tags = text.train_tagger(words.select("token", F.when(F.col("pos") == 0, "JJ").otherwise("NN").alias("tag")))
    found = text.stolen_property(narratives, "p_partkey", "narrative", tags, stem=False)
    return found.select("p_partkey", F.array_join("propertyStolenWordnet", " ").alias("nouns"))


def token_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return collocation.token_counts(tokens(spark, sf), "tokens")


def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tokens(spark, sf).select(F.size("tokens").cast("bigint").alias("n"))
    return sizes.agg(F.sum("n").alias("n_words"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("n_pairs"))


def collocations(mode: int, spark: SparkSession, sf: str) -> DataFrame:
    found = collocation.collocations(tokens(spark, sf), "tokens", mode)
    return found.select("Bigram", "Count", rounded("tScore"), rounded("chiScore", 3))


QUERIES = {
    "tokenize_simple": tokenize_simple,
    "tokenize_regex": tokenize_regex,
    "tokenize_normalised": tokenize_normalised,
    "tokenize_stemmed": tokenize_stemmed,
    "stem_frequency": stem_frequency,
    "stop_words": stop_words,
    "ngram2": ngram2,
    "ngram3": ngram3,
    "sentence_split": sentence_split,
    "tagger_train": tagger_train,
    "tagger_apply": tagger_apply,
    "lemmatized": lemmatized,
    "stolen_property": stolen_property,
    "token_frequency": token_frequency,
    "corpus_totals": corpus_totals,
    "collocation_count": partial(collocations, collocation.COUNT),
    "collocation_chi": partial(collocations, collocation.CHI_SQUARE),
    "collocation_t": partial(collocations, collocation.T_SCORE),
    "collocation_chi_filtered": partial(collocations, collocation.CHI_SQUARE_FILTERED),
}

# The English stop words of Spark ML.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it "
    "its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd "
    "they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't "
    "hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's "
    "ought that's there's what's when's where's who's why's would"
).split()


def _sql_fingerprint(expression: str) -> str:
    return f"""
        select doc_id, cast(len(tokens) as integer) as n_tokens, md5(array_to_string(tokens, chr(31))) as digest
        from (select doc_id, {expression} as tokens from documents)"""


def _sql_runs(n: int) -> str:
    run = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
    return f"""
        select doc_id, cast(len(runs) as integer) as n_tokens, md5(array_to_string(runs, chr(31))) as digest
        from (select doc_id, list_transform(range(1, len(t) - {n - 2}), lambda i: {run}) as runs
              from (select doc_id, {SQL_TOKENS} as t from documents))"""


_PUNCTUATION = tx.PUNCTUATION.replace("'", "''")
_SPACED = (
    f"regexp_replace(regexp_replace(translate(lower(text), '{_PUNCTUATION}', ''), '{tx.QUOTES}', ' \\1 ', 'g'),"
    r" '[\s\x0b\x1c-\x1f\x85\pZ]+', ' ', 'g')"
)
_FUSED = "flatten(list_transform(string_split({0}, ' '), lambda w: case w {1} else [w] end))".format(
    _SPACED,
    " ".join(
        f"when '{a}{b}' then ['{a}', '{b}']"
        for a, b in [("can", "not"), ("gim", "me"), ("lem", "me"), ("gon", "na"), ("wan", "na"), ("got", "ta")]
    ),
)

_TAG_COUNTS = f"""
    counts as (select token, tag, count(*) as n
               from (select unnest({SQL_TOKENS}) as token, role as tag from conversations) group by token, tag),
    tags as (select token, arg_min(tag, (-n, tag)) as tag from counts group by token)"""

_PAIRS = f"""
    with texts as (select {SQL_TOKENS} as t from documents),
    words as (select w, count(*) as c from (select unnest(t) as w from texts) group by w),
    runs as (select unnest(list_transform(range(1, len(t)), lambda i: {{{{'w1': t[i], 'w2': t[i + 1]}}}})) as p from texts),
    pairs as (select p.w1 as w1, p.w2 as w2, cast(count(*) as double) as n from runs group by p.w1, p.w2),
    totals as (select (select sum(c) from words)::double as all_words, (select sum(n) from pairs)::double as b),
    cells as (select w1 || ' ' || w2 as bigram, n, x.c::double as c1, y.c::double as c2, all_words, b
              from pairs join words x on x.w = w1 join words y on y.w = w2, totals),
    scored as (
        select bigram, n, b, (n / b - (c1 / all_words) * (c2 / all_words)) / sqrt(n / b / b) as t,
               all_words * power(n * (b - n - (c1 - n) - (c2 - n)) - (c1 - n) * (c2 - n), 2)
               / nullif(c1 * c2 * ((c1 - n) + (b - n - (c1 - n) - (c2 - n))) * ((c2 - n) + (b - n - (c1 - n) - (c2 - n))), 0) as chi
        from cells)
    select bigram as "Bigram", cast(n as bigint) as "Count", round(t, 6) as "tScore", round(chi, 3) as "chiScore"
    from scored {{}} limit 50"""

ORACLES = {
    "tokenize_simple": _sql_fingerprint(r"string_split_regex(regexp_replace(lower(text), '\s+$', ''), '\s')"),
    "tokenize_regex": _sql_fingerprint(SQL_TOKENS),
    "tokenize_normalised": _sql_fingerprint(f"list_filter({_FUSED}, lambda w: w <> '')"),
    "stop_words": _sql_fingerprint(
        "list_filter({0}, lambda w: not list_contains([{1}], w))".format(
            SQL_TOKENS, ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
        )
    ),
    "ngram2": _sql_runs(2),
    "ngram3": _sql_runs(3),
    "sentence_split": _sql_fingerprint(r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"),
    "tagger_train": f"with {_TAG_COUNTS} select token, tag from tags",
    "tagger_apply": f"""
        with {_TAG_COUNTS},
        listed as (select doc_id, {SQL_TOKENS} as t from documents),
        placed as (select doc_id, unnest(t) as token, unnest(range(len(t))) as pos from listed)
        select doc_id, coalesce(tag, 'none') as tag, count(*) as n, cast(sum(pos) as bigint) as positions
        from placed left join tags using (token) group by 1, 2""",
    "lemmatized": f"""
        with listed as (select doc_id, {SQL_TOKENS} as t from documents),
        placed as (select doc_id, unnest(t) as token, unnest(range(len(t))) as pos from listed),
        words as (select distinct token from placed),
        lemmas as (select token, left(token, length(token) - 1) as lemma from words
                   where token like '_%s' and left(token, length(token) - 1) in (select token from words)),
        replaced as (select doc_id, count(*) as n, string_agg(coalesce(lemma, token), chr(31) order by pos) as joined
                     from placed left join lemmas using (token) group by doc_id)
        select doc_id, cast(coalesce(n, 0) as integer) as n_tokens, md5(coalesce(joined, '')) as digest
        from documents left join replaced using (doc_id)""",
    "stolen_property": """
        with words as (select unnest(string_split(p_name, ' ')) as token, unnest(range(len(string_split(p_name, ' ')))) as pos
                       from part),
        counts as (select token, case when pos = 0 then 'JJ' else 'NN' end as tag, count(*) as n from words group by 1, 2),
        tags as (select token, arg_min(tag, (-n, tag)) as tag from counts group by token),
        texts as (select p_partkey, 'ENTRY BY DOOR. PROPERTY LIST SUMMARY: ' || upper(p_name) || ' AND CALL WITH VALUE: UNKNOWN '
                         || 'PROPERTY STOLEN:' || p_name || ', THE LIST_' || p_brand as narrative from part),
        listed as (select p_partkey, array_to_string(list_transform(
                       string_split_regex(narrative, 'PROPERTY LIST SUMMARY:|PROPERTY STOLEN:'),
                       lambda x: regexp_extract(x, '^[^:_]*')), ' ') as listed from texts),
        placed as (select p_partkey, unnest(w) as token, unnest(range(len(w))) as pos
                   from (select p_partkey, string_split(regexp_replace(lower(listed), '[[:punct:]]', '', 'g'), ' ') as w from listed)),
        nouns as (select p_partkey, string_agg(token, ' ' order by pos) as nouns from placed join tags using (token)
                  where tag in ('NN', 'NNS') and length(token) >= 3 and token not in ('modus', 'operandi', 'call', 'with',
                  'list', 'of', 'location', 'point', 'entry', 'value', 'propertypolice', 'stage', 'name', 'details',
                  'insured', 'victim', 'address') group by p_partkey)
        select p_partkey, coalesce(nouns, '') as nouns from part left join nouns using (p_partkey)""",
    "token_frequency": f"""
        select key, count(*) as count from (select unnest({SQL_TOKENS}) as key from documents) group by key""",
    "corpus_totals": f"""
        select cast(sum(n) as bigint) as n_words, cast(sum(greatest(n - 1, 0)) as bigint) as n_pairs
        from (select len({SQL_TOKENS}) as n from documents)""",
    "collocation_count": _PAIRS.format("order by n desc, bigram"),
    "collocation_chi": _PAIRS.format("order by chi desc nulls last, bigram"),
    "collocation_t": _PAIRS.format("order by t desc, bigram"),
    "collocation_chi_filtered": _PAIRS.format("where chi < b order by chi desc, bigram"),
}

"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from textweave.llm import (
    ball_hashing,
    digest_index,
    ftrl_toxicity,
    periodic_runs,
    perspectives,
    phrases,
    repeats,
    soft_mixing,
    text_density,
    token_counts,
    vector_graph,
    weak_pii,
    window_packing,
)
from textweave.llm.tables import domains, load

#: Domains of the labelled table and their wanted shares of the tokens.
TARGETS = {"good": 0.9, "low": 0.08, "toxic": 0.02}


def op1_text_density(spark: SparkSession, sf: str) -> DataFrame:
    return text_density.extract(load(spark, sf, "pages"))


def op2_repeated_windows(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(load(spark, sf, "documents"))


def op3_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    span = lambda s: F.concat(s["begin"].cast("string"), F.lit(":"), s["end"].cast("string"))
    done = perspectives.rotate(load(spark, sf, "conversations"))
    return done.withColumn("mask", F.array_join(F.transform("spans", span), ",")).drop("spans")


def op4_vector_graph(spark: SparkSession, sf: str) -> DataFrame:
    return vector_graph.near_duplicates(load(spark, sf, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return digest_index.deduplicate(docs, digest_index.DigestIndex.create(spark))


def op6_window_packing(spark: SparkSession, sf: str) -> DataFrame:
    return window_packing.pack(load(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_ball_hashing(spark: SparkSession, sf: str) -> DataFrame:
    return ball_hashing.near_duplicates(load(spark, sf, "documents"))


def op8_soft_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rated = soft_mixing.rates(load(spark, sf, "documents"), domains(load(spark, sf, "labels")), TARGETS)
    shares = [F.col("posterior")[i].alias(f"p_{name}") for i, name in enumerate(TARGETS)]
    totals = [F.col(c)[i].alias(f"{c}_{name}") for c in ("aims", "reached") for i, name in enumerate(TARGETS)]
    return rated.select("doc_id", "copies", "n_tokens", *shares, "rate", *totals)


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return ftrl_toxicity.toxicity(load(spark, sf, "documents"), load(spark, sf, "labels"))


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_weak_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = weak_pii.personal_data(load(spark, sf, "documents"))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.find_runs(load(spark, sf, "documents"), prepare=periodic_runs.tail_repeated)
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("runs", "collapsed")]
    return found.select("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", *digests)


def op13_phrase_tries(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(load(spark, sf, "documents"))


QUERIES = {
    "op1_text_density": op1_text_density,
    "op2_repeated_windows": op2_repeated_windows,
    "op3_perspectives": op3_perspectives,
    "op4_vector_graph": op4_vector_graph,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_window_packing": op6_window_packing,
    "op7_ball_hashing": op7_ball_hashing,
    "op8_soft_mixing": op8_soft_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_weak_pii": op11_weak_pii,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrase_tries": op13_phrase_tries,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op5_exact_dedup": r"""
with texts as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from texts
""",
    "op2_repeated_windows": r"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
starts as (
  select doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) as st from docs),
windows as (
  select doc_id, st, row_number() over (
    partition by array_to_string(list_slice(words, st, st + 19), ' ') order by doc_id, st) as nth
  from starts),
gone as (
  select distinct doc_id, unnest(range(st, st + 20)) as place from windows where nth > 1),
places as (
  select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from docs),
left_over as (
  select doc_id, count(*) as n_kept, string_agg(word, ' ' order by place) as kept
  from places anti join gone using (doc_id, place) group by doc_id)
select doc_id, len(words) as n_words, len(words) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join left_over using (doc_id)
""",
    "op3_perspectives": r"""
with named as (
  select conv_id, turn, coalesce(nullif(trim(coalesce(role, '')), ''), 'unknown') as speaker, coalesce(text, '') as text
  from conversations),
turns as (
  select *, row_number() over (partition by conv_id order by turn nulls first, speaker, text) - 1 as place from named),
people as (select distinct conv_id, speaker as participant from turns where speaker <> 'system'),
pieces as (
  select conv_id, participant, place // 64 as part, place, speaker = participant as own,
         '<|im_start|>' || case when speaker = participant then 'assistant' when speaker = 'system' then 'system'
           else 'user name=' || speaker end || chr(10) as head,
         t.text || '<|im_end|>' || chr(10) as body
  from turns t join people using (conv_id)),
spans as (
  select *, sum(length(head) + length(body)) over (partition by conv_id, participant, part order by place) as upto from pieces)
select conv_id, participant, part, count(*) as n_turns, string_agg(head || body, '' order by place) as text,
       coalesce(string_agg((upto - length(body)) || ':' || upto, ',' order by place) filter (where own), '') as mask
from spans group by all
""",
    "op13_phrase_tries": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as s from worded, (select unnest([1, 2, 3, 4]) as k))),
freq as (select lang, k as size, phrase, count(*)::hugeint as f from grams group by all),
totals as (select lang, sum(f) as n from freq where size = 1 group by lang),
often as (select *, string_split(phrase, ' ') as w from freq where f >= 30),
cuts as (
  select lang, size, phrase, w, f as a, unnest(range(1, size)) as k from often where size >= 2),
scores as (
  select c.*, x.f as l, y.f as r, 2000000 * a // (x.f + y.f) as score
  from cuts c join freq x on x.lang = c.lang and x.phrase = array_to_string(list_slice(c.w, 1, c.k), ' ')
  join freq y on y.lang = c.lang and y.phrase = array_to_string(list_slice(c.w, c.k + 1, c.size), ' ')),
lowest as (
  select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (
  select lang, array_to_string(list_slice(w, s, s + m - 1), ' ') as phrase, max(f) as longer
  from (select lang, w, f, m, unnest(range(1, size - m + 2)) as s from often, (select unnest([2, 3]) as m) where size > m)
  group by all),
kept as (
  select lang, phrase, a, l, r, score from lowest left join held using (lang, phrase)
  where longer is null or 100 * longer < 80 * a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
""",
}

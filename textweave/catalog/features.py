"""Vectors: term weights, vocabularies, indexes, scaling, imputation, embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.catalog.common import SQL_TOKENS, load, rounded, tokens
from textweave.functions.text import exploded
from textweave.operators import features as ft
from textweave.plans import factors, frequent, similarity, threshold
from textweave.plans.similarity import cosine_pairs, token_weights

PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def hashed_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Term frequencies in hash buckets; their sum is the number of tokens."""
    df = ft.hashing_tf(tokens(spark, sf))
    values = F.unwrap_udt("tf")["values"]
    return df.select("doc_id", F.aggregate(values, F.lit(0.0), lambda s, v: s + v).cast("bigint").alias("n_tokens"))


def hashed_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    df = ft.idf(ft.hashing_tf(tokens(spark, sf))).table
    entries = F.unwrap_udt("tfidf")
    norm = F.sqrt(F.aggregate(entries["values"], F.lit(0.0), lambda s, v: s + v * v))
    return df.select("doc_id", F.size(entries["indices"]).alias("n_buckets"), F.round(norm, 6).alias("norm"))


def tfidf_tokens(spark: SparkSession, sf: str) -> DataFrame:
    weights = token_weights(tokens(spark, sf), "doc_id", "tokens")
    return weights.select("doc_id", "token", "tf", rounded("weight"))


def tfidf_norms(spark: SparkSession, sf: str) -> DataFrame:
    weights = token_weights(tokens(spark, sf), "doc_id", "tokens", min_doc_freq=2)
    squares = F.sum(F.col("weight") * F.col("weight"))
    return weights.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sqrt(squares), 6).alias("norm"))


def tfidf_cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each document with the next one."""
    weights = token_weights(tokens(spark, sf), "doc_id", "tokens")
    ids = load(spark, sf, "documents").select("doc_id")
    pairs = ids.select(F.col("doc_id").alias("id1"), (F.col("doc_id") + 1).alias("id2")).join(
        ids.select(F.col("doc_id").alias("id2")), "id2", "left_semi"
    )
    return cosine_pairs(weights, pairs, "doc_id").select("id1", "id2", rounded("cosine"))


def similar_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of different token vectors with a cosine of 0.7 or more."""
    weights = token_weights(tokens(spark, sf), "doc_id", "tokens")
    return threshold.similar_records(weights, "doc_id", 0.7).pairs.select("id1", "id2", rounded("cosine"))


def similar_document_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The document that stands for all with the same tokens, as often."""
    weights = token_weights(tokens(spark, sf), "doc_id", "tokens")
    return threshold.vector_classes(weights.filter("weight <> 0"), "doc_id")


def similar_new_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of one source against those of all others, without a column to block on."""
    weights = token_weights(tokens(spark, sf), "doc_id", "tokens")
    source = load(spark, sf, "documents").select("doc_id", (F.col("source") == "src1").alias("new"))
    known, new = source.filter("not new"), source.filter("new")
    return threshold.similar_to_known(weights, known, new, "doc_id", 0.5).pairs.select("id1", "id2", rounded("cosine"))


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return ft.vocabulary(tokens(spark, sf)).withColumn("index", F.col("index").cast("bigint"))


def count_vectors(spark: SparkSession, sf: str) -> DataFrame:
    df = ft.count_vectors(tokens(spark, sf), min_df=2.0).table
    entries = F.unwrap_udt("features")
    total = F.aggregate(entries["values"], F.lit(0.0), lambda s, v: s + v).cast("bigint")
    return df.select("doc_id", F.size(entries["indices"]).alias("n_terms"), total.alias("n_tokens"))


def count_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary counts weighted by IDF: entries and length of each document's vector."""
    counts = ft.count_vectors(tokens(spark, sf), output_col="tf").table
    entries = F.unwrap_udt("tfidf")
    norm = F.sqrt(F.aggregate(entries["values"], F.lit(0.0), lambda s, v: s + v * v))
    return ft.idf(counts).table.select("doc_id", F.size(entries["indices"]).alias("n_terms"), F.round(norm, 6).alias("norm"))


def string_index(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"))
    return ft.string_index(orders).table


def label_table(spark: SparkSession, sf: str) -> DataFrame:
    """Index of the document tokens by frequency."""
    words = exploded(tokens(spark, sf), "tokens", "token")
    return ft.label_table(words, "token")


def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    df = ft.one_hot(orders, "o_orderpriority").table
    entries = F.unwrap_udt("features")
    return df.select(
        "o_orderkey", entries["size"].alias("size"), F.coalesce(F.get(entries["indices"], 0), F.lit(-1)).alias("position")
    )


def assemble(spark: SparkSession, sf: str) -> DataFrame:
    df = ft.assemble(load(spark, sf, "lineitem"), [0, 3, "l_quantity", 7])
    v = vector_to_array("features")
    return df.select("l_partkey", F.size(v).alias("size"), *[F.round(v[i], 4).alias(f"x{i}") for i in range(4)])


def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("quality").cast("double").alias("quality"),
        F.when(F.col("toxic").isNull(), F.lit(float("nan"))).otherwise(F.col("toxic").cast("double")).alias("toxic"),
        F.lit(None).cast("double").alias("empty"),
    )
    df = ft.impute_means(df, ["quality", "toxic", "empty"])
    return df.select("doc_id", rounded("quality_imputed"), rounded("toxic_imputed"))


def min_max(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", *PRICES, F.lit(7.0).alias("constant"))
    df = ft.min_max_scale(ft.assemble(lines, [*PRICES, "constant"], "raw_feature_vec")).table
    v = vector_to_array("feature_vec")
    return df.select("l_orderkey", *[F.round(v[i], 6).alias(f"x{i}") for i in range(5)])


def standard(spark: SparkSession, sf: str) -> DataFrame:
    df = ft.standard_scale(ft.assemble(load(spark, sf, "lineitem"), PRICES)).table
    v = vector_to_array("scaled")
    return df.select("l_orderkey", *[F.round(v[i], 6).alias(f"x{i}") for i in range(4)])


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean word vector of each document."""
    df = ft.word2vec(tokens(spark, sf)).table
    v = vector_to_array("vector")
    return df.select("doc_id", F.round(v[0], 4).alias("x0"), F.round(v[99], 4).alias("x99"))


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean word vector of each document, weighted by TF-IDF."""
    docs = tokens(spark, sf)
    model = ft.word2vec(docs).model
    v = vector_to_array("features")
    found = similarity.document_vectors(docs, "doc_id", "tokens", model.getVectors())
    return found.select("doc_id", F.round(v[0], 4).alias("x0"), F.round(v[99], 4).alias("x99"))


def mean_item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of the parts of an order, weighted by quantity."""
    items = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("vec_id"), "l_quantity")
    vectors = load(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("vector"))
    df = ft.mean_vectors(items, vectors, "l_orderkey", "vec_id", "l_quantity")
    v = vector_to_array("features")
    return df.select("l_orderkey", *[F.round(v[i], 5).alias(f"x{i}") for i in (0, 31, 63)])


def principal_components(spark: SparkSession, sf: str) -> DataFrame:
    points = load(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    v = vector_to_array("pca")
    return ft.reduce_dimensions(points, 3).table.select("vec_id", *[F.round(F.abs(v[i]), 4).alias(f"x{i}") for i in range(3)])


def word_associations(spark: SparkSession, sf: str) -> DataFrame:
    """Words that stand within two places of each other oftener than by chance."""
    counts = factors.cooccurrences(tokens(spark, sf), "tokens", window=2, min_count=20)
    return factors.positive_information(counts).select("word", "context", "n", rounded("weight"))


def association_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the words from their associations, without a vocabulary in one place: lengths, as signs are free."""
    counts = factors.cooccurrences(tokens(spark, sf), "tokens", window=2, min_count=20)
    vectors = factors.word_vectors(factors.positive_information(counts), 10, iterations=3)
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    return vectors.select("word", F.round(F.sqrt(square), 3).alias("length"))


def sparse_components(spark: SparkSession, sf: str) -> DataFrame:
    """Principal components of the texts by their tokens, one column for each token: places on the first three."""
    counts = exploded(tokens(spark, sf), "tokens", "token", "doc_id").groupBy("doc_id", "token").agg(F.log1p(F.count("*")).alias("value"))
    found = factors.principal_components(counts.withColumnsRenamed({"doc_id": "row", "token": "column"}), 3, iterations=3)
    return found.scores.select(F.col("row").alias("doc_id"), *[F.round(F.abs(F.col("x")[i]), 3).alias(f"x{i}") for i in range(3)])


def frequent_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred most frequent tokens, counted without a shuffle of all of them."""
    return frequent.most_frequent(exploded(tokens(spark, sf), "tokens", "token"), "token", 100)


QUERIES = {
    "word_associations": word_associations,
    "association_vectors": association_vectors,
    "sparse_components": sparse_components,
    "frequent_tokens": frequent_tokens,
    "hashed_terms": hashed_terms,
    "hashed_tfidf": hashed_tfidf,
    "tfidf_tokens": tfidf_tokens,
    "tfidf_norms": tfidf_norms,
    "tfidf_cosine_pairs": tfidf_cosine_pairs,
    "similar_documents": similar_documents,
    "similar_document_classes": similar_document_classes,
    "similar_new_documents": similar_new_documents,
    "vocabulary": vocabulary,
    "count_vectors": count_vectors,
    "count_tfidf": count_tfidf,
    "string_index": string_index,
    "label_table": label_table,
    "one_hot": one_hot,
    "assemble": assemble,
    "impute_mean": impute_mean,
    "min_max": min_max,
    "standard": standard,
    "word_vectors": word_vectors,
    "document_vectors": document_vectors,
    "mean_item_vectors": mean_item_vectors,
    "principal_components": principal_components,
}

_WEIGHTS = f"""
    tf as (select doc_id, token, count(*) as tf from (select doc_id, unnest({SQL_TOKENS}) as token from documents) group by 1, 2),
    df as (select token, count(*) as df from tf group by token),
    weights as (select doc_id, token, tf, df,
                       tf * ln(((select count(*) from documents) + 1.0::double) / (df + 1)) as weight
                from tf join df using (token))"""

_CLASSES = """
    used as (select * from weights where weight <> 0),
    vectors as (select doc_id, list((token, tf) order by token) as vector from used group by doc_id),
    classes as (select doc_id, min(doc_id) over (partition by vector) as class_id from vectors)"""

_COSINES = """
    norms as (select doc_id, sqrt(sum(weight * weight)) as norm from used group by doc_id),
    cosines as (select a.doc_id as id1, b.doc_id as id2, sum(a.weight * b.weight) / any_value(x.norm) / any_value(y.norm) as cosine
                from used a join used b on b.token = a.token and b.doc_id <> a.doc_id
                join norms x on x.doc_id = a.doc_id join norms y on y.doc_id = b.doc_id group by 1, 2)"""

_INDEX = """
    ranks as (select o_orderpriority, row_number() over (order by count(*) desc, o_orderpriority) - 1 as i
              from orders group by o_orderpriority)"""


def _sql_scaled(expression: str) -> str:
    return ", ".join(f"round({expression.format(c)}, 6) as x{i}" for i, c in enumerate(PRICES))


ORACLES = {
    "word_associations": f"""
with words as (select {SQL_TOKENS} as w from documents),
often as (select word from (select unnest(w) as word from words) group by word having count(*) >= 20),
pairs as (
  select a, b, count(*) as n
  from (select unnest(list_zip(w[1:len(w) - d], w[d + 1:len(w)])) as p, p[1] as a, p[2] as b
        from words, (select unnest([1, 2]) as d) where len(w) > d)
  where a in (select word from often) and b in (select word from often) group by a, b),
counts as (
  select word, context, sum(n)::bigint as n
  from (select a as word, b as context, n from pairs union all select b, a, n from pairs) group by 1, 2),
margins as (select word, sum(n) as n_word from counts group by word)
select c.word, c.context, n, round(ln(ratio), 6) as weight
from (select c.*, (n / x.n_word::double) * ((select sum(n) from counts)::double / y.n_word::double) as ratio
      from counts c join margins x on x.word = c.word join margins y on y.word = c.context) c
where ratio > 1
""",
    "frequent_tokens": f"""
select token as item, count(*) as n from (select unnest({SQL_TOKENS}) as token from documents)
group by token order by n desc, item limit 100
""",
    "hashed_terms": f"select doc_id, len({SQL_TOKENS}) as n_tokens from documents",
    "tfidf_tokens": f"with {_WEIGHTS} select doc_id, token, tf, round(weight, 6) as weight from weights",
    "tfidf_norms": f"""
        with {_WEIGHTS}
        select doc_id, count(*) as n_terms, round(sqrt(sum(case when df >= 2 then weight * weight else 0 end)), 6) as norm
        from weights group by doc_id""",
    "tfidf_cosine_pairs": f"""
        with {_WEIGHTS},
        norms as (select doc_id, sqrt(sum(weight * weight)) as norm from weights group by doc_id),
        dots as (select a.doc_id as id1, b.doc_id as id2, sum(a.weight * b.weight) as dot
                 from weights a join weights b on b.doc_id = a.doc_id + 1 and b.token = a.token group by 1, 2),
        pairs as (select a.doc_id as id1, b.doc_id as id2 from documents a join documents b on b.doc_id = a.doc_id + 1)
        select id1, id2, round(coalesce(dot, 0) / nullif(x.norm * y.norm, 0), 6) as cosine
        from pairs left join dots using (id1, id2)
        left join norms x on x.doc_id = id1 left join norms y on y.doc_id = id2""",
    "similar_documents": f"""
        with {_WEIGHTS}, {_CLASSES}, {_COSINES}
        select id1, id2, round(cosine, 6) as cosine from cosines
        join classes c on c.doc_id = id1 and c.class_id = id1 join classes d on d.doc_id = id2 and d.class_id = id2
        where id1 < id2 and cosine >= 0.7""",
    "similar_document_classes": f"with {_WEIGHTS}, {_CLASSES} select doc_id, class_id from classes",
    "similar_new_documents": f"""
        with {_WEIGHTS}, {_CLASSES}, {_COSINES},
        new as (select distinct class_id as id1 from classes join documents using (doc_id) where source = 'src1'),
        known as (select distinct class_id as id2 from classes join documents using (doc_id) where source <> 'src1')
        select id1, id2, round(cosine, 6) as cosine from cosines join new using (id1) join known using (id2) where cosine >= 0.5
        union all select id1, id2, 1.0::double from new join known on id1 = id2""",
    "vocabulary": f"""
        select row_number() over (order by count(*) desc, term) - 1 as index, term, count(*) as count
        from (select unnest({SQL_TOKENS}) as term from documents) group by term order by index limit 262144""",
    "count_vectors": f"""
        with tf as (select doc_id, token, count(*) as tf from (select doc_id, unnest({SQL_TOKENS}) as token from documents) group by 1, 2),
        kept as (select token from tf group by token having count(*) >= 2)
        select d.doc_id, cast(count(k.token) as integer) as n_terms,
               cast(coalesce(sum(case when k.token is not null then tf end), 0) as bigint) as n_tokens
        from documents d left join tf using (doc_id) left join kept k using (token) group by d.doc_id""",
    "count_tfidf": f"""
        with {_WEIGHTS}
        select doc_id, cast(count(*) as integer) as n_terms, round(sqrt(sum(weight * weight)), 6) as norm
        from weights group by doc_id""",
    "string_index": f"""
        with {_INDEX} select o_orderkey, o_orderpriority as category, i::double as category_index
        from orders join ranks using (o_orderpriority)""",
    "label_table": f"""
        select token as value, count(*) as count, row_number() over (order by count(*) desc, token) - 1 as index
        from (select unnest({SQL_TOKENS}) as token from documents) group by token""",
    "one_hot": f"""
        with {_INDEX}, n as (select count(*) as n from ranks)
        select o_orderkey, cast(n - 1 as integer) as size, cast(case when i < n - 1 then i else -1 end as integer) as position
        from orders join ranks using (o_orderpriority), n""",
    "assemble": """
        select l_partkey, cast(4 as integer) as size, round(l_orderkey::double, 4) as x0, round(l_linenumber::double, 4) as x1,
               round(l_quantity, 4) as x2, round(l_tax, 4) as x3
        from lineitem""",
    "impute_mean": """
        select doc_id, round(coalesce(quality, (select avg(quality) from labels)), 6) as quality_imputed,
               round(coalesce(toxic, (select avg(toxic) from labels)), 6) as toxic_imputed
        from documents left join labels using (doc_id)""",
    "min_max": f"""
        select l_orderkey, {_sql_scaled("({0} - (select min({0}) from lineitem)) / ((select max({0}) from lineitem) - (select min({0}) from lineitem))")},
               0.5::double as x4 from lineitem""",
    "standard": f"""
        select l_orderkey, {_sql_scaled("{0} / (select stddev_samp({0}) from lineitem)")} from lineitem""",
    "mean_item_vectors": """
        select l_orderkey, round(sum(l_quantity * embedding[1]::double) / sum(l_quantity), 5) as x0,
               round(sum(l_quantity * embedding[32]::double) / sum(l_quantity), 5) as x31,
               round(sum(l_quantity * embedding[64]::double) / sum(l_quantity), 5) as x63
        from lineitem join embeddings on vec_id = l_partkey group by l_orderkey""",
}

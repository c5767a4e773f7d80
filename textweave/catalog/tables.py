"""Reading, joining, filling, grouping, sampling, summing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.catalog.common import digest, load, rounded, tokens
from textweave.operators import features as ft
from textweave.operators import grouping, relational, roles, sampling
from textweave.session import shared_path
from textweave.sources import files, sinks, tables
from textweave.sources.arff import ArffSource


def read_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_table(spark, f"{sf}/supplier.parquet", "parquet").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def tsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "orders-tsv")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    orders.write.csv(path, sep="\t", header=True)
    back = files.read_table(spark, path, "tsv")
    return back.withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})


def arff_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through ARFF files and back, texts with all their lines and quotes."""
    spark.dataSource.register(ArffSource)
    path = shared_path(spark, "documents-arff")
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    docs.write.format("arff").mode("append").save(path)
    back = spark.read.format("arff").load(path)
    return back.withColumns({c: F.col(c).cast("bigint") for c in ("doc_id", "n_chars")})


def row_ids(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_lines"))
    return files.with_id(lines, "row_id", ["l_partkey", "l_suppkey"])


def row_ids_unstable(spark: SparkSession, sf: str) -> DataFrame:
    """Ids without keys are unique: as many as there are rows."""
    orders = files.with_id(load(spark, sf, "orders").select("o_orderkey"))
    return orders.select("_id").distinct().agg(F.count("*").alias("n_ids"))


SQL_TEXT = """
select n_name, count(*) as n_customers, round(sum(c_acctbal), 2) as balance
from {customers} join {nations} on c_nationkey = n_nationkey
where c_acctbal > {minimum} group by n_name
"""


def sql_table(spark: SparkSession, sf: str) -> DataFrame:
    text = SQL_TEXT.replace("{minimum}", ":minimum")
    return tables.from_sql(
        spark, text, {"minimum": 0}, customers=load(spark, sf, "customer"), nations=load(spark, sf, "nation")
    )


def associations(spark: SparkSession, sf: str) -> DataFrame:
    return tables.associations(load(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


def arff_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"),
        F.lit(1.0).alias("weight"), (F.col("l_returnflag") == "R").cast("int").alias("class"),
    )
    return sinks.arff_lines(ft.assemble(lines, ["q", "p", "d"], "feature_vec"), decimals=4)


def preview(spark: SparkSession, sf: str) -> DataFrame:
    shown = sinks.preview(load(spark, sf, "embeddings"), 100, ["vec_id"])
    entries = F.transform("embedding", lambda x: F.format_string("%.4f", x.cast("double")))
    return shown.select("vec_id", "label", F.concat_ws(",", entries).alias("entries"))


def row_count(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.row_count(load(spark, sf, "lineitem"))


def join_on_id(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderpriority")
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_partkey", "l_quantity")
    return relational.join_on(orders, lines, "order_id")


def join_three(spark: SparkSession, sf: str) -> DataFrame:
    documents = load(spark, sf, "documents").select("doc_id", "lang", "source")
    sizes = tokens(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens"))
    return relational.join_all([documents, sizes, load(spark, sf, "labels")], "doc_id")


def union_rows(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = load(spark, sf, "supplier").select("s_name", "s_acctbal")
    return relational.union_rows(customers, suppliers)


def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer").select(F.col("c_name").alias("name"), "c_mktsegment")
    suppliers = load(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return relational.union_rows(customers, suppliers, by_name=True).select("name", "c_mktsegment", "balance")


def merge_right_wins(spark: SparkSession, sf: str) -> DataFrame:
    listed = load(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    sold = load(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max("l_extendedprice").alias("price")
    )
    return relational.merge_right_wins(listed, sold, "p_partkey")


def array_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Common tokens of neighbouring turns."""
    turns = load(spark, sf, "conversations").select("conv_id", "turn", F.split(F.lower("text"), r"\s+").alias("words"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next_words"))
    common = F.array_sort(F.array_intersect("words", "next_words"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size(common).alias("n_common"), digest(common).alias("digest")
    )


def random_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = sampling.random_split(load(spark, sf, "orders").select("o_orderkey"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _parts_of_each(train: DataFrame, test: DataFrame) -> DataFrame:
    """A split puts each order into exactly one part."""
    return train.unionByName(test).groupBy("o_orderkey").agg(F.count("*").alias("n_parts"))


def random_split_is_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _parts_of_each(*sampling.random_split(load(spark, sf, "orders").select("o_orderkey")))


def split_by_hash_is_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _parts_of_each(*sampling.split_by_hash(load(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.8, 0.2))


def split_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    train, test = sampling.split_by_hash(load(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"))


def sample_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_by_hash(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


def group_to_list(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lists = grouping.group_rows(lines, "l_orderkey", "lines")
    item = F.transform("lines", lambda x: F.concat_ws(":", x["l_orderkey"], x["l_linenumber"], x["l_partkey"], x["l_suppkey"]))
    return lists.select("l_orderkey", "part", F.size("lines").alias("n_lines"), F.array_join(F.array_sort(item), ";").alias("lines"))


def distinct_lists(spark: SparkSession, sf: str) -> DataFrame:
    edges = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("crime_id"), F.col("l_partkey").cast("string").alias("person_id"))
    return grouping.distinct_lists(edges, "crime_id", "person_id", "persons").select(
        "crime_id", "part", F.array_join("persons", "+").alias("persons")
    )


def hot_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Few keys with very many rows each: all parts of their lists."""
    lines = load(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    lists = grouping.group_rows(lines, "l_returnflag", "lines", ["l_orderkey", "l_linenumber"], list_rows=1000)
    item = F.transform("lines", lambda x: F.concat_ws(":", x["l_orderkey"], x["l_linenumber"]))
    return lists.select("l_returnflag", "part", F.size("lines").alias("n_lines"), F.md5(F.array_join(item, ";")).alias("digest"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")


def fill_by_column(spark: SparkSession, sf: str) -> DataFrame:
    df = _labelled(spark, sf).select("doc_id", F.when(F.col("toxic") == 0, F.col("lang")).alias("note"), "quality")
    return relational.fill_by_column(df, {"Note": "", "quality": -1})


def fill_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return relational.fill_nulls(_labelled(spark, sf).select("doc_id", "source", "quality", "toxic"))


def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").drop("text", "source")


def exclude_group(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").where("o_orderpriority <> '5-LOW'")
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def columns_by_type(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    floats, _ = relational.columns_by_type(lines, exclude=("l_tax",))
    return lines.agg(*[F.round(F.max(c), 4).alias(f"max_{c}") for c in floats])


def plot_columns(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").withColumn("class", F.col("l_linenumber"))
    return relational.plot_columns(lines, ["l_quantity", "l_discount", "l_tax"])


def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    found = roles.column_roles(load(spark, sf, "lineitem"))
    return found.select("column", "role", "n_distinct", F.array_join("values", ",").alias("values"))


def column_roles_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    found = roles.column_roles(_labelled(spark, sf).select("doc_id", "quality").unionByName(
        load(spark, sf, "labels").select("doc_id", "toxic"), allowMissingColumns=True))
    labels = roles.column_roles(load(spark, sf, "labels")).withColumn("column", F.concat(F.lit("labels."), "column"))
    return found.unionByName(labels).select("column", "role", "n_distinct", F.array_join("values", ",").alias("values"))


def column_roles_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Roles from the states of seven batches; counts of the columns that were counted again."""
    lines = load(spark, sf, "lineitem")
    batches = [roles.role_state(lines.where(F.col("l_linenumber") == n)) for n in range(1, 8)]
    found = roles.roles_of_state(roles.merge_role_states(*batches), lines)
    counted = F.when(F.col("role") == "discrete", F.col("n_distinct")).alias("n_distinct")
    return found.select("column", "role", counted, F.array_join("values", ",").alias("values"))


def int_means(spark: SparkSession, sf: str) -> DataFrame:
    return relational.means_rounded(_labelled(spark, sf), ["n_chars", "quality", "toxic"])


def int_mean_fill(spark: SparkSession, sf: str) -> DataFrame:
    return relational.fill_with_means(_labelled(spark, sf).select("doc_id", "quality", "toxic"), ["quality", "toxic"])


def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    return relational.top_rows(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50, ["o_orderkey"])


def user_function(spark: SparkSession, sf: str) -> DataFrame:
    def busiest(events: DataFrame, users: int) -> DataFrame:
        counts = events.groupBy("user_id").agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
        return relational.top_rows(counts, "n_events", users, ["user_id"])

    return relational.apply_function(busiest, load(spark, sf, "events"), users=20).select("user_id", "n_events", rounded("value", 4))


QUERIES = {
    "read_parquet": read_parquet,
    "tsv_round_trip": tsv_round_trip,
    "arff_round_trip": arff_round_trip,
    "row_ids": row_ids,
    "row_ids_unstable": row_ids_unstable,
    "sql_table": sql_table,
    "associations": associations,
    "arff_lines": arff_lines,
    "preview": preview,
    "row_count": row_count,
    "join_on_id": join_on_id,
    "join_three": join_three,
    "union_rows": union_rows,
    "union_by_name": union_by_name,
    "merge_right_wins": merge_right_wins,
    "array_intersection": array_intersection,
    "random_split": random_split,
    "split_by_hash": split_by_hash,
    "random_split_is_whole": random_split_is_whole,
    "split_by_hash_is_whole": split_by_hash_is_whole,
    "sample": sample,
    "sample_by_hash": sample_by_hash,
    "group_to_list": group_to_list,
    "distinct_lists": distinct_lists,
    "hot_lists": hot_lists,
    "fill_by_column": fill_by_column,
    "fill_nulls": fill_nulls,
    "drop_columns": drop_columns,
    "exclude_group": exclude_group,
    "columns_by_type": columns_by_type,
    "plot_columns": plot_columns,
    "column_roles": column_roles,
    "column_roles_with_nulls": column_roles_with_nulls,
    "column_roles_merged": column_roles_merged,
    "int_means": int_means,
    "int_mean_fill": int_mean_fill,
    "top_orders": top_orders,
    "user_function": user_function,
}

_LABELLED = "documents left join labels using (doc_id)"

ORACLES = {
    "read_parquet": "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier",
    "tsv_round_trip": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
    "arff_round_trip": "select doc_id, text, lang, n_chars from documents",
    "row_ids": """
        select l_partkey, l_suppkey, count(*) as n_lines, row_number() over (order by l_partkey, l_suppkey) - 1 as row_id
        from lineitem group by l_partkey, l_suppkey""",
    "row_ids_unstable": "select count(*) as n_ids from orders",
    "random_split_is_whole": "select o_orderkey, count(*) as n_parts from orders group by o_orderkey",
    "split_by_hash": """
        select o_orderkey, case when cast('0x' || left(md5(o_orderkey || '|12345'), 8) as bigint) < round(4294967296 * 0.9)
               then 'train' else 'test' end as part from orders""",
    "sample_by_hash": """
        select o_orderkey, o_totalprice from orders
        where cast('0x' || left(md5(o_orderkey || '|1'), 8) as bigint) < 2147483648""",
    "split_by_hash_is_whole": "select o_orderkey, count(*) as n_parts from orders group by o_orderkey",
    "sql_table": SQL_TEXT.replace("{customers}", "customer").replace("{nations}", "nation").replace("{minimum}", "0"),
    "associations": """
        select distinct cast(l_orderkey as varchar) as crime_id, cast(l_partkey as varchar) as person_id from lineitem""",
    "arff_lines": """
        select printf('%.4f,%.4f,%.4f,1.0000,%d', l_quantity, l_extendedprice, l_discount,
                      cast(l_returnflag = 'R' as integer)) as value
        from lineitem""",
    "preview": """
        select vec_id, label,
               array_to_string(list_transform(embedding[1:10], lambda x: printf('%.4f', cast(x as double))), ',') as entries
        from embeddings order by vec_id limit 100""",
    "row_count": "select count(*) as n_rows from lineitem",
    "join_on_id": """
        select o_orderkey as order_id, o_custkey, o_orderpriority, l_partkey, l_quantity
        from orders join lineitem on o_orderkey = l_orderkey""",
    "join_three": r"""
        select doc_id, lang, source, cast(len(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) as integer)
               as n_tokens, quality, toxic
        from documents join labels using (doc_id)""",
    "union_rows": """
        select c_name as name, c_acctbal as balance from customer union all select s_name, s_acctbal from supplier""",
    "union_by_name": """
        select c_name as name, c_mktsegment, null::double as balance from customer
        union all select s_name, null, s_acctbal from supplier""",
    "merge_right_wins": """
        with sold as (select l_partkey as p_partkey, max(l_extendedprice) as price from lineitem
                      where l_returnflag = 'R' group by l_partkey)
        select p_partkey, price from sold
        union all select p_partkey, p_retailprice from part where p_partkey not in (select p_partkey from sold)""",
    "array_intersection": r"""
        with turns as (select conv_id, turn, string_split_regex(lower(text), '\s+') as words from conversations),
        common as (select a.conv_id, a.turn, list_sort(list_distinct(list_filter(a.words, lambda w: list_contains(b.words, w)))) as c
                   from turns a join turns b on b.conv_id = a.conv_id and b.turn = a.turn + 1)
        select conv_id, turn, cast(len(c) as integer) as n_common, md5(array_to_string(c, chr(31))) as digest from common""",
    "group_to_list": """
        with items as (select l_orderkey, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) as item from lineitem)
        select l_orderkey, cast(0 as bigint) as part, cast(count(*) as integer) as n_lines,
               string_agg(item, ';' order by item) as lines
        from items group by l_orderkey""",
    "distinct_lists": """
        select crime_id, cast(0 as bigint) as part, string_agg(person_id, '+' order by person_id) as persons
        from (select distinct l_orderkey as crime_id, cast(l_partkey as varchar) as person_id from lineitem)
        group by crime_id""",
    "hot_lists": """
        with placed as (
          select l_returnflag, l_orderkey, l_linenumber,
                 row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber) - 1 as place from lineitem)
        select l_returnflag, place // 1000 as part, count(*) as n_lines,
               md5(string_agg(l_orderkey || ':' || l_linenumber, ';' order by place)) as digest
        from placed group by l_returnflag, place // 1000""",
    "fill_by_column": f"""
        select doc_id, coalesce(case when toxic = 0 then lang end, '') as note, coalesce(quality, -1) as quality
        from {_LABELLED}""",
    "fill_nulls": f"""
        select doc_id, source, coalesce(quality, 0) as quality, coalesce(toxic, 0) as toxic from {_LABELLED}""",
    "drop_columns": "select doc_id, lang, n_chars from documents",
    "exclude_group": """
        select o_orderpriority, count(*) as n_orders, round(sum(o_totalprice), 2) as total
        from orders group by o_orderpriority having o_orderpriority <> '5-LOW'""",
    "columns_by_type": """
        select round(max(l_quantity), 4) as max_l_quantity, round(max(l_extendedprice), 4) as max_l_extendedprice,
               round(max(l_discount), 4) as max_l_discount
        from lineitem""",
    "plot_columns": "select l_quantity, l_discount, l_tax, cast(l_linenumber as varchar) as label from lineitem",
    "column_roles": "\nunion all\n".join(
        [
            f"""select '{c}' as "column", case when count(distinct {c}) >= 13 or max({c}) > count(distinct {c})
                    or bool_or({c} is null) then 'continuous' else 'discrete' end as role, count(distinct {c}) as n_distinct,
                case when role = 'discrete' then string_agg(distinct cast({c} as varchar), ',' order by cast({c} as varchar)) end
                    as "values" from lineitem"""
            for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        ]
        + [f"select '{c}', 'continuous', null, null" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        + [f"select '{c}', 'meta', null, null" for c in ("l_returnflag", "l_linestatus", "l_shipdate")]
    ),
    "column_roles_with_nulls": """
        select * from (
        select 'doc_id' as "column", case when count(distinct doc_id) >= 13 then 'continuous' else 'unexpected' end as role,
               count(distinct doc_id) as n_distinct, null as "values" from documents
        union all select 'quality', 'continuous', count(distinct quality), null from labels
        union all select 'toxic', 'continuous', count(distinct toxic), null from labels
        union all select 'labels.doc_id', 'continuous', count(distinct doc_id), null from labels
        union all select 'labels.quality', 'discrete', count(distinct quality),
                         string_agg(distinct cast(quality as varchar), ',' order by cast(quality as varchar)) from labels
        union all select 'labels.toxic', 'discrete', count(distinct toxic),
                         string_agg(distinct cast(toxic as varchar), ',' order by cast(toxic as varchar)) from labels)""",
    "int_means": f"""
        select cast(round_even(avg(n_chars), 0) as bigint) as n_chars, cast(round_even(avg(quality), 0) as bigint) as quality,
               cast(round_even(avg(toxic), 0) as bigint) as toxic
        from {_LABELLED}""",
    "int_mean_fill": f"""
        select doc_id, coalesce(quality, (select cast(round_even(avg(quality), 0) as integer) from labels)) as quality,
               coalesce(toxic, (select cast(round_even(avg(toxic), 0) as integer) from labels)) as toxic
        from {_LABELLED}""",
    "top_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50",
    "user_function": """
        select user_id, count(*) as n_events, round(sum(value), 4) as value
        from events group by user_id order by n_events desc, user_id limit 20""",
}
ORACLES["column_roles_merged"] = f"""
    select "column", role, case when role = 'discrete' then n_distinct end as n_distinct, "values" from ({ORACLES["column_roles"]})"""

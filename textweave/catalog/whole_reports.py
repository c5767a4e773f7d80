"""Reports with all 13 features, their pairs with all 12 distances, and new pairs on a scale kept from training."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.catalog import linking, texts
from textweave.catalog.common import SQL_REPORTS, load, reports
from textweave.operators.text import NOT_PROPERTY
from textweave.plans import linkage
from textweave.session import materialise

TRAINED_FROM = linking.NEW_FROM - 1


def _listed_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The reports, with a list of stolen property where their order has a line: the name of its first part."""
    first = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    named = first.join(load(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select(
        F.concat(F.lit("C"), "l_orderkey").alias("crime_id"),
        F.concat(F.lit(" PROPERTY STOLEN: "), F.upper("p_name"), F.lit(" AND CASH")).alias("listed"),
    )
    joined = reports(spark, sf).join(named, "crime_id", "left")
    return joined.withColumn("narrative", F.concat("narrative", F.coalesce("listed", F.lit("")))).drop("listed")


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    words = load(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("token")).distinct()
    return words.withColumn("tag", F.lit("NN"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    vectors = linkage.text_vectors(_listed_reports(spark, sf), stem=False)
    return linkage.report_features(vectors, tags=_tags(spark, sf), stem=False, keep=["occurrence_year", "place"])


def _norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(F.unwrap_udt(vector)["values"], F.lit(0.0), lambda s, v: s + v * v))


def report_features_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All 13 features; of the two text vectors their number of entries and their norm."""
    df = _features(spark, sf)
    vectors = ["cosineTFIDF", "cosineTFIDF2"]
    shown = [c for c in linkage.FEATURES if c not in (*vectors, "propertyStolenWordnet")]
    return df.select(
        "crime_id", *shown, F.array_join("propertyStolenWordnet", " ").alias("propertyStolenWordnet"),
        *[F.size(F.unwrap_udt(c)["values"]).alias(f"{c}_terms") for c in vectors],
        *[F.round(_norm(c), 6).alias(f"{c}_norm") for c in vectors],
    )


def _sides(features: DataFrame, first: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Reports before the year ``first``, and those from it on and before ``end``."""
    year = F.col("occurrence_year")
    return features.where(year < first).drop("occurrence_year"), features.where((year >= first) & (year < end)).drop("occurrence_year")


def _pairs(features: DataFrame, first: int, end: int) -> DataFrame:
    known, new = _sides(features, first, end)
    return linkage.pair_features(linkage.test_pairs(known, new, linking.BLOCK), known.unionByName(new))


def pair_features_whole(spark: SparkSession, sf: str) -> DataFrame:
    features = materialise(_features(spark, sf), "reports")
    pairs = _pairs(features, linking.NEW_FROM, 9999)
    return pairs.withColumns({c: F.round(c, 6) for c in ("propertyStolenWordnet", "cosineTFIDF", "cosineTFIDF2")})


def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """New reports against known ones, filled and scaled by what the pairs of the year before gave."""
    features = materialise(_features(spark, sf), "reports")
    trained = linkage.scale_pairs(materialise(_pairs(features, TRAINED_FROM, linking.NEW_FROM), "pairs"))
    found = linkage.candidate_pairs(*_sides(features, linking.NEW_FROM, 9999), linking.BLOCK, model=trained.model)
    v = vector_to_array("feature_vec")
    return found.scaled.select("crime_pair", "weight", "class", *[F.round(v[i], 5).alias(f"x{i}") for i in range(12)])


QUERIES = {
    "report_features_whole": report_features_whole,
    "pair_features_whole": pair_features_whole,
    "candidate_pairs": candidate_pairs,
}


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_LISTED = f"""
    plain as ({SQL_REPORTS}),
    firsts as (select 'C' || l_orderkey as crime_id, min(l_partkey) as p_partkey from lineitem group by l_orderkey),
    stolen as (select crime_id, p_name from firsts join part using (p_partkey)),
    reports as (select plain.* replace (narrative || coalesce(' PROPERTY STOLEN: ' || upper(p_name) || ' AND CASH', '') as narrative)
                from plain left join stolen using (crime_id))"""

_VECTORS = f"""
    normal as (select crime_id, list_filter({texts._FUSED}, lambda w: w <> '' and not list_contains([{_quoted(texts.STOP_WORDS)}], w)) as t
               from (select crime_id, narrative as text from reports)),
    terms1 as materialized (select crime_id, w, count(*) as n from (select crime_id, unnest(t) as w from normal) group by 1, 2),
    terms2 as materialized (select crime_id, w, count(*) as n from (select crime_id,
               unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as w from normal) group by 1, 2),""" + ",".join(
    f"""
    idf{k} as (select w, ln(((select count(*) from reports) + 1) / (count(*) + 1)::double) as i from terms{k} group by w),
    weights{k} as materialized (select crime_id, w, n * i as v from terms{k} join idf{k} using (w)),
    norms{k} as (select crime_id, count(*) as n_terms, sqrt(sum(v * v)) as norm from weights{k} group by crime_id)"""
    for k in (1, 2)
)

_WHOLE = linking._FEATURES.replace(f"reports as ({SQL_REPORTS})", _LISTED) + f""",
    {_VECTORS},
    property as (select crime_id, case when p_name is null then []::varchar[] else list_filter(string_split(lower(p_name), ' '),
                 lambda w: length(w) >= 3 and not list_contains([{_quoted(NOT_PROPERTY)}], w)) end as listed
                 from plain left join stolen using (crime_id)),
    whole as materialized (select features.*, listed, a.norm as norm1, b.norm as norm2, a.n_terms as terms1, b.n_terms as terms2
              from features join property using (crime_id) left join norms1 a using (crime_id) left join norms2 b using (crime_id))"""

_ABOVE = {
    "propertyStolenWordnet": """case when len(x.listed) > 0 and len(y.listed) > 0 then list_sum(list_transform(x.listed,
        lambda a: len(list_filter(y.listed, lambda b: a = b))))::double / ((len(x.listed) + 1) * (len(y.listed) + 1)) end""",
    "cosineTFIDF": "case when x.norm1 > 0 and y.norm1 > 0 then coalesce(d1.s, 0) / (x.norm1 * y.norm1) end",
    "cosineTFIDF2": "case when x.norm2 > 0 and y.norm2 > 0 then coalesce(d2.s, 0) / (x.norm2 * y.norm2) end",
}
_TWELVE = [*linking._NINE, *_ABOVE]


def _sql_raw(name: str, first: int, end: int) -> str:
    """The distances of all pairs of a block, by the years of their reports."""
    dots = ",".join(
        f"""
    {name}_side{k} as materialized (select c1, c2, w, v from {name}_ids join weights{k} on crime_id = c1),
    {name}_dot{k} as (select c1, c2, sum(a.v * b.v) as s from {name}_side{k} a
              join weights{k} b on b.crime_id = c2 and b.w = a.w group by 1, 2)"""
        for k in (1, 2)
    )
    above = ", ".join(f'{sql} as "{c}"' for c, sql in _ABOVE.items())
    nine = linking._RAW[linking._RAW.index("raw as (select ") + len("raw as (select "):linking._RAW.index("1.0::double as weight")]
    return f"""
    {name}_ids as materialized (select x.crime_id as c1, y.crime_id as c2 from features x join features y using (place)
        where x.occurrence_year >= {first} and x.occurrence_year < {end} and y.occurrence_year < {first}),{dots},
    {name} as materialized (select {nine} {above}, 1.0::double as weight, cast(1 as integer) as "class",
        x.crime_id || '+' || y.crime_id as crime_pair
        from {name}_ids i join whole x on x.crime_id = i.c1 join whole y on y.crime_id = i.c2
        left join {name}_dot1 d1 on d1.c1 = i.c1 and d1.c2 = i.c2
        left join {name}_dot2 d2 on d2.c1 = i.c1 and d2.c2 = i.c2)"""


def _sql_scaled(i: int, name: str) -> str:
    mean = f'avg("{name}")' if name in _ABOVE else f'round_even(avg("{name}"), 0)'
    value = f'coalesce("{name}", (select {mean} from trained))'
    low, high = (f'(select {f}(coalesce("{name}", (select {mean} from trained))) from trained)' for f in ("min", "max"))
    return f"round(case when {high} = {low} then 0.5 else ({value} - {low})::double / ({high} - {low}) end, 5) as x{i}"


ORACLES = {
    "report_features_whole": f"""
        with {_WHOLE} select crime_id, {linking._COLUMNS}, array_to_string(listed, ' ') as "propertyStolenWordnet",
        terms1 as "cosineTFIDF_terms", terms2 as "cosineTFIDF2_terms",
        round(norm1, 6) as "cosineTFIDF_norm", round(norm2, 6) as "cosineTFIDF2_norm" from whole""",
    "pair_features_whole": f"""
        with {_WHOLE}, {_sql_raw("raw", linking.NEW_FROM, 9999)}
        select * replace ({", ".join(f'round("{c}", 6) as "{c}"' for c in _ABOVE)}) from raw""",
    "candidate_pairs": f"""
        with {_WHOLE}, {_sql_raw("trained", TRAINED_FROM, linking.NEW_FROM)}, {_sql_raw("raw", linking.NEW_FROM, 9999)}
        select crime_pair, weight, "class", {", ".join(_sql_scaled(i, c) for i, c in enumerate(_TWELVE))} from raw""",
}

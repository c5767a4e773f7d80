"""Report features, overlap groups, pairs and linkage models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.catalog.common import SQL_REPORTS, SQL_TOKENS, load, reports, rounded
from textweave.functions import distance, text
from textweave.functions import reports as rp
from textweave.plans import linkage, overlap, similarity, splits
from textweave.session import materialise
from textweave.sources.tables import associations

BLOCK = ["place"]
NEW_FROM = 2001


def report_features(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.report_features(reports(spark, sf))


def report_details(spark: SparkSession, sf: str) -> DataFrame:
    """The features outside the active table, and the corrected hour."""
    df = reports(spark, sf)
    return df.select(
        "crime_id", rp.signature(F.concat("narrative", F.when(F.col("place") % 7 == 0, " GRAFFITI").otherwise(""))).alias("signature"),
        rp.hour(F.col("occurrence_start_time"), fix_noon=True).alias("hour"),
        rp.net_mentions(F.col("narrative"), rp.MESSY_WORDS).alias("net_messy"),
    )


def narrative_hash(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).select("crime_id", rp.narrative_hash(F.col("narrative")).alias("hash"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return associations(load(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


def co_entity_groups(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_groups(edges(spark, sf))


def co_entity_groups_without(spark: SparkSession, sf: str) -> DataFrame:
    kept = overlap.without_record(edges(spark, sf), "13781")
    return overlap.group_sizes(overlap.overlap_groups(kept))


def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.group_statistics(overlap.overlap_groups(edges(spark, sf)))


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(overlap.overlap_groups(edges(spark, sf)).select("group", "crime_id"), "groups")


def positive_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """What all linked pairs give for each group: their number, weight, and a digest without order."""
    pairs = linkage.positive_pairs(_groups(spark, sf))
    number = F.conv(F.substring(F.md5(F.concat_ws("+", "crime_id1", "crime_id2")), 1, 12), 16, 10).cast("bigint")
    return pairs.groupBy("group").agg(
        F.count("*").alias("n_pairs"), F.round(F.sum("weight"), 6).alias("weight"), F.sum(number).alias("digest")
    )


def negative_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Unlinked pairs of each group in the default number, as many as linked ones on average."""
    return linkage.negative_pairs(_groups(spark, sf)).groupBy("group").agg(F.count("*").alias("n_pairs"))


def negative_pairs_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each member of a group is the first record of the default number of unlinked pairs."""
    pairs = linkage.negative_pairs(_groups(spark, sf))
    each = pairs.groupBy("group", "crime_id1").agg(F.count("*").alias("n_pairs"))
    return each.select("group", F.col("crime_id1").alias("crime_id"), "n_pairs")


def negative_pairs_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Every unlinked pair of the default number: for each group a digest of its pairs without order."""
    pairs = linkage.negative_pairs(_groups(spark, sf))
    number = linkage.drawn(0, "crime_id1", "crime_id2")
    return pairs.groupBy("group").agg(
        F.count("*").alias("n_pairs"), F.sum("weight").alias("weight"), F.max("class").alias("class"), F.sum(number).alias("digest")
    )


def _known_and_new(spark: SparkSession, sf: str, *extra: str) -> tuple[DataFrame, DataFrame]:
    """Reports of the last year against all earlier ones."""
    features = linkage.report_features(reports(spark, sf), keep=["occurrence_year", *extra])
    known = features.where(F.col("occurrence_year") < NEW_FROM).drop("occurrence_year")
    return known, features.where(F.col("occurrence_year") >= NEW_FROM).drop("occurrence_year")


def test_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.test_pairs(*_known_and_new(spark, sf, "place"), block_on=BLOCK)


def block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.block_sizes(*_known_and_new(spark, sf, "place"), block_on=BLOCK)


def _raw_pairs(spark: SparkSession, sf: str) -> DataFrame:
    known, new = _known_and_new(spark, sf, "place")
    pairs = linkage.test_pairs(known, new, BLOCK)
    return linkage.pair_features(pairs, known.unionByName(new))


def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_pairs(spark, sf)


def scaled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    scaled = linkage.scale_pairs(materialise(_raw_pairs(spark, sf), "pairs")).scaled
    v = vector_to_array("feature_vec")
    return scaled.select("crime_pair", "weight", "class", *[F.round(v[i], 6).alias(f"x{i}") for i in range(9)])


def unmatched_pairs(spark: SparkSession, sf: str) -> DataFrame:
    known, new = _known_and_new(spark, sf, "place")
    pairs = linkage.test_pairs(known, new, BLOCK)
    return linkage.unmatched_pairs(pairs, known.where("messy = 1").unionByName(new)).agg(F.count("*").alias("n_dropped"))


def list_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Token lists of neighbouring turns."""
    turns = load(spark, sf, "conversations").select("conv_id", "turn", text.regex_tokens(F.col("text")).alias("x"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(distance.list_similarity(F.col("x"), F.col("y")), 9).alias("similarity")
    )


def leakless_split(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and parts tied by full line items, every component in one of two parts."""
    items = load(spark, sf, "lineitem").filter("l_quantity = 50")
    ties = items.select(F.concat(F.lit("O"), "l_orderkey").alias("id1"), F.concat(F.lit("P"), "l_partkey").alias("id2"))
    return splits.component_parts(ties, (0.8, 0.2), "id1", "id2")


def additive_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Part names of neighbouring orders; words are as similar as often they name a part together."""
    parts = load(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    together = parts.select(F.col("w")[0].alias("a"), F.col("w")[1].alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    total = parts.agg(F.count("*").cast("double")).scalar()
    similar = together.select("a", "b", (F.col("n") / total).alias("sim"))
    words = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey")
    keys = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id1"), (F.col("o_orderkey") + 1).alias("id2"))
    pairs = keys.join(keys.select(F.col("id1").alias("id2")), "id2", "left_semi")
    found = similarity.additive_similarity(
        pairs, words.select("l_orderkey", F.explode("w").alias("word")), similar, "l_orderkey"
    )
    return found.select("id1", "id2", rounded("score", 12))


def linkage_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain over all reports, linked pairs and the default number of unlinked ones: how the held-out pairs were scored.

    Tags of the property words come from the words themselves, so that all 13 features take part.
    """
    linked = edges(spark, sf).withColumn("crime_id", F.concat(F.lit("C"), "crime_id"))
    words = load(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("token")).distinct()
    found = linkage.link_reports(reports(spark, sf), linked, tags=words.withColumn("tag", F.lit("NN")))
    return found.scores.groupBy("model", "class").agg(
        F.count("*").alias("n_pairs"), F.round(F.avg("prediction"), 3).alias("found"), F.round(F.avg("score"), 3).alias("score")
    )


QUERIES = {
    "report_features": report_features,
    "report_details": report_details,
    "narrative_hash": narrative_hash,
    "co_entity_groups": co_entity_groups,
    "co_entity_groups_without": co_entity_groups_without,
    "group_stats": group_stats,
    "positive_pairs": positive_pairs,
    "negative_pairs": negative_pairs,
    "negative_pairs_of_groups": negative_pairs_of_groups,
    "negative_pairs_digest": negative_pairs_digest,
    "test_pairs": test_pairs,
    "block_sizes": block_sizes,
    "pair_features": pair_features,
    "scaled_pairs": scaled_pairs,
    "unmatched_pairs": unmatched_pairs,
    "list_similarity": list_similarity,
    "additive_similarity": additive_similarity,
    "leakless_split": leakless_split,
    "linkage_scores": linkage_scores,
}

_NEGATED = "NOT |NO |HAVEN''T|DIDN''T|DIDNT|HAVENT"


def _sql_net(column: str, words: str) -> str:
    relevant = f"list_filter(string_split({column}, '.'), lambda s: regexp_matches(s, '{words}'))"
    return f"(len({relevant}) - 2 * len(list_filter({relevant}, lambda s: regexp_matches(s, '{_NEGATED}'))))"


_MESSY = "MESSY|MESSIL|RUMMAG|TIPPED"
_SECURE = "LOCKED|FENCED|GATED|SECURED|BOLTED"

_FEATURES = f"""
    reports as ({SQL_REPORTS}),
    entries as (select *, string_split(narrative, '__________________________________ CREATED BY')[-1] as entry from reports),
    described as (select *, case when regexp_matches(entry, 'NARRATIVE|CIRCUMSTANCES')
                  then regexp_extract(substring(string_split_regex(entry, 'NARRATIVE|CIRCUMSTANCES')[-1], 2), '^[^*:]*')
                  else entry end as "methodOfEntry" from entries),
    features as (select crime_id, place, occurrence_year,
        case when contains(location_type, 'Farm') then '1' when contains(location_type, 'Residenti') then '2'
             when contains(location_type, 'Commerci') then '3' when contains(location_type, 'Publi') then '4'
             else 'UNKNOWN' end as "locationType",
        cast(date_diff('day', date '0001-01-01', strptime(occurrence_start_date, '%d/%m/%Y')::date) + 1 as integer) as "ordinalDate",
        cast(string_split(occurrence_start_time, ':')[1] as integer)
             + case when contains(occurrence_start_time, 'PM') then 12 else 0 end as "time",
        case when contains(narrative, 'PREMISES-REAR') then 'PREMISES-REAR' when contains(narrative, 'PREMISES-FRONT')
             then 'PREMISES-FRONT' when contains(narrative, 'PREMISES-SIDE') then 'PREMISES-SIDE' else 'UNKNOWN' end as "entryLocation",
        case when regexp_matches(narrative, 'POINT OF ENTRY-DOOR|POE - DOOR') then 'POINT OF ENTRY-DOOR'
             when regexp_matches(narrative, 'POINT OF ENTRY-WINDOW|POE - WINDOW') then 'POINT OF ENTRY-WINDOW'
             when regexp_matches(narrative, 'POINT OF ENTRY-FENCE|POE - FENCE') then 'POINT OF ENTRY-FENCE'
             when contains(narrative, 'POE - GARAGE') then 'POINT OF ENTRY-DOOR: GARAGE' else 'UNKNOWN' end as "entryPoint",
        cast(isodow(strptime(occurrence_start_date, '%d/%m/%Y')) - 1 as integer) as "dayOfWeek",
        nztm_location_northing || '-' || nztm_location_easting as "northingEasting",
        "methodOfEntry",
        cast({_sql_net('"methodOfEntry"', _MESSY)} > 0 as integer) as messy,
        cast({_sql_net('narrative', _SECURE)} > 0 as integer) as "propertySecure"
        from described)"""

_COLUMNS = """"locationType", "ordinalDate", "time", "entryLocation", "entryPoint", "dayOfWeek", "northingEasting",
    "methodOfEntry", messy, "propertySecure\""""

_BLOCKED = f"""
    {_FEATURES},
    known as (select * from features where occurrence_year < {NEW_FROM}),
    new as (select * from features where occurrence_year >= {NEW_FROM})"""


def _sql_nominal(name: str) -> str:
    return f"""case when cast(x."{name}" as varchar) <> 'UNKNOWN' and cast(y."{name}" as varchar) <> 'UNKNOWN'
        then cast(x."{name}" = y."{name}" as integer) end as "{name}\""""


def _sql_circular(name: str, period: int) -> str:
    return f"""cast(least(abs(x."{name}" - y."{name}"), {period} - abs(x."{name}" - y."{name}")) as integer) as "{name}\""""


_RAW = f"""
    {_BLOCKED},
    raw as (select {_sql_nominal("locationType")}, cast(abs(x."ordinalDate" - y."ordinalDate") as integer) as "ordinalDate",
        {_sql_circular("time", 24)}, {_sql_nominal("entryLocation")}, {_sql_nominal("entryPoint")},
        {_sql_circular("dayOfWeek", 7)},
        cast(trunc(sqrt(power(string_split(x."northingEasting", '-')[1]::double - string_split(y."northingEasting", '-')[1]::double, 2)
             + power(string_split(x."northingEasting", '-')[2]::double - string_split(y."northingEasting", '-')[2]::double, 2)))
             as integer) as "northingEasting",
        {_sql_nominal("messy")}, {_sql_nominal("propertySecure")},
        1.0::double as weight, cast(1 as integer) as "class", x.crime_id || '+' || y.crime_id as crime_pair
        from new x join known y using (place))"""

_NINE = ["locationType", "ordinalDate", "time", "entryLocation", "entryPoint", "dayOfWeek", "northingEasting", "messy", "propertySecure"]

_GROUPS = """
    edges as (select distinct cast(l_orderkey as varchar) as crime_id, cast(l_partkey as varchar) as person_id from lineitem {0}),
    met as (select a.crime_id as c1, b.crime_id as c2, string_agg(person_id, '+' order by person_id) as "group"
                 from edges a join edges b using (person_id) where a.crime_id <> b.crime_id group by 1, 2),
    groups as (select "group", c1 as crime_id, count(*) as partners from met group by 1, 2)"""


def _sql_drawn(seed: int, *columns: str) -> str:
    return f"cast('0x' || left(md5(concat_ws('|', '{seed}', {', '.join(columns)})), 12) as bigint)"


ORACLES = {
    "report_features": f"with {_FEATURES} select crime_id, {_COLUMNS} from features",
    "report_details": f"""
        with reports as ({SQL_REPORTS})
        select crime_id, case when place % 7 = 0 then '4' else 'UNKNOWN' end as signature,
               cast(string_split(occurrence_start_time, ':')[1] as integer) % 12
               + case when contains(occurrence_start_time, 'PM') then 12 else 0 end as hour,
               cast({_sql_net('narrative', _MESSY)} as integer) as net_messy
        from reports""",
    "co_entity_groups": f"""with {_GROUPS.format("")} select "group", crime_id, partners from groups""",
    "co_entity_groups_without": f"""
        with {_GROUPS.format("where l_orderkey <> 13781")} select "group", count(*) as size from groups group by "group\"""",
    "group_stats": f"""
        with {_GROUPS.format("")}, sizes as (select count(*) as n from groups group by "group")
        select count(*) as n_groups, cast(sum(n * (n - 1) / 2) as bigint) as n_linked,
               cast(ceil(sum(n * (n - 1) / 2) / count(*)) as bigint) as n_select from sizes""",
    "positive_pairs": f"""
        with {_GROUPS.format("")}, sized as (select "group", crime_id, count(*) over (partition by "group") as n from groups)
        select "group", count(*) as n_pairs, round(sum(1 / a.n::double), 6) as weight,
               cast(sum(cast('0x' || left(md5(a.crime_id || '+' || b.crime_id), 12) as bigint)) as bigint) as digest
        from sized a join sized b using ("group") where a.crime_id < b.crime_id group by "group\"""",
    "negative_pairs": f"""
        with {_GROUPS.format("")}, sizes as (select "group", count(*) as n from groups group by "group"),
        k as (select least(cast(ceil(sum(n * (n - 1) / 2) / count(*)) as bigint), count(*) - 1) as k from sizes)
        select "group", n * k as n_pairs from sizes, k where k > 0""",
    "negative_pairs_of_groups": f"""
        with {_GROUPS.format("")}, sizes as (select count(*) as n from groups group by "group"),
        k as (select least(cast(ceil(sum(n * (n - 1) / 2) / count(*)) as bigint), count(*) - 1) as n_pairs from sizes)
        select "group", crime_id, n_pairs from groups, k where n_pairs > 0""",
    "negative_pairs_digest": f"""
        with {_GROUPS.format("")},
        sizes as (select "group", count(*) as size, {_sql_drawn(1, '"group"')} as g from groups group by "group"),
        facts as (select count(*) as total, least(cast(ceil(sum(size * (size - 1) / 2) / count(*)) as bigint), count(*) - 1) as k from sizes),
        numbers as materialized (select "group", size, row_number() over (order by g, "group") - 1 as number from sizes),
        members as materialized (select "group", crime_id, number, size, row_number() over (partition by "group"
                    order by {_sql_drawn(1, "crime_id")}, crime_id) - 1 as place from groups join numbers using ("group")),
        targets as (select "group", crime_id, total, number, {_sql_drawn(1, "crime_id", '"group"')} % (total - 1) as start,
                    unnest(range(k)) as i from members, facts where k > 0),
        picks as (select "group", crime_id, (number + 1 + (start + i) % (total - 1)) % total as number,
                  {_sql_drawn(2, "crime_id", '"group"', "cast(i as varchar)")} as draw from targets),
        placed as materialized (select p."group", crime_id, p.number, draw % size as place from picks p join numbers n on n.number = p.number)
        select p."group", count(*) as n_pairs, cast(count(*) as double) as weight, cast(0 as integer) as "class",
               cast(sum({_sql_drawn(0, "p.crime_id", "m.crime_id")}) as bigint) as digest
        from placed p join members m on m.number = p.number and m.place = p.place
        group by p."group\"""",
    "test_pairs": f"""
        with {_BLOCKED} select x.crime_id as crime_id1, y.crime_id as crime_id2, 1.0::double as weight, cast(1 as integer) as "class"
        from new x join known y using (place)""",
    "block_sizes": f"""
        with {_BLOCKED}, a as (select place, count(*) as n_new from new group by place),
        b as (select place, count(*) as n_known from known group by place)
        select place, n_new, n_known, n_new * n_known as n_pairs from a join b using (place)""",
    "pair_features": f"with {_RAW} select * from raw",
    "scaled_pairs": f"""
        with {_RAW},
        filled as (select crime_pair, weight, "class", {", ".join(
            f'coalesce("{c}", (select round_even(avg("{c}"), 0) from raw))::double as v{i}' for i, c in enumerate(_NINE))} from raw)
        select crime_pair, weight, "class", {", ".join(
            f'''round(case when max(v{i}) over () = min(v{i}) over () then 0.5
                else (v{i} - min(v{i}) over ()) / (max(v{i}) over () - min(v{i}) over ()) end, 6) as x{i}''' for i in range(9))}
        from filled""",
    "unmatched_pairs": f"""
        with {_BLOCKED} select count(*) as n_dropped from new x join known y using (place) where y.messy <> 1""",
    "list_similarity": f"""
        with turns as (select conv_id, turn, {SQL_TOKENS} as t from conversations),
        counts as (select conv_id, turn, w, count(*) as n from (select conv_id, turn, unnest(t) as w from turns) group by 1, 2, 3),
        equal as (select a.conv_id, a.turn, sum(a.n * b.n) as s from counts a
                  join counts b on b.conv_id = a.conv_id and b.turn = a.turn + 1 and b.w = a.w group by 1, 2)
        select a.conv_id, a.turn, case when len(a.t) > 0 and len(b.t) > 0
               then round(coalesce(s, 0)::double / ((len(a.t) + 1) * (len(b.t) + 1)), 9) end as similarity
        from turns a join turns b on b.conv_id = a.conv_id and b.turn = a.turn + 1
        left join equal e on e.conv_id = a.conv_id and e.turn = a.turn""",
    "leakless_split": """
        with recursive pairs as (select 'O' || l_orderkey as id1, 'P' || l_partkey as id2 from lineitem where l_quantity = 50),
        ties as (select id1 as a, id2 as b from pairs union select id2, id1 from pairs),
        reached(id, other) as (select a, a from ties union select id, b from reached join ties on other = a),
        named as (select id, min(other) as component from reached group by id),
        sizes as (select component, count(*) as n from pairs join named on id = id1 group by component),
        laid as (select component, n, sum(n) over (order by md5(component || '|12345'), component) as upto from sizes)
        select id, component, case when 2 * upto - n >= 1.6::double * (select count(*) from pairs) then 1 else 0 end as part
        from named join laid using (component)""",
    "additive_similarity": """
        with together as (select string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[2] as b, count(*) as n
                          from part group by 1, 2),
        alike as (select a, b, n / (select count(*) from part)::double as sim from together),
        words as (select l_orderkey as k, unnest(string_split(p_name, ' ')) as w from lineitem join part on p_partkey = l_partkey),
        sizes as (select k, count(*) as n from words group by k),
        counts as (select k, w, count(*) as n from words group by 1, 2),
        sums as (select x.k as id1, y.k as id2, sum(sim * x.n * y.n) as total
                 from counts x join alike on a = x.w join counts y on y.k = x.k + 1 and y.w = b group by 1, 2)
        select x.o_orderkey as id1, y.o_orderkey as id2, round(coalesce(total, 0) / (s1.n * s2.n), 12) as score
        from orders x join orders y on y.o_orderkey = x.o_orderkey + 1
        left join sums on id1 = x.o_orderkey left join sizes s1 on s1.k = x.o_orderkey left join sizes s2 on s2.k = y.o_orderkey""",
}

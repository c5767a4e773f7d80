"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions.text import regex_tokens
from textweave.sources.files import spread


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, text)`` of all documents, on all cores."""
    return spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, tokens)`` of all documents."""
    return documents(spark, sf).select("doc_id", regex_tokens(F.col("text")).alias("tokens"))


def digest(words: str | Column) -> Column:
    """A fingerprint of a token list, order included."""
    return F.md5(F.concat_ws("\x1f", words))


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name).cast("double"), digits).alias(name)


# The same tokens in SQL.
SQL_TOKENS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"

# Synthetic crime reports over the orders: one text for Spark and for the check.
REPORTS = """
select concat('C', cast(o_orderkey as string)) crime_id,
 case mod(o_orderkey,5) when 0 then 'Farm' when 1 then 'Residential' when 2 then 'Commercial'
                        when 3 then 'Public place' else 'Other' end location_type,
 concat(lpad(cast(day(o_orderdate) as string),2,'0'),'/',lpad(cast(month(o_orderdate) as string),2,'0'),'/',
        cast(year(o_orderdate) as string)) occurrence_start_date,
 concat(cast(1+mod(o_orderkey,12) as string),':30 ',case when mod(o_custkey,2)=0 then 'AM' else 'PM' end) occurrence_start_time,
 cast(5000000+mod(o_custkey,1000) as string) nztm_location_northing,
 cast(1700000+mod(o_orderkey,1000) as string) nztm_location_easting,
 concat('HEADER __________________________________ CREATED BY X NARRATIVE: POE - ',
   case mod(o_orderkey,4) when 0 then 'DOOR' when 1 then 'WINDOW' when 2 then 'FENCE' else 'GARAGE' end,
   ' AT PREMISES-', case mod(o_custkey,4) when 0 then 'REAR' when 1 then 'FRONT' when 2 then 'SIDE' else 'ROOF' end,
   '. ROOM ', case mod(o_orderkey,3) when 0 then 'MESSY' when 1 then 'NOT MESSY' else 'TIDY' end,
   '. HOUSE ', case mod(o_custkey,3) when 0 then 'LOCKED' when 1 then 'NOT LOCKED' else 'OPEN' end, '. * END') narrative,
 o_custkey place,
 year(o_orderdate) occurrence_year
from {orders}
"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(REPORTS, orders=spread(load(spark, sf, "orders"), "o_orderkey"))


SQL_REPORTS = REPORTS.replace("{orders}", "orders")

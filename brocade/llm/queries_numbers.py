"""Queries of problem 1."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brocade.llm.percentiles import combine, percentiles, summarise
from brocade.sources.tables import table

TARGETS = {"p05": (5, 100), "p10": (10, 100), "p25": (25, 100), "p50": (50, 100), "p75": (75, 100), "p90": (90, 100), "p95": (95, 100), "p99": (99, 100)}


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def map_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """location_key, ward_new_map_key, district_old_map_key: the crosswalk's name, else the name in NFC."""
    places = table(spark, sf_dir, "dim_location", ["location_key", "ward_new", "district_old"])
    places = places.select("location_key", nfc("ward_new").alias("ward_nfc"), nfc("district_old").alias("district_nfc"))
    # one name of a ward or district gives one map name; both tables are fixed lists of a few rows
    ward = table(spark, sf_dir, "map_ward_geo_crosswalk").groupBy(nfc("ward_new").alias("ward_nfc")).agg(F.min("geojson_ten_day_du").alias("ward_map"))
    district = table(spark, sf_dir, "map_district_geo_crosswalk").groupBy(nfc("district_old").alias("district_nfc")).agg(F.min("geojson_ten_day_du").alias("district_map"))
    return places.join(ward, "ward_nfc", "left").join(district, "district_nfc", "left").select(
        "location_key",
        F.coalesce("ward_map", "ward_nfc").alias("ward_new_map_key"),
        F.coalesce("district_map", "district_nfc").alias("district_old_map_key"),
    )


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """price_per_m2_vnd per ward_new_map_key and per district_old_map_key, in đồng to 4 significant digits.

    The facts are counted by (location_key, value) before they meet the locations, so a location that
    holds a large part of the rows enters the join with a bounded number of rows. Facts of no known
    location come out under a null key."""
    facts = table(spark, sf_dir, "fact_listing_price", ["location_key", "price_per_m2_vnd"])
    return _by_map_key(spark, sf_dir, summarise(facts, ["location_key"], "price_per_m2_vnd", decimals=2))


def p1_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles from summaries made month by month (of valid_from) and combined."""
    facts = table(spark, sf_dir, "fact_listing_price", ["location_key", "price_per_m2_vnd", "valid_from"])
    months = summarise(facts.withColumn("month", F.trunc("valid_from", "MM")), ["month", "location_key"], "price_per_m2_vnd", decimals=2)
    return _by_map_key(spark, sf_dir, combine(months.drop("month"), ["location_key"]))


def _by_map_key(spark: SparkSession, sf_dir: str, by_place: DataFrame) -> DataFrame:
    keyed = by_place.join(map_keys(spark, sf_dir), "location_key", "left").select(
        F.explode(
            F.array(
                F.struct(F.lit("ward_new").alias("level"), F.col("ward_new_map_key").alias("map_key")),
                F.struct(F.lit("district_old").alias("level"), F.col("district_old_map_key").alias("map_key")),
            )
        ).alias("k"), "v", "n",
    )
    summary = combine(keyed.select("k.level", "k.map_key", "v", "n"), ["level", "map_key"])
    out = percentiles(summary, ["level", "map_key"], TARGETS)
    return out.select("level", "map_key", "n", *[(F.col(t) / F.lit(100)).cast("decimal(18,2)").alias(t) for t in TARGETS])


QUERIES = {"p1_percentiles": p1_percentiles, "p1_of_months": p1_of_months}
SQL = {
    "p1_percentiles": """
with ward as (select nfc_normalize(ward_new) as k, min(geojson_ten_day_du) as m from map_ward_geo_crosswalk group by 1),
district as (select nfc_normalize(district_old) as k, min(geojson_ten_day_du) as m from map_district_geo_crosswalk group by 1),
place as (select l.location_key, coalesce(w.m, nfc_normalize(l.ward_new)) as wk, coalesce(d.m, nfc_normalize(l.district_old)) as dk
  from dim_location l left join ward w on w.k = nfc_normalize(l.ward_new) left join district d on d.k = nfc_normalize(l.district_old)),
cents as (select location_key, cast(price_per_m2_vnd * 100 as bigint) as c from fact_listing_price where price_per_m2_vnd is not null),
unit as (select *, cast(pow(10, greatest(length(cast(abs(c) as varchar)) - 4, 0)) as bigint) as u from cents),
rounded as (select location_key, sign(c) * ((abs(c) + u // 2) // u) * u as v from unit),
keyed as (
  select 'ward_new' as level, p.wk as map_key, v from rounded r left join place p using (location_key)
  union all select 'district_old', p.dk, v from rounded r left join place p using (location_key))
select level, map_key, count(*) as n, """
    + ", ".join(f"cast(quantile_disc(v, {p / q}) as double) / 100 as {name}" for name, (p, q) in TARGETS.items())
    + " from keyed group by level, map_key"
}
SQL["p1_of_months"] = SQL["p1_percentiles"]

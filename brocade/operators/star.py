"""Dimensions and fact of the listing star. Dimensions are insert-only: keys, once given, stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brocade.functions.exprs import date_key, feature_key, infer_source

LOCATION = {
    "province_new": "address_province_new", "ward_new": "address_ward_new", "province_old": "address_province_old",
    "ward_old": "address_ward_old", "district_old": "address_district_old", "street": "address_street_new",
}
FEATURES = ("orientation", "legal_status", "has_dining_room", "has_kitchen", "has_rooftop", "has_car_parking", "owner_direct")
MEASURES = (
    "price_vnd", "price_per_m2_vnd", "area_m2", "bedrooms", "floors", "length_m", "width_m", "street_width_m", "price_is_negotiable",
    "price_is_outlier", "area_is_undetermined", "area_is_outlier", "has_warning", "is_expired",
)


def dim_date(history: DataFrame) -> DataFrame:
    """date_key, full_date: every day from the first to the last posted_date; none for an empty history."""
    ends = history.agg(F.min("posted_date").alias("a"), F.max("posted_date").alias("b")).where("a is not null")
    days = ends.select(F.explode(F.sequence("a", "b")).alias("full_date"))
    return days.select(date_key(F.col("full_date")).alias("date_key"), "full_date")


def locations(history: DataFrame) -> DataFrame:
    """The distinct six-part locations; null parts are ''."""
    return history.select(*[F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in LOCATION.items()]).distinct()


def property_types(history: DataFrame) -> DataFrame:
    return history.select(F.col("property_type").alias("property_type_name"), "listing_type").distinct()


def sources(history: DataFrame) -> DataFrame:
    return history.select(infer_source(F.col("source_bronze_key")).alias("source_name"), "source_part").distinct()


def features(history: DataFrame) -> DataFrame:
    """feature_key and the seven feature columns; null texts are ''."""
    filled = history.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in FEATURES[:2]], *FEATURES[2:]).distinct()
    return filled.withColumn("feature_key", feature_key())


def insert_ignore(existing: DataFrame, found: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """existing and, after its greatest key, the natural keys it lacks in their order.

    New keys are numbered within ranges of a range sort and shifted by the ranges before, so no task sees
    them all; the order makes them the same whenever the same rows come again."""
    from brocade.session import cut

    new = found.join(existing, [found[c].eqNullSafe(existing[c]) for c in natural], "left_anti").select(*natural)
    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(new.repartitionByRange(n, *natural).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("__part", before.alias("__before"))  # one row per range
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*natural)) + F.col("__before") + F.col("__top")
    numbered = ranged.join(F.broadcast(shift), "__part").crossJoin(F.broadcast(top)).select(number.cast("bigint").alias(key), *natural)
    return existing.select(key, *natural).unionByName(numbered)


def fact(history: DataFrame, location: DataFrame, property_type: DataFrame, source: DataFrame) -> DataFrame:
    """One row per version with its dimension keys. The feature key is computed, not joined: its columns
    can be null. Versions that lack a dimension are left out, as `quality.diagnose` counts."""
    keyed = history.select(
        "listing_key", "listing_id", "valid_from", "valid_to", "is_current", *MEASURES, "property_type", "listing_type", "source_part",
        *[F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in LOCATION.items()],
        feature_key().alias("feature_key"), infer_source(F.col("source_bronze_key")).alias("source_name"), date_key(F.col("posted_date")).alias("posted_date_key"),
    )
    joined = (
        keyed.join(location.select("location_key", *LOCATION), list(LOCATION))
        .join(property_type.withColumnRenamed("property_type_name", "property_type"), ["property_type", "listing_type"])
        .join(source, ["source_name", "source_part"])
    )
    return joined.select(
        "listing_key", "listing_id", "location_key", "property_type_key", "feature_key", "source_key", "posted_date_key",
        "valid_from", "valid_to", "is_current", *MEASURES,
    )


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of existing whose key isn't among them."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)

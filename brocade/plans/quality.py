"""Checks after a load, and what joins would lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brocade.functions.exprs import infer_source
from brocade.functions.listing_page import LEAST_AREA, MOST_AREA, MOST_PER_M2
from brocade.operators.star import LOCATION


def _rows(checks: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    made = [F.struct(F.lit(n).alias("check_name"), F.col(e).cast("bigint").alias("expected"), F.col(a).cast("bigint").alias("actual")) for n, (e, a) in pairs.items()]
    return checks.select(F.inline(F.array(*made))).select("check_name", "expected", "actual", (F.col("expected") == F.col("actual")).alias("passed"))


def validate(history: DataFrame, facts: DataFrame) -> DataFrame:
    """check_name, expected, actual, passed: one pass over the facts, one count of the history, one count of
    doubly current listings."""

    def count(c: Column) -> Column:
        return F.count(F.when(c, F.lit(1)))

    keys = ("location_key", "property_type_key", "feature_key", "source_key", "posted_date_key")
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    area = F.col("area_m2")
    one = facts.agg(
        F.count(F.lit(1)).alias("facts"), count(no_key).alias("no_key"), F.lit(0).alias("zero"),
        count((F.col("price_per_m2_vnd") > MOST_PER_M2) & ~F.col("price_is_outlier")).alias("unflagged"),
        count(~F.col("area_is_outlier") & ((area < LEAST_AREA) | (area > MOST_AREA))).alias("area"),
    )
    twice = facts.where("is_current").groupBy("listing_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("twice"))
    versions = history.agg(F.count(F.lit(1)).alias("versions"))
    return _rows(
        one.crossJoin(twice).crossJoin(versions),  # three rows of totals
        {
            "row_count_match": ("versions", "facts"), "is_current_unique_per_listing": ("zero", "twice"), "fact_fk_not_null": ("zero", "no_key"),
            "price_per_m2_extreme_all_flagged": ("zero", "unflagged"), "area_within_sanitized_bounds": ("zero", "area"),
        },
    )


def require_valid(checks: DataFrame) -> None:
    """Raises with the names of the checks that failed (five rows are read)."""
    if failed := [r["check_name"] for r in checks.where(~F.col("passed")).collect()]:
        raise ValueError(f"load checks failed: {', '.join(failed)}")


def diagnose(history: DataFrame, location: DataFrame, property_type: DataFrame, source: DataFrame) -> DataFrame:
    """join_target, orphan_count, orphan_with_real_null: versions without a row in a dimension; the last row
    counts the versions that find all three."""
    h = history.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in LOCATION.items()], "property_type", "listing_type", "source_part",
        infer_source(F.col("source_bronze_key")).alias("source_name"),
        F.greatest(*[F.col(c).isNull().cast("int") for c in LOCATION.values()]).alias("null_place"),
        (F.col("property_type").isNull() | F.col("listing_type").isNull()).cast("int").alias("null_type"),
    )
    marked = (
        h.join(location.select(*LOCATION).distinct().withColumn("l", F.lit(1)), list(LOCATION), "left")
        .join(property_type.select(F.col("property_type_name").alias("property_type"), "listing_type").distinct().withColumn("t", F.lit(1)), ["property_type", "listing_type"], "left")
        .join(source.select("source_name", "source_part").distinct().withColumn("s", F.lit(1)), ["source_name", "source_part"], "left")
    )

    def count(c: Column) -> Column:
        return F.count(F.when(c, F.lit(1)))

    sums = marked.agg(
        count(F.col("l").isNull()).alias("no_l"), count(F.col("l").isNull() & (F.col("null_place") == 1)).alias("null_l"),
        count(F.col("t").isNull()).alias("no_t"), count(F.col("t").isNull() & (F.col("null_type") == 1)).alias("null_t"),
        count(F.col("s").isNull()).alias("no_s"), count(F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("s").isNotNull()).alias("all3"),
    )
    rows = [("dim_location", "no_l", "null_l"), ("dim_property_type", "no_t", "null_t"), ("dim_source", "no_s", None), ("joined_all_3_dims", "all3", None)]
    made = [F.struct(F.lit(n).alias("join_target"), F.col(c).alias("orphan_count"), (F.col(z) if z else F.lit(0)).cast("bigint").alias("orphan_with_real_null")) for n, c, z in rows]
    return sums.select(F.inline(F.array(*made)))

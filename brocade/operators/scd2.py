"""The batch merge of staged listing observations into a kept history, as the loader's contract has it.

Unlike `history.type_two_merge`, which rebuilds periods from all evidence, kept versions are taken as they stand:
each batch row is compared with the row before it, kept or staged; where the hash differs it opens a version,
the first one closes the listing's current version, and a batch row that repeats the hash before it moves the current
version's last_seen_at forward. Late rows open versions too. Everything is one ordered pass over both tables,
keyed by listing: kept rows carry their columns along and leave updated, staged rows leave as new versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brocade.functions.exprs import row_hash
from brocade.operators.skew import hot_keys, over_key, with_neighbour

KEEP = ("price_vnd", "price_is_negotiable", "is_expired", "has_warning", "area_m2")
PERIOD = ("valid_to", "is_current", "last_seen_at")


def compare(batch: DataFrame, kept: DataFrame) -> tuple[DataFrame, list]:
    """listing_id, at, origin, row_hash, tie, prev_hash, act and the kept rows' PERIOD; and the hot listings. act is
    'opens' or 'repeats' for batch rows, null for kept ones. At one moment the kept version comes first; further
    ties by hash and key."""
    staged = batch.select(
        "listing_id", F.col("crawl_date").alias("at"), F.lit("staging").alias("origin"), row_hash().alias("row_hash"), F.col("obs_id").alias("tie"),
        *[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in PERIOD],
    )
    anchors = kept.select("listing_id", F.col("valid_from").alias("at"), F.lit("anchor").alias("origin"), row_hash().alias("row_hash"), F.col("listing_key").alias("tie"), *PERIOD)
    rows = staged.unionByName(anchors)
    hot = hot_keys(rows, "listing_id")
    seen = with_neighbour(rows, "listing_id", ["at", "origin", "row_hash", "tie"], "row_hash", "prev_hash", hot)
    same = F.col("prev_hash").eqNullSafe(F.col("row_hash"))
    return seen.withColumn("act", F.when(F.col("origin") == "staging", F.when(same, F.lit("repeats")).otherwise(F.lit("opens")))), hot


def opened(rows: DataFrame, hot: list) -> DataFrame:
    """The batch rows that open a version, with next_at, the start of the listing's next one."""
    return with_neighbour(rows.where("act = 'opens'"), "listing_id", ["at", "row_hash", "tie"], "at", "next_at", hot, ahead=True)


def repeated(rows: DataFrame) -> DataFrame:
    """listing_id, last_at: the last batch row that repeats the row before it."""
    return rows.where("act = 'repeats'").groupBy("listing_id").agg(F.max("at").alias("last_at"))


def merge(batch: DataFrame, kept: DataFrame) -> DataFrame:
    """The history after the batch: listing_id, row_hash, valid_from, valid_to, is_current, last_seen_at, is_new."""
    compared, hot = compare(batch, kept)
    at = lambda act: F.when(F.col("act") == act, F.col("at"))
    rows = over_key(compared, "listing_id", {"first_at": F.min(at("opens")), "last_at": F.max(at("repeats"))}, hot)
    closes = F.col("is_current") & F.col("first_at").isNotNull()
    old = rows.where("origin = 'anchor'").select(
        "listing_id", "row_hash", F.col("at").alias("valid_from"), F.when(closes, F.col("first_at")).otherwise(F.col("valid_to")).alias("valid_to"),
        (F.col("is_current") & ~F.coalesce(closes, F.lit(False))).alias("is_current"), "last_seen_at", F.lit(False).alias("is_new"), "last_at",
    )
    new = opened(rows, hot).select(
        "listing_id", "row_hash", F.col("at").alias("valid_from"), F.col("next_at").alias("valid_to"), F.col("next_at").isNull().alias("is_current"),
        F.col("at").alias("last_seen_at"), F.lit(True).alias("is_new"), "last_at",
    )
    seen = F.when(F.col("is_current") & (F.col("last_at") > F.col("last_seen_at")), F.col("last_at")).otherwise(F.col("last_seen_at"))
    return old.unionByName(new).withColumn("last_seen_at", seen).drop("last_at")

"""The flat report view over the star, and its thirteen cards with their optional filters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brocade.functions.exprs import infer_source, nfc
from brocade.operators.ranks import percentile_cont
from brocade.operators.star import FEATURES, MEASURES, dim_date, features
from brocade.session import keep, there
from brocade.sources.tables import table

_PLACES = ("province_new", "ward_new", "province_old", "ward_old", "district_old", "street", "ward_new_map_key", "district_old_map_key")
_TYPE = ("property_type_name", "listing_type")
_SOURCE = ("source_name", "source_part")


def map_keyed_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dim_location with ward_new_map_key and district_old_map_key: the crosswalk's name, else the NFC name."""
    out = table(spark, sf_dir, "dim_location")
    for column in ("ward_new", "district_old"):
        walk = table(spark, sf_dir, "map_ward_geo_crosswalk" if column == "ward_new" else "map_district_geo_crosswalk")
        names = walk.groupBy(nfc(column).alias("__nfc")).agg(F.min("geojson_ten_day_du").alias("__map"))
        keyed = out.withColumn("__nfc", nfc(column)).join(names, "__nfc", "left")
        out = keyed.withColumn(f"{column}_map_key", F.coalesce("__map", "__nfc")).drop("__map", "__nfc")
    return out


_KEPT: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A rebuilt dimension, written once per application and load and read from there by every card."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT or not there(spark, _KEPT[key][0]):
        _KEPT[key] = keep(build())
    return _KEPT[key][1]


def rebuilt_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """property_type_key, property_type_name, listing_type from the versions that are still kept."""
    return _once(spark, sf_dir, "types", lambda: _named_by_versions(spark, sf_dir, "property_type_key", {"property_type_name": F.col("property_type"), "listing_type": F.col("listing_type")}))


def rebuilt_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_key, source_name, source_part, likewise."""
    return _once(spark, sf_dir, "sources", lambda: _named_by_versions(spark, sf_dir, "source_key", {"source_name": infer_source(F.col("source_bronze_key")), "source_part": F.col("source_part")}))


def _named_by_versions(spark: SparkSession, sf_dir: str, key: str, names: Mapping[str, Column]) -> DataFrame:
    """key and names: what most of the kept versions under a dimension key are called."""
    facts = table(spark, sf_dir, "fact_listing_price", ["listing_key", key])
    kept = table(spark, sf_dir, "listing_history").select("listing_key", *[c.alias(n) for n, c in names.items()])
    votes = facts.join(kept, "listing_key").groupBy(key, *names).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("n", *names)).alias("t"))
    return best.select(key, *[F.col(f"t.{n}").alias(n) for n in names])


def rebuilt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "features", lambda: features(table(spark, sf_dir, "listing_history")))


def report_view(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of the view. Only dimensions that are asked for are joined; facts without a row in
    such a dimension are left out."""
    wanted = set(columns)
    view = table(spark, sf_dir, "fact_listing_price").withColumn("posted_date", F.to_date(F.col("posted_date_key").cast("string"), "yyyyMMdd"))
    if wanted & set(_PLACES):
        view = view.join(map_keyed_locations(spark, sf_dir).select("location_key", *[p for p in _PLACES if p in wanted]), "location_key")
    if wanted & set(_TYPE):
        view = view.join(rebuilt_types(spark, sf_dir), "property_type_key")
    if wanted & set(_SOURCE):
        view = view.join(rebuilt_sources(spark, sf_dir), "source_key")
    if wanted & set(FEATURES):
        view = view.join(rebuilt_features(spark, sf_dir), "feature_key")
    if "full_date" in wanted:
        view = view.join(dim_date(table(spark, sf_dir, "listing_history", ["posted_date"])).withColumnRenamed("date_key", "posted_date_key"), "posted_date_key")
    return view.select(*columns)


def full_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the view, over all five dimensions; posted_date is the date dimension's."""
    columns = ["listing_key", "listing_id", *MEASURES, "is_current", "valid_from", "valid_to", "full_date", *_PLACES, *_TYPE, *_SOURCE, *FEATURES]
    return report_view(spark, sf_dir, columns).withColumnRenamed("full_date", "posted_date")


class Filters:
    """The cards' optional filters; None leaves one out. posted: (first day, last day)."""

    def __init__(self, posted: tuple[date, date] | None = None, listing_type: str | None = None, property_type: str | None = None, ward: str | None = None, district: str | None = None) -> None:
        self.posted = posted
        self.equal = {
            k: v
            for k, v in {"listing_type": listing_type, "property_type_name": property_type, "ward_new_map_key": ward, "district_old_map_key": district}.items()
            if v is not None
        }

    def columns(self) -> list[str]:
        return (["posted_date"] if self.posted else []) + list(self.equal)

    def apply(self, view: DataFrame) -> DataFrame:
        if self.posted:
            view = view.where(F.col("posted_date").between(*self.posted))
        for column, value in self.equal.items():
            view = view.where(F.col(column) == value)
        return view


PRICE = "price_per_m2_vnd"
_FLAGS = ("price_is_negotiable", "price_is_outlier", "area_is_outlier", "area_is_undetermined")


def _millions(value: Column) -> Column:
    return F.round(value.cast("double") / 1e6, 2)


def _mean(column: str) -> Column:
    """The mean of a decimal column as double; summed exactly, so that it doesn't depend on the order of rows."""
    return F.sum(column).cast("double") / F.count(column)


def _average() -> Column:
    return _millions(_mean(PRICE)).alias("avg_million_per_m2")


def _with_median(rows: DataFrame, groups: Sequence[str], others: DataFrame | None = None) -> DataFrame:
    """others (one row a group) with the median of the rows' prices; without others the median alone."""
    middle = percentile_cont(rows, groups, PRICE, 0.5, "__median")
    joined = middle if others is None else others.join(middle, list(groups), "left")
    return joined.withColumn("median_million_per_m2", _millions(F.col("__median"))).drop("__median")


def _count() -> Column:
    return F.count(F.lit(1)).alias("listings")


def _rows(spark: SparkSession, sf_dir: str, columns: Sequence[str], filters: Filters | None, priced: bool) -> DataFrame:
    """Current facts with the columns; priced: without flagged prices and areas."""
    filters = filters or Filters()
    names = dict.fromkeys([*columns, *filters.columns(), "is_current", *(_FLAGS if priced else ())])
    view = filters.apply(report_view(spark, sf_dir, list(names))).where("is_current")
    for flag in _FLAGS if priced else ():
        view = view.where(~F.col(flag))
    return view.select(*columns)


def card_01(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Current listings."""
    return _rows(spark, sf_dir, ["listing_id"], filters, False).agg(_count())


def card_02(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Average price per m²."""
    return _rows(spark, sf_dir, [PRICE], filters, True).agg(_average())


def card_03(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Median price per m²."""
    rows = _rows(spark, sf_dir, [PRICE], filters, True)
    return rows.agg(F.lit(0).alias("one")).join(_with_median(rows.withColumn("one", F.lit(0)), ["one"]), "one", "left").drop("one")


def _placed(spark: SparkSession, sf_dir: str, column: str, filters: Filters | None) -> DataFrame:
    return _rows(spark, sf_dir, [column, PRICE, "area_m2"], filters, True).where(F.col(column) != "")


def _by_place(spark: SparkSession, sf_dir: str, column: str, filters: Filters | None, *aggregates: Column, least: int = 5) -> DataFrame:
    return _placed(spark, sf_dir, column, filters).groupBy(column).agg(_count(), *aggregates).where(F.col("listings") >= least)


def _ten_wards(spark: SparkSession, sf_dir: str, filters: Filters | None, first: Column) -> DataFrame:
    """The ten wards that come first, with their median."""
    ten = _by_place(spark, sf_dir, "ward_new_map_key", filters, _average()).orderBy(first, "ward_new_map_key").limit(10)
    return _with_median(_placed(spark, sf_dir, "ward_new_map_key", filters), ["ward_new_map_key"], ten).orderBy(first, "ward_new_map_key")


def card_04(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Average by ward, of at least five listings."""
    return _by_place(spark, sf_dir, "ward_new_map_key", filters, _average()).orderBy(F.desc("avg_million_per_m2"), "ward_new_map_key")


def card_05(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Average by district, of at least five listings."""
    return _by_place(spark, sf_dir, "district_old_map_key", filters, _average()).orderBy(F.desc("avg_million_per_m2"), "district_old_map_key")


def card_06(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """The ten dearest wards."""
    return _ten_wards(spark, sf_dir, filters, F.desc("avg_million_per_m2"))


def card_07(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """The ten cheapest wards."""
    return _ten_wards(spark, sf_dir, filters, F.asc("avg_million_per_m2"))


def card_08(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Districts with average, median and average area, however few listings."""
    area = F.round(_mean("area_m2"), 2).alias("avg_area_m2")
    by = _by_place(spark, sf_dir, "district_old_map_key", filters, _average(), area, least=1)
    return _with_median(_placed(spark, sf_dir, "district_old_map_key", filters), ["district_old_map_key"], by).orderBy(F.desc("avg_million_per_m2"), "district_old_map_key")


def card_09(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Average by month and property type, of at least five listings."""
    rows = _rows(spark, sf_dir, ["posted_date", "property_type_name", PRICE], filters, True)
    by = rows.groupBy(F.trunc("posted_date", "MM").alias("month"), "property_type_name").agg(_count(), _average())
    return by.where("listings >= 5").select("month", "property_type_name", "avg_million_per_m2").orderBy("month", "property_type_name")


def card_10(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Listings by month."""
    return _rows(spark, sf_dir, ["posted_date"], filters, True).groupBy(F.trunc("posted_date", "MM").alias("month")).agg(_count()).orderBy("month")


def card_11(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Listings by property type."""
    return _rows(spark, sf_dir, ["property_type_name"], filters, False).groupBy("property_type_name").agg(_count()).orderBy(F.desc("listings"), "property_type_name")


def card_12(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Listings by listing type."""
    return _rows(spark, sf_dir, ["listing_type"], filters, False).groupBy("listing_type").agg(_count())


def card_13(spark: SparkSession, sf_dir: str, filters: Filters | None = None) -> DataFrame:
    """Average by property type."""
    rows = _rows(spark, sf_dir, ["property_type_name", PRICE], filters, True)
    return rows.groupBy("property_type_name").agg(_average()).orderBy(F.desc("avg_million_per_m2"), "property_type_name")


CARDS = {
    "card_01": card_01, "card_02": card_02, "card_03": card_03, "card_04": card_04, "card_05": card_05, "card_06": card_06, "card_07": card_07,
    "card_08": card_08, "card_09": card_09, "card_10": card_10, "card_11": card_11, "card_12": card_12, "card_13": card_13,
}

"""Queries of problems 4 and 6: places and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brocade.llm.addresses import Reader, same_house
from brocade.llm.places import MOST_ENTRIES, Resolver, map_values
from brocade.sources.tables import table

FIELDS = {"ward_new": "ward_new", "district_old": "district_old"}
#: A ward can stand in the district's field where an address had parts missing.
DECOYS = {"district_old": ("ward_old", "ward_new")}


def _listed(df: DataFrame) -> list:
    """The rows of a reference list, or an error if it is longer than a dictionary may be."""
    rows = df.limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a reference list of over {MOST_ENTRIES} rows doesn't fit into a task")
    return rows


def place_names(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, str]]:
    """(kind, place_id, name) of the reference and of the crosswalks' other names: fixed lists of some 440 rows."""
    ref = [(r["kind"], r["place_id"], r["name"]) for r in _listed(table(spark, sf_dir, "place_reference", ["kind", "place_id", "name"]))]
    ids = {(k, n): p for k, p, n in ref}
    for kind, name in (("ward_new", "map_ward_geo_crosswalk"), ("district_old", "map_district_geo_crosswalk")):
        other = _listed(table(spark, sf_dir, name, [kind, "geojson_ten_day_du"]))
        ref += [(kind, ids[kind, r[1]], r[0]) for r in other if (kind, r[1]) in ids and (kind, r[0]) not in ids]
    return ref


def place_resolver(spark: SparkSession, sf_dir: str) -> Resolver:
    """The dictionary with each entry's frequency among the exact names in dim_location."""
    names = place_names(spark, sf_dir)
    places = table(spark, sf_dir, "dim_location", list(FIELDS))
    seen = places.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for c, k in FIELDS.items()])))
    exact = F.broadcast(spark.createDataFrame(names, "kind string, place_id long, name string"))  # at most MOST_ENTRIES rows
    often = {(r["kind"], r["place_id"]): r["n"] for r in seen.join(exact, ["kind", "name"]).groupBy("kind", "place_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Resolver(names, DECOYS, often)


def p4_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed ward and district with the entry it means, 0 for none."""
    places = table(spark, sf_dir, "dim_location", ["location_key", *FIELDS])
    return map_values(places, "location_key", FIELDS, place_resolver(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that aren't themselves a name of their kind."""
    names = table(spark, sf_dir, "place_reference", ["kind", "name"]).select(F.col("kind").alias("field_name"), F.col("name").alias("value"))
    typed = p4_places(spark, sf_dir).where("value != ''")
    return typed.join(names, ["field_name", "value"], "left_anti").select("location_key", "field_name", "place_id")


def address_reader(spark: SparkSession, sf_dir: str) -> Reader:
    """A reader with the reference's places; the place list is fixed and short."""
    names = place_names(spark, sf_dir)
    ids = {(k, n): p for k, p, n in names}
    old = _listed(table(spark, sf_dir, "place_reference", ["place_id", "kind", "district_old", "ward_new"]).where("kind = 'ward_old'"))
    ward_now = {r["place_id"]: ids.get(("ward_new", r["ward_new"]), 0) for r in old}
    district_of = {r["place_id"]: ids.get(("district_old", r["district_old"]), 0) for r in old}
    return Reader(Resolver(names), ward_now, district_of)


ADDRESS = ("address_street_new", "address_ward_new", "address_old_raw", "address_district_old")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two listings of the batch at one house."""
    batch = table(spark, sf_dir, "listing_staging_batch", ["listing_id", *ADDRESS])
    _, pairs = same_house(batch, "listing_id", ADDRESS, address_reader(spark, sf_dir))
    return pairs.select(F.col("a").alias("listing_id_a"), F.col("b").alias("listing_id_b"))


def p6_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with a house number: its house and how many listings are there."""
    batch = table(spark, sf_dir, "listing_staging_batch", ["listing_id", *ADDRESS])
    placed, _ = same_house(batch, "listing_id", ADDRESS, address_reader(spark, sf_dir))
    size = placed.groupBy("house").agg(F.count(F.lit(1)).alias("listings"))
    return placed.join(size, "house").select(F.col("key").alias("listing_id"), "house", "listings")


QUERIES = {"p4_found": p4_found, "p4_places": p4_places, "p6_found": p6_found, "p6_houses": p6_houses}
SQL: dict[str, str] = {}

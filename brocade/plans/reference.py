"""Queries of the listing pipeline's own operators over the given tables, each with its SQL."""

from __future__ import annotations

import uuid
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brocade.functions import exprs as X
from brocade.functions.listing_page import MOST_SIDE, MOST_STREET
from brocade.operators import scd2, star
from brocade.plans import quality, report
from brocade.session import ensure_checkpoint_dir
from brocade.sources import bronze
from brocade.sources.tables import table
from brocade.streaming.ingest import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _batch(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "listing_staging_batch", ["obs_id", *columns])


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listing_history")


# scans and keys


@query("select count(*) as pages, count(html) as with_html, count(distinct url) as urls, min(epoch_us(crawl_date)) as first_us from bronze_page")
def scan_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = bronze.read_pages(spark, f"{d}/bronze_page.parquet")
    return pages.agg(
        F.count(F.lit(1)).alias("pages"), F.count("html").alias("with_html"), F.count_distinct("url").alias("urls"), F.min(F.unix_micros("crawl_date")).alias("first_us")
    )


@query("select cast(i as int) as part_number from range(1, 78) t(i)")
def parts_seed(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, bronze.PARTS + 1).select(F.col("id").cast("int").alias("part_number"))


@query(
    """with keys as (select source_bronze_key as k from parse_quarantine)
    select cast(i as int) as part_number from range(1, 78) t(i) where i not in (
      select cast(regexp_extract(k, '^bronze/dataset/part=([0-9]+)\\.parquet$', 1) as bigint) from keys where regexp_matches(k, '^bronze/dataset/part=[0-9]+\\.parquet$'))"""
)
def parts_missing(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the data set none of whose pages was ever rejected."""
    return bronze.missing_parts(table(spark, d, "parse_quarantine", ["source_bronze_key"]), "source_bronze_key")


@query(
    """with keys as (select distinct source_bronze_key as k from listing_history union select source_bronze_key || '.inprogress' from listing_staging_batch)
    select k as key from keys where k like '%.inprogress' and substr(k, 1, length(k) - 11) in (select k from keys)"""
)
def orphan_unfinished(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "listing_history", ["source_bronze_key"]).distinct()
    open_ = _batch(spark, d, "source_bronze_key").select(F.concat("source_bronze_key", F.lit(bronze.UNFINISHED))).distinct()
    return bronze.orphaned(done.union(open_).withColumnRenamed("source_bronze_key", "key"), "key")


@query("select distinct source_bronze_key as key from listing_staging_batch where source_bronze_key not in (select source_bronze_key from listing_history where source_bronze_key is not null)")
def new_files(spark: SparkSession, d: str) -> DataFrame:
    rename = {"source_bronze_key": "key"}
    return bronze.new_files(_batch(spark, d, "source_bronze_key").withColumnsRenamed(rename), _history(spark, d).withColumnsRenamed(rename), "key")


@query(
    """select p || '/' || t as combination, 'https://site.example/' || l || '-' || t || '/' || p as first_page, 'https://site.example/' || l || '-' || t || '/' || p || '/trang-3' as third_page
    from (values ('ho-chi-minh'), ('binh-duong'), ('ba-ria-vung-tau')) a(p), (values ('can-ban'), ('cho-thue')) b(l),
    (values ('nha-mat-tien'), ('nha-trong-hem'), ('biet-thu-nha-lien-ke'), ('can-ho-chung-cu'), ('phong-tro-nha-tro')) c(t)"""
)
def page_combinations(spark: SparkSession, d: str) -> DataFrame:
    each = lambda name, *values: F.explode(F.array(*map(F.lit, values))).alias(name)
    pairs = spark.range(1).select(each("p", "ho-chi-minh", "binh-duong", "ba-ria-vung-tau")).select("p", each("l", "can-ban", "cho-thue"))
    all_ = pairs.select("p", "l", each("t", "nha-mat-tien", "nha-trong-hem", "biet-thu-nha-lien-ke", "can-ho-chung-cu", "phong-tro-nha-tro"))
    url = lambda n: bronze.listing_page_url(F.col("p"), F.col("l"), F.col("t"), F.lit(n))
    return all_.select(F.concat_ws("/", "p", "t").alias("combination"), url(1).alias("first_page"), url(3).alias("third_page"))


@query()
def page_cards(spark: SparkSession, d: str) -> DataFrame:
    """Per page: its listing cards, their links, whether it ends the list and whether it asks for a captcha."""
    pages = table(spark, d, "bronze_page", ["page_id", "html"])
    asked = pages.withColumn("captcha", F.coalesce(bronze.asks_captcha(F.col("html")), F.lit(False)))
    return bronze.page_cards(asked, "page_id", "html", keep=("captcha",)).withColumn("last_page", F.col("cards") == 0)


# scalar functions


@query("select obs_id, try_cast(regexp_extract(trim(listing_url), '-([0-9]+)\\.html?\\s*$', 1) as bigint) as url_id from listing_staging_batch")
def listing_id_from_url(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d, "listing_url").select("obs_id", X.listing_id_from_url(F.col("listing_url")).alias("url_id"))


@query("select doc_id, trim(regexp_replace(text, '\\p{S}', '', 'g'), ' ') as plain from documents")
def strip_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", X.strip_symbols(F.col("text")).alias("plain"))


@query(
    """with b as (select obs_id, area_raw, trim(regexp_replace(trim(area_raw), '\\s*m[2²]?\\s*$', '', 'i')) as t from listing_staging_batch),
    c as (select obs_id, t, area_raw, case when contains(t, ',') then replace(replace(t, '.', ''), ',', '.')
      when regexp_full_match(t, '-?\\d{1,3}(\\.\\d{3})+') then replace(t, '.', '') else t end as p from b)
    select obs_id, case when lower(trim(area_raw)) not in ('', '-', '--', '---', '_', 'n/a', 'na') and lower(t) not in ('', '-', '--', '---', '_', 'n/a', 'na')
      and regexp_full_match(p, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') and cast(p as decimal(24,6)) >= 0 then cast(cast(p as decimal(24,6)) as double) end as number from c"""
)
def vn_number(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d, "area_raw").select("obs_id", X.vn_number(F.col("area_raw")).cast("double").alias("number"))


@query("select lower(trim(orientation)) in ('', '-', '--', '---', '_', 'n/a', 'na') as missing, count(*) as n from listing_staging_batch group by 1")
def missing_markers(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d, "orientation").groupBy(X.is_missing(F.col("orientation")).alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """select obs_id, case when length_m * 40 > 0 and length_m * 40 <= 500 then cast(length_m * 40 as double) end as side,
    case when street_width_m * 20 > 0 and street_width_m * 20 <= 200 then cast(street_width_m * 20 as double) end as street from listing_staging_batch"""
)
def sanitize_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Recorded sides, scaled so that the bounds bite."""
    side, street = F.col("length_m") * 40, F.col("street_width_m") * 20
    return _batch(spark, d, "length_m", "street_width_m").select(
        "obs_id", X.sanitize_dimension(side, MOST_SIDE).cast("double").alias("side"), X.sanitize_dimension(street, MOST_STREET).cast("double").alias("street")
    )


@query(
    """select obs_id, case when area_m2 * 30 between 3 and 10000 then cast(area_m2 * 30 as double) end as area, coalesce(area_m2 * 30 not between 3 and 10000, false) as outside,
    coalesce(price_vnd > 5000000000 * area_m2 / 20 and area_m2 <> 0, false) as outlier from listing_staging_batch"""
)
def sanitize_area(spark: SparkSession, d: str) -> DataFrame:
    """Recorded areas and prices, scaled so that the bounds bite."""
    area, outside = X.sanitize_area(F.col("area_m2") * 30)
    return _batch(spark, d, "area_m2", "price_vnd").select(
        "obs_id", area.cast("double").alias("area"), outside.alias("outside"), X.price_outlier(F.col("price_vnd") * 20, F.col("area_m2")).alias("outlier")
    )


@query(
    """with p as (select obs_id, string_split(address_old_raw, ',') as s from listing_staging_batch)
    select obs_id, case when len(s) >= 3 then trim(s[-3], ' ') else '' end as ward, case when len(s) >= 3 then trim(s[-2], ' ') else '' end as district,
    case when len(s) >= 3 then trim(s[-1], ' ') else '' end as province from p"""
)
def old_address(spark: SparkSession, d: str) -> DataFrame:
    names = {"ward": 3, "district": 2, "province": 1}
    return _batch(spark, d, "address_old_raw").select("obs_id", *[X.old_address_part(F.col("address_old_raw"), i).alias(n) for n, i in names.items()])


@query(
    """select case when source_bronze_key like 'bronze/dataset/%' then 'dataset' when source_bronze_key like 'bronze/web/%' then 'web' end as source_name,
    regexp_extract(source_bronze_key, '([^/]+)\\.[^./]+$', 1) as part, count(*) as n from listing_staging_batch group by 1, 2"""
)
def infer_source(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("source_bronze_key")
    return _batch(spark, d, "source_bronze_key").groupBy(X.infer_source(key).alias("source_name"), X.source_part(key).alias("part")).agg(F.count(F.lit(1)).alias("n"))


_SCOPE = "address_province_new = 'Hồ Chí Minh' and listing_type in ('Cần bán', 'Cho thuê') and property_type in ('Nhà mặt tiền', 'Nhà trong hẻm', 'Biệt thự, nhà liền kề', 'Căn hộ chung cư', 'Phòng trọ, nhà trọ')"


@query(f"select obs_id from listing_staging_batch where {_SCOPE}")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _batch(spark, d, "address_province_new", "listing_type", "property_type")
    return rows.where(X.in_scope(F.col("address_province_new"), F.col("listing_type"), F.col("property_type"))).select("obs_id")


_HASH = """md5(coalesce(cast(price_vnd as varchar), 'NULL') || '|' || coalesce(cast(price_is_negotiable as varchar), 'NULL') || '|' || coalesce(cast(is_expired as varchar), 'NULL')
    || '|' || coalesce(cast(has_warning as varchar), 'NULL') || '|' || coalesce(cast(area_m2 as varchar), 'NULL'))"""
_FEATURE = "md5(coalesce(orientation, '') || '|' || coalesce(legal_status, '')" + "".join(
    f" || '|' || coalesce(cast({c} as varchar), 'NULL')" for c in ("has_dining_room", "has_kitchen", "has_rooftop", "has_car_parking", "owner_direct")
) + ")"


@query(f"select listing_key, {_HASH} as hash from listing_history")
def row_hash(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("listing_key", X.row_hash().alias("hash"))


@query(f"select listing_key, {_FEATURE} as key from listing_history")
def feature_key(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("listing_key", X.feature_key().alias("key"))


@query(
    """select listing_key, case when not area_is_undetermined and area_m2 is not null and area_m2 <> 0 and price_vnd is not null
    then cast((2 * cast(price_vnd as hugeint) * 10000 + cast(area_m2 * 100 as hugeint)) // (2 * cast(area_m2 * 100 as hugeint)) as double) / 100 end as per_m2 from listing_history"""
)
def price_per_m2(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("listing_key", X.price_per_m2(F.col("price_vnd"), F.col("area_m2"), F.col("area_is_undetermined")).cast("double").alias("per_m2"))


@query("select location_key, nfc_normalize(ward_new) as ward, nfc_normalize(district_old) as district from dim_location")
def nfc_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dim_location").select("location_key", X.nfc("ward_new").alias("ward"), X.nfc("district_old").alias("district"))


# parsed pages: split


@query()
def pages_split(spark: SparkSession, d: str) -> DataFrame:
    """Per page of bronze_page: rejected, out of scope or staged."""
    from brocade.streaming.ingest import parse_stream

    parsed = parse_stream(table(spark, d, "bronze_page"))
    scope = X.in_scope(F.col("address_province_new"), F.col("listing_type"), F.col("property_type"))
    return parsed.select("page_id", F.when(F.col("reason_code").isNotNull(), F.lit("rejected")).when(scope, F.lit("staged")).otherwise(F.lit("out_of_scope")).alias("outcome"))


# merge of a batch into the history

_MERGE = f"""
with rows as (
  select listing_id, crawl_date as seen_at, 'staging' as origin, {_HASH} as row_hash, obs_id as tie from listing_staging_batch
  union all select listing_id, valid_from, 'anchor', {_HASH}, listing_key from listing_history),
ordered as (select *, lag(row_hash) over (partition by listing_id order by seen_at, origin, row_hash, tie) as prev_hash from rows),
points as (select listing_id, seen_at, row_hash, tie, lead(seen_at) over (partition by listing_id order by seen_at, row_hash, tie) as next_at
  from ordered where origin = 'staging' and prev_hash is distinct from row_hash),
same as (select listing_id, max(seen_at) as last_at from ordered where origin = 'staging' and prev_hash is not distinct from row_hash group by 1),
firsts as (select listing_id, min(seen_at) as first_at from points group by 1),
merged as (
  select h.listing_id, {_HASH} as row_hash, valid_from, case when is_current and first_at is not null then first_at else valid_to end as valid_to,
    is_current and not coalesce(is_current and first_at is not null, false) as is_current, last_seen_at, false as is_new
  from listing_history h left join firsts f on f.listing_id = h.listing_id
  union all select listing_id, row_hash, seen_at, next_at, next_at is null, seen_at, true from points),
final as (select m.listing_id, row_hash, valid_from, valid_to, is_current, case when is_current and last_at > last_seen_at then last_at else last_seen_at end as last_seen_at, is_new
  from merged m left join same s on s.listing_id = m.listing_id)
"""


def _staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "listing_staging_batch", ["obs_id", "listing_id", "crawl_date", *scd2.KEEP]), table(
        spark, d, "listing_history", ["listing_key", "listing_id", "valid_from", "valid_to", "is_current", "last_seen_at", *scd2.KEEP]
    )


@query(_MERGE + "select listing_id, epoch_us(seen_at) as at_us, origin, row_hash, prev_hash from ordered")
def merge_ordered(spark: SparkSession, d: str) -> DataFrame:
    return scd2.compare(*_staged(spark, d))[0].select("listing_id", F.unix_micros("at").alias("at_us"), "origin", "row_hash", "prev_hash")


@query(_MERGE + "select listing_id, epoch_us(seen_at) as at_us, epoch_us(next_at) as next_us, row_hash, next_at is null as is_latest from points")
def merge_change_points(spark: SparkSession, d: str) -> DataFrame:
    points = scd2.opened(*scd2.compare(*_staged(spark, d)))
    return points.select("listing_id", F.unix_micros("at").alias("at_us"), F.unix_micros("next_at").alias("next_us"), "row_hash", F.col("next_at").isNull().alias("is_latest"))


@query(_MERGE + "select listing_id, epoch_us(last_at) as last_us from same")
def merge_same_hash(spark: SparkSession, d: str) -> DataFrame:
    return scd2.repeated(scd2.compare(*_staged(spark, d))[0]).select("listing_id", F.unix_micros("last_at").alias("last_us"))


@query(_MERGE + "select listing_id, row_hash, epoch_us(valid_from) as from_us, epoch_us(valid_to) as to_us, is_current, epoch_us(last_seen_at) as seen_us, is_new from final")
def merge_history(spark: SparkSession, d: str) -> DataFrame:
    us = lambda c, n: F.unix_micros(c).alias(n)
    return scd2.merge(*_staged(spark, d)).select("listing_id", "row_hash", us("valid_from", "from_us"), us("valid_to", "to_us"), "is_current", us("last_seen_at", "seen_us"), "is_new")


@query(_MERGE + "select is_new, is_current, count(*) as n from final group by 1, 2")
def merge_summary(spark: SparkSession, d: str) -> DataFrame:
    return scd2.merge(*_staged(spark, d)).groupBy("is_new", "is_current").agg(F.count(F.lit(1)).alias("n"))


# star

_LOC = "coalesce(address_province_new, ''), coalesce(address_ward_new, ''), coalesce(address_province_old, ''), coalesce(address_ward_old, ''), coalesce(address_district_old, ''), coalesce(address_street_new, '')"
_SOURCE = "case when source_bronze_key like 'bronze/dataset/%' then 'dataset' when source_bronze_key like 'bronze/web/%' then 'web' end"


@query("select cast(strftime(t.day, '%Y%m%d') as int) as date_key, cast(t.day as date) as full_date from (select unnest(generate_series(min(posted_date), max(posted_date), interval 1 day)) as day from listing_history) t")
def dim_date(spark: SparkSession, d: str) -> DataFrame:
    return star.dim_date(_history(spark, d))


@query(
    f"""with known as (select province_new, ward_new, province_old, ward_old, district_old, street, location_key from dim_location),
    found as (select distinct {_LOC} from listing_history), f(province_new, ward_new, province_old, ward_old, district_old, street) as (select * from found),
    new as (select * from f where not exists (select 1 from known k where k.province_new = f.province_new and k.ward_new = f.ward_new and k.province_old = f.province_old
      and k.ward_old = f.ward_old and k.district_old = f.district_old and k.street = f.street))
    select location_key, province_new, ward_new, province_old, ward_old, district_old, street from known
    union all select (select max(location_key) from known) + row_number() over (order by province_new, ward_new, province_old, ward_old, district_old, street),
      province_new, ward_new, province_old, ward_old, district_old, street from new"""
)
def dim_location(spark: SparkSession, d: str) -> DataFrame:
    return star.insert_ignore(table(spark, d, "dim_location"), star.locations(_history(spark, d)), list(star.LOCATION), "location_key")


def _types(spark: SparkSession, d: str) -> DataFrame:
    empty = spark.createDataFrame([], "property_type_key bigint, property_type_name string, listing_type string")
    return star.insert_ignore(empty, star.property_types(_history(spark, d)), ["property_type_name", "listing_type"], "property_type_key")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    empty = spark.createDataFrame([], "source_key bigint, source_name string, source_part string")
    return star.insert_ignore(empty, star.sources(_history(spark, d)), ["source_name", "source_part"], "source_key")


_TYPES = "select row_number() over (order by property_type, listing_type) as property_type_key, property_type as property_type_name, listing_type from (select distinct property_type, listing_type from listing_history)"
_SOURCES = f"select row_number() over (order by source_name, source_part) as source_key, source_name, source_part from (select distinct {_SOURCE} as source_name, source_part from listing_history)"


@query(_TYPES)
def dim_property_type(spark: SparkSession, d: str) -> DataFrame:
    return _types(spark, d)


@query(_SOURCES)
def dim_source(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d)


@query(
    f"""select distinct {_FEATURE} as feature_key, coalesce(orientation, '') as orientation, coalesce(legal_status, '') as legal_status,
    has_dining_room, has_kitchen, has_rooftop, has_car_parking, owner_direct from listing_history"""
)
def dim_features(spark: SparkSession, d: str) -> DataFrame:
    return star.features(_history(spark, d))


_DOUBLES = ("price_vnd", "price_per_m2_vnd", "area_m2", "length_m", "width_m", "street_width_m")
_FLAT = ("is_current", "bedrooms", "floors", "price_is_negotiable", "price_is_outlier", "area_is_undetermined", "area_is_outlier", "has_warning", "is_expired")
_MEASURED = ", ".join(
    [f"epoch_us(@{c}) as {c}_us" for c in ("valid_from", "valid_to")] + [f"cast(@{c} as double) as {c}" for c in _DOUBLES] + [f"@{c}" for c in _FLAT]
)
_FACT = f"""
with types as ({_TYPES}), sources as ({_SOURCES}),
fresh as (select h.listing_key, h.listing_id, l.location_key, t.property_type_key, {_FEATURE} as feature_key, s.source_key,
    cast(strftime(h.posted_date, '%Y%m%d') as int) as posted_date_key, {_MEASURED.replace("@", "h.")}
  from listing_history h
  join dim_location l on (l.province_new, l.ward_new, l.province_old, l.ward_old, l.district_old, l.street) = ({_LOC})
  join types t on t.property_type_name = h.property_type and t.listing_type = h.listing_type
  join sources s on s.source_name = {_SOURCE} and s.source_part = h.source_part)
"""
_FACT_KEYS = ("listing_key", "listing_id", "location_key", "property_type_key", "feature_key", "source_key", "posted_date_key")


def _measured() -> list:
    """The columns of _MEASURED."""
    return [F.unix_micros(c).alias(f"{c}_us") for c in ("valid_from", "valid_to")] + [F.col(c).cast("double").alias(c) for c in _DOUBLES] + [F.col(c) for c in _FLAT]


def _fact(spark: SparkSession, d: str) -> DataFrame:
    return star.fact(_history(spark, d), table(spark, d, "dim_location"), _types(spark, d), _sources(spark, d))


@query(_FACT + "select * from fresh")
def fact(spark: SparkSession, d: str) -> DataFrame:
    return _fact(spark, d).select(*_FACT_KEYS, *_measured())


@query(
    _FACT + f"""select * from fresh union all select {", ".join(_FACT_KEYS)}, {_MEASURED.replace("@", "")} from fact_listing_price where listing_key not in (select listing_key from fresh)"""
)
def fact_upsert(spark: SparkSession, d: str) -> DataFrame:
    fresh = _fact(spark, d)
    merged = star.upsert(table(spark, d, "fact_listing_price").select(*fresh.columns), fresh, "listing_key")
    return merged.select(*_FACT_KEYS, *_measured())


# report view and cards

_WALK = """
ward as (select nfc_normalize(ward_new) as k, min(geojson_ten_day_du) as m from map_ward_geo_crosswalk group by 1),
district as (select nfc_normalize(district_old) as k, min(geojson_ten_day_du) as m from map_district_geo_crosswalk group by 1),
place as (select l.*, coalesce(w.m, nfc_normalize(l.ward_new)) as ward_new_map_key, coalesce(x.m, nfc_normalize(l.district_old)) as district_old_map_key
  from dim_location l left join ward w on w.k = nfc_normalize(l.ward_new) left join district x on x.k = nfc_normalize(l.district_old)),
type_votes as (select f.property_type_key, h.property_type, h.listing_type, count(*) as n from fact_listing_price f join listing_history h using (listing_key) group by 1, 2, 3),
types as (select property_type_key, property_type as property_type_name, listing_type from type_votes
  qualify row_number() over (partition by property_type_key order by n desc, property_type desc, listing_type desc) = 1)
"""
_PRICED = "is_current and not price_is_negotiable and not price_is_outlier and not area_is_outlier and not area_is_undetermined"
_AVG, _MED = "round(avg(cast(price_per_m2_vnd as double)) / 1e6, 2) as avg_million_per_m2", "round(quantile_cont(cast(price_per_m2_vnd as double), 0.5) / 1e6, 2) as median_million_per_m2"
_PLACED = "fact_listing_price f join place using (location_key)"
_POSTED = "strptime(cast(posted_date_key as varchar), '%Y%m%d')"


@query(
    f"""with {_WALK}, source_votes as (select f.source_key, {_SOURCE} as source_name, h.source_part, count(*) as n from fact_listing_price f join listing_history h using (listing_key) group by 1, 2, 3),
    sources as (select source_key, source_name, source_part from source_votes qualify row_number() over (partition by source_key order by n desc, source_name desc, source_part desc) = 1),
    days as (select cast(strftime(t.day, '%Y%m%d') as int) as date_key, cast(t.day as date) as posted_date from (select unnest(generate_series(min(posted_date), max(posted_date), interval 1 day)) as day from listing_history) t),
    features as (select distinct {_FEATURE} as feature_key, coalesce(orientation, '') as orientation, coalesce(legal_status, '') as legal_status,
      has_dining_room, has_kitchen, has_rooftop, has_car_parking, owner_direct from listing_history)
    select f.listing_key, f.listing_id, {_MEASURED.replace("@", "f.")}, posted_date, province_new, ward_new, province_old, ward_old, district_old, street, ward_new_map_key, district_old_map_key,
      property_type_name, listing_type, source_name, source_part, orientation, legal_status, has_dining_room, has_kitchen, has_rooftop, has_car_parking, owner_direct
    from {_PLACED} join types using (property_type_key) join sources using (source_key) join features using (feature_key) join days on days.date_key = f.posted_date_key"""
)
def report_view(spark: SparkSession, d: str) -> DataFrame:
    view = report.full_view(spark, d)
    rest = [c for c in view.columns if c not in {"valid_from", "valid_to", *_DOUBLES, *_FLAT}]
    return view.select(*rest, *_measured())


def _card(select: str, frm: str = "", where: str = _PRICED, tail: str = "", filtered: bool = False) -> str:
    """A card's SQL over fact_listing_price and the joins it needs; filtered: with the filters of FILTERS."""
    joins = frm + (" join types using (property_type_key)" if filtered and "types" not in frm else "")
    more = f" and listing_type = 'Cần bán' and {_POSTED} between date '2024-06-01' and date '2025-06-30'" if filtered else ""
    return f"with {_WALK} select {select} from fact_listing_price f {joins} where {where}{more} {tail}"


_PLACE, _TYPE = "join place using (location_key)", "join types using (property_type_key)"
_BY_WARD, _BY_DISTRICT = f"{_PRICED} and ward_new_map_key <> ''", f"{_PRICED} and district_old_map_key <> ''"
_N, _MONTH = "count(*) as listings", f"cast(date_trunc('month', {_POSTED}) as date) as month"
_TOP = "group by 1 having count(*) >= 5 order by avg_million_per_m2 {}, ward_new_map_key limit 10"
_CARDS = {
    "card_01": (_N, "", "is_current"),
    "card_02": (_AVG,),
    "card_03": (_MED,),
    "card_04": (f"ward_new_map_key, {_N}, {_AVG}", _PLACE, _BY_WARD, "group by 1 having count(*) >= 5"),
    "card_05": (f"district_old_map_key, {_N}, {_AVG}", _PLACE, _BY_DISTRICT, "group by 1 having count(*) >= 5"),
    "card_06": (f"ward_new_map_key, {_N}, {_AVG}, {_MED}", _PLACE, _BY_WARD, _TOP.format("desc")),
    "card_07": (f"ward_new_map_key, {_N}, {_AVG}, {_MED}", _PLACE, _BY_WARD, _TOP.format("asc")),
    "card_08": (f"district_old_map_key, {_N}, {_AVG}, {_MED}, round(avg(cast(area_m2 as double)), 2) as avg_area_m2", _PLACE, _BY_DISTRICT, "group by 1"),
    "card_09": (f"{_MONTH}, property_type_name, {_AVG}", _TYPE, _PRICED, "group by 1, 2 having count(*) >= 5"),
    "card_10": (f"{_MONTH}, {_N}", "", _PRICED, "group by 1"),
    "card_11": (f"property_type_name, {_N}", _TYPE, "is_current", "group by 1"),
    "card_12": (f"listing_type, {_N}", _TYPE, "is_current", "group by 1"),
    "card_13": (f"property_type_name, {_AVG}", _TYPE, _PRICED, "group by 1"),
}
FILTERS = report.Filters(posted=(date(2024, 6, 1), date(2025, 6, 30)), listing_type="Cần bán")
QUERIES |= report.CARDS
QUERIES |= {f"{name}_filtered": partial(card, filters=FILTERS) for name, card in report.CARDS.items()}
SQL |= {name: _card(*parts) for name, parts in _CARDS.items()} | {f"{name}_filtered": _card(*parts, filtered=True) for name, parts in _CARDS.items()}


@query(
    f"with {_WALK} select district_old_map_key, {_N}, {_AVG}, {_MED}, round(avg(cast(area_m2 as double)), 2) as avg_area_m2 from fact_listing_price f {_PLACE} {_TYPE} "
    f"where {_BY_DISTRICT} and property_type_name = 'Nhà mặt tiền' and district_old_map_key = 'Quận Nếp Hồi' and ward_new_map_key = 'Phường Kén Vải' group by 1"
)
def card_08_of_a_place(spark: SparkSession, d: str) -> DataFrame:
    return report.card_08(spark, d, report.Filters(property_type="Nhà mặt tiền", ward="Phường Kén Vải", district="Quận Nếp Hồi"))


# checks

_CHECKS = """
with c as (select (select count(*) from listing_history) as versions, count(*) as facts,
  count(*) filter (where location_key is null or property_type_key is null or feature_key is null or source_key is null or posted_date_key is null) as no_key,
  count(*) filter (where price_per_m2_vnd > 5000000000 and not price_is_outlier) as unflagged,
  count(*) filter (where not area_is_outlier and (area_m2 < 3 or area_m2 > 10000)) as area,
  (select count(*) from (select listing_id from fact_listing_price where is_current group by 1 having count(*) > 1)) as twice from fact_listing_price),
r as (select 'row_count_match' as check_name, versions as expected, facts as actual from c union all select 'is_current_unique_per_listing', 0, twice from c
  union all select 'fact_fk_not_null', 0, no_key from c union all select 'price_per_m2_extreme_all_flagged', 0, unflagged from c union all select 'area_within_sanitized_bounds', 0, area from c)
select *, expected = actual as passed from r
"""


@query(_CHECKS)
def validate(spark: SparkSession, d: str) -> DataFrame:
    return quality.validate(_history(spark, d), table(spark, d, "fact_listing_price"))


@query(
    f"""with types as (select distinct property_type as p, listing_type as t from listing_history where listing_type = 'Cần bán'), sources as (select distinct {_SOURCE} as n, source_part as p from listing_history where source_bronze_key like 'bronze/web/%'),
    m as (select l.location_key is null as no_l, t.p is null as no_t, s.p is null as no_s, address_province_new is null or address_ward_new is null or address_province_old is null or address_ward_old is null
        or address_district_old is null or address_street_new is null as null_l, property_type is null or h.listing_type is null as null_t
      from listing_history h
      left join dim_location l on (l.province_new, l.ward_new, l.province_old, l.ward_old, l.district_old, l.street) = ({_LOC})
      left join types t on t.p = h.property_type and t.t = h.listing_type left join sources s on s.n = {_SOURCE} and s.p = h.source_part)
    select 'dim_location' as join_target, count(*) filter (where no_l) as orphan_count, count(*) filter (where no_l and null_l) as orphan_with_real_null from m
    union all select 'dim_property_type', count(*) filter (where no_t), count(*) filter (where no_t and null_t) from m
    union all select 'dim_source', count(*) filter (where no_s), 0 from m
    union all select 'joined_all_3_dims', count(*) filter (where not no_l and not no_t and not no_s), 0 from m"""
)
def diagnose(spark: SparkSession, d: str) -> DataFrame:
    """Against dimensions that lack the rents and the dataset's sources, so that there is something to find."""
    history = _history(spark, d)
    types = star.property_types(history).where("listing_type = 'Cần bán'")
    sources = star.sources(history).where("source_name = 'web'")
    return quality.diagnose(history, table(spark, d, "dim_location"), types, sources)


# streaming


@query()
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """bronze_page as a file stream, parsed and split; outcome and page_id of every page."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    table(spark, d, "bronze_page").repartition(3, "page_id").write.parquet(f"{at}/in")
    ingest(spark, f"{at}/in", f"{at}/listings", f"{at}/rejects", f"{at}/state", files_per_batch=1).awaitTermination()
    read = lambda k: spark.read.parquet(f"{at}/{k}").select(F.lit(k).alias("outcome"), "page_id")
    return read("listings").unionByName(read("rejects"))

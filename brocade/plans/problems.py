"""Queries of the general problems 2, 3 and 5 over the listing tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brocade.functions.listing_page import RECORD_SCHEMA, parse_page
from brocade.operators.history import observations, type_two_merge
from brocade.operators.quarantine import assemble_records, parse_or_reject, read_delimited
from brocade.operators.units import evidence, harmonise, with_written
from brocade.session import cut
from brocade.sources.tables import table

#: Rows of a unit reference at most.
MOST_UNITS = 500
#: The attributes whose change makes a new version of a listing, in hash order.
TRACKED = ("price_vnd", "price_is_negotiable", "is_expired", "has_warning", "area_m2")


def listing_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions after the batch (seen at crawl_date) is merged into what the history holds as evidence: each of its
    rows was seen at valid_from and at last_seen_at."""
    batch = table(spark, sf_dir, "listing_staging_batch", ["listing_id", "crawl_date", *TRACKED])
    kept = table(spark, sf_dir, "listing_history", ["listing_id", "valid_from", "last_seen_at", *TRACKED])
    return type_two_merge(
        observations(kept, "listing_id", ["valid_from", "last_seen_at"], TRACKED), observations(batch, "listing_id", ["crawl_date"], TRACKED), TRACKED
    )


def _units(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str, float]]:
    """The unit reference, or an error if it is longer than expressions can hold."""
    ref = table(spark, sf_dir, "unit_reference", ["quantity", "unit_name", "base_unit", "factor"]).limit(MOST_UNITS + 1).collect()
    if len(ref) > MOST_UNITS:
        raise ValueError(f"a unit reference of over {MOST_UNITS} rows")
    return [(r["quantity"], r["unit_name"], r["base_unit"], float(r["factor"])) for r in ref]


def stated_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, the recorded columns and price_amount (đồng), area_amount (m²) as the texts state them."""
    batch = table(
        spark, sf_dir, "listing_staging_batch",
        ["obs_id", "listing_id", "price_raw", "price_vnd", "price_is_negotiable", "area_raw", "area_m2", "area_is_undetermined"],
    )
    kept = table(spark, sf_dir, "listing_history", ["listing_key", "listing_id", "price_raw", "price_vnd", "area_raw", "area_m2"])
    recorded = {"area": "area_m2", "price": "price_vnd"}
    # the texts are read once; what follows uses narrow columns of these tables several times
    forms, older = (
        cut(with_written(with_written(rows, "area_raw", "area"), "price_raw", "price").drop("price_raw", "area_raw")) for rows in (batch, kept)
    )
    return harmonise(forms, recorded, "listing_id", _units(spark, sf_dir), per={"price": "area"}, more=evidence(older, recorded, "listing_id"))


def p2_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's price in đồng and area in hundredths of m², null where its text states none."""
    return stated_amounts(spark, sf_dir).select(
        "obs_id", F.round("price_amount").cast("bigint").alias("price_dong"), F.round(F.col("area_amount") * 100).cast("bigint").alias("area_hundredths")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose recorded column is null or differs from what the text states."""
    rows = stated_amounts(spark, sf_dir).select(
        "obs_id",
        F.inline(
            F.array(
                F.struct(
                    F.lit("price").alias("quantity"), F.round("price_amount").cast("bigint").alias("amount"),
                    F.col("price_vnd").cast("bigint").alias("recorded"), (F.col("price_is_negotiable") == F.lit(False)).alias("counts"),
                ),
                F.struct(
                    F.lit("area").alias("quantity"), F.round(F.col("area_amount") * 100).cast("bigint").alias("amount"),
                    (F.col("area_m2") * 100).cast("bigint").alias("recorded"), (F.col("area_is_undetermined") == F.lit(False)).alias("counts"),
                ),
            )
        ),
    )
    return rows.where("counts and amount is not null and not (amount <=> recorded)").select("obs_id", "quantity", "amount")


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, record_id, url, crawl_date, source_bronze_key, reason_code and the listing's columns, for every
    page of both tables. parse_quarantine.error_reason isn't read."""
    fresh = table(spark, sf_dir, "bronze_page", ["page_id", "url", "crawl_date", "source_bronze_key", "html"])
    kept = table(spark, sf_dir, "parse_quarantine", ["id", "url", "crawl_date", "source_bronze_key", "raw_html"])
    pages = fresh.select(F.lit("bronze_page").alias("origin"), F.col("page_id").alias("record_id"), "url", "crawl_date", "source_bronze_key", "html").union(
        kept.select(F.lit("parse_quarantine"), "id", "url", "crawl_date", "source_bronze_key", "raw_html")
    )
    keep = ["origin", "record_id", "url", "crawl_date", "source_bronze_key"]
    return parse_or_reject(pages, keep, ["html", "url"], parse_page, T.StructType.fromDDL(RECORD_SCHEMA))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that give no listing, with the first check that fails."""
    return parsed_pages(spark, sf_dir).where("reason_code is not null").select("origin", "record_id", "reason_code")


def p3_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other pages as parsed listings."""
    return parsed_pages(spark, sf_dir).where("reason_code is null").drop("reason_code")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per origin and reason: how many pages."""
    counted = p3_found(spark, sf_dir).groupBy("origin", "reason_code").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(table(spark, sf_dir, "parse_reason", ["reason_code", "error_reason"]), "reason_code", "left").select("origin", "reason_code", "n", "error_reason")


def p3_csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a delimited record with its text in quotes, cut into physical lines by source, put together
    and parsed again: doc_id, reason_code, lines, text_hash, lang and n_chars."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text", "lang", "n_chars"])
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    record = F.concat_ws(",", "doc_id", quoted, F.coalesce("lang", F.lit("")), F.coalesce(F.col("n_chars").cast("string"), F.lit("")))
    lines = docs.select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.posexplode(F.split(record, "\n"))).select("source", (F.shiftleft("doc_id", 20) + F.col("pos")).alias("line"), F.col("col").alias("text"))
    made = T.StructType.fromDDL("doc_id bigint, text string, lang string, n_chars int")
    parsed = read_delimited(assemble_records(lines, "source", "line", "text"), "record", ["lines"], made, {"doc_id": int, "n_chars": int})
    return parsed.select("doc_id", "reason_code", "lines", F.md5("text").alias("text_hash"), "lang", "n_chars")


def p3_csv_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch as carelessly delimited records, amounts unquoted: line, reason_code and the values of the sound ones."""
    batch = table(spark, sf_dir, "listing_staging_batch", ["obs_id", "source_bronze_key", "price_raw", "area_raw", "title"])
    bare = lambda c: F.coalesce(c, F.lit(""))
    record = F.concat_ws(",", "obs_id", bare("price_raw"), bare("area_raw"), F.concat(F.lit('"'), F.replace(bare("title"), F.lit('"'), F.lit('""')), F.lit('"')))
    lines = batch.select(bare("source_bronze_key").alias("source"), F.col("obs_id").alias("line"), record.alias("text"))
    made = T.StructType.fromDDL("obs_id bigint, price_raw string, area decimal(9,2), title string")
    parsed = read_delimited(assemble_records(lines, "source", "line", "text", r"^\d+,"), "record", ["first_line"], made, {"obs_id": int, "area": Decimal})
    return parsed.select("first_line", "reason_code", "price_raw", F.col("area").cast("double").alias("area"), "title")


def p5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole history: every version with its period and hash."""
    return listing_versions(spark, sf_dir).select(
        F.col("entity").alias("listing_id"), *TRACKED, "row_hash",
        F.unix_micros("valid_from").alias("valid_from_us"), F.unix_micros("valid_to").alias("valid_to_us"), "is_current",
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that have ended."""
    ended = listing_versions(spark, sf_dir).where("valid_to is not null")
    return ended.select(
        F.col("entity").alias("listing_id"), F.unix_micros("valid_from").alias("valid_from_us"), F.unix_micros("valid_to").alias("valid_to_us")
    )


# The same amounts by a fixed list of unit words, where the operator learns them from the data.
_P2 = r"""
with raw as (
  select obs_id, price_vnd, price_is_negotiable, area_m2, area_is_undetermined, nfc_normalize(lower(trim(price_raw))) as p,
    replace(replace(nfc_normalize(lower(trim(area_raw))), 'm2', 'm²'), 'ft2', 'ft²') as a from listing_staging_batch),
cut as (
  select *, regexp_matches(p, '(/|mỗi)\s*(m2|m²|mét vuông|met vuong)') as per_m2,
    regexp_replace(regexp_replace(p, '\s*(/|mỗi)\s*(m2|m²|mét vuông|met vuong)', ' ', 'g'), '\s*(/|mỗi)\s*(tháng|thang|th)$', ' ') as q,
    trim(regexp_replace(regexp_replace(a, '\([^)]*\)', ''), '^dt ', '')) as b from raw),
nums as (
  select *, regexp_extract_all(q, '\d+(?:[.,]\d+)*') as pn, regexp_extract_all(b, '\d+(?:[.,]\d+)*') as an, trim(regexp_replace(q, '[\d.,]+', '', 'g')) as pu,
    trim(regexp_replace(regexp_replace(b, '\d+(?:[.,]\d+)*', '', 'g'), '\s+', ' ', 'g')) as au from cut),
val as (
  select *, list_transform(pn, lambda x: case when regexp_full_match(x, '[1-9]\d{0,2}(\.\d{3})+') or regexp_full_match(x, '[1-9]\d{0,2}(,\d{3})+')
      then cast(replace(replace(x, '.', ''), ',', '') as decimal(20,3)) else cast(replace(x, ',', '.') as decimal(20,3)) end) as pv,
    list_transform(an, lambda x: case when regexp_full_match(x, '[1-9]\d{0,2}(\.\d{3})+') or regexp_full_match(x, '[1-9]\d{0,2}(,\d{3})+')
      then cast(replace(replace(x, '.', ''), ',', '') as decimal(20,3)) else cast(replace(x, ',', '.') as decimal(20,3)) end) as av from nums),
unit as (
  select *, case when pu like '%usd%' or pu like '%$%' or pu like '%đô' then case when regexp_matches(pu, '\bk\b') then 25400000 else 25400 end
      when regexp_matches(pu, '(tỷ|tỉ|\bty\b|billion)') then 1000000000 when regexp_matches(pu, '(triệu|trieu|\btr\b)') then 1000000
      when regexp_matches(pu, '(nghìn|ngàn|\bk\b)') then 1000 when regexp_matches(pu, '(đồng|\bđ|đ$|vnd|vnđ)') then 1 end as pf,
    case when regexp_matches(au, 'sq|ft|feet') then 929 when regexp_matches(au, 's[àa]o') then 5000000 when regexp_matches(au, 'c[ôo]ng') then 10000000
      when regexp_matches(au, '(\bha$|héc)') then 100000000 when not regexp_matches(au, 'kxđ') then 10000 end as af from val),
amount as (
  select *, case when len(pv) = 1 then cast(pv[1] * 1000 as hugeint) when len(pv) = 2 then cast(pv[1] * 1000 as hugeint) + cast(pv[2] as hugeint) end as p1000,
    case when len(av) = 1 then cast(av[1] * 1000 as hugeint) * 1000 when len(av) = 2 then cast(av[1] * 1000 as hugeint) * cast(av[2] * 1000 as hugeint) end * af as a1e10 from unit),
said as (
  select obs_id, 'price' as quantity, case when per_m2 then (p1000 * pf * a1e10 + 5000000000000) // 10000000000000 else (p1000 * pf + 500) // 1000 end as amount, cast(price_vnd as hugeint) as recorded
    from amount where not price_is_negotiable
  union all select obs_id, 'area', (a1e10 + 50000000) // 100000000, cast(area_m2 * 100 as hugeint) from amount where not area_is_undetermined)
"""
_P2_FOUND = _P2 + "select obs_id, quantity, cast(amount as bigint) as amount from said where amount is not null and amount is distinct from recorded"
_P2_AMOUNTS = (
    _P2
    + """select obs_id, cast(case when per_m2 then (p1000 * pf * a1e10 + 5000000000000) // 10000000000000 else (p1000 * pf + 500) // 1000 end as bigint) as price_dong,
    cast((a1e10 + 50000000) // 100000000 as bigint) as area_hundredths from amount"""
)

_P5 = """
with seen as (
  select listing_id, crawl_date as seen_at, price_vnd, price_is_negotiable, is_expired, has_warning, area_m2 from listing_staging_batch
  union select listing_id, valid_from, price_vnd, price_is_negotiable, is_expired, has_warning, area_m2 from listing_history
  union select listing_id, last_seen_at, price_vnd, price_is_negotiable, is_expired, has_warning, area_m2 from listing_history),
ranked as (
  select *, row_number() over (partition by listing_id, seen_at order by price_vnd desc nulls last, price_is_negotiable desc nulls last,
    is_expired desc nulls last, has_warning desc nulls last, area_m2 desc nulls last) as rn
  from seen where listing_id is not null and seen_at is not null),
hashed as (
  select *, md5(coalesce(cast(price_vnd as varchar), 'NULL') || '|' || coalesce(cast(price_is_negotiable as varchar), 'NULL') || '|' ||
    coalesce(cast(is_expired as varchar), 'NULL') || '|' || coalesce(cast(has_warning as varchar), 'NULL') || '|' ||
    coalesce(cast(area_m2 as varchar), 'NULL')) as row_hash
  from ranked where rn = 1),
changes as (
  select *, lag(row_hash) over (partition by listing_id order by seen_at) as before from hashed),
versions as (
  select *, lead(seen_at) over (partition by listing_id order by seen_at) as valid_to from changes where before is null or before <> row_hash)
"""

QUERIES = {"p2_found": p2_found, "p2_amounts": p2_amounts, "p3_found": p3_found, "p3_listings": p3_listings, "p3_reasons": p3_reasons, "p3_csv_documents": p3_csv_documents, "p3_csv_batch": p3_csv_batch, "p5_found": p5_found, "p5_history": p5_history}
SQL = {
    "p3_csv_documents": """select doc_id, cast(null as varchar) as reason_code, cast(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) as int) as lines,
    md5(nullif(text, '')) as text_hash, nullif(lang, '') as lang, n_chars from documents""",
    "p3_csv_batch": """with b as (select obs_id, nullif(title, '') as title, nullif(price_raw, '') as p, coalesce(area_raw, '') as a,
      case when contains(coalesce(price_raw, ''), ',') or contains(coalesce(area_raw, ''), ',') then 'column_count'
        when area_raw <> '' and not regexp_full_match(area_raw, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)\\s*') then 'invalid_area' end as r from listing_staging_batch)
    select obs_id as first_line, r as reason_code, case when r is null then p end as price_raw, case when r is null and a <> '' then cast(cast(a as decimal(18,2)) as double) end as area,
      case when r is null then title end as title from b""",
    "p2_found": _P2_FOUND,
    "p2_amounts": _P2_AMOUNTS,
    "p5_found": _P5 + "select listing_id, epoch_us(seen_at) as valid_from_us, epoch_us(valid_to) as valid_to_us from versions where valid_to is not null",
    "p5_history": _P5
    + """select listing_id, price_vnd, price_is_negotiable, is_expired, has_warning, area_m2, row_hash, epoch_us(seen_at) as valid_from_us,
    epoch_us(valid_to) as valid_to_us, valid_to is null as is_current from versions""",
}

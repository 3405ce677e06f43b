"""Column expressions of the listing pipeline. Everything stays in code generation but `nfc`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brocade.functions.listing_page import LEAST_AREA, MISSING, MOST_AREA, MOST_PER_M2
from brocade.operators.history import attribute_hash

#: The labels in scope, the province they must have, and the key prefixes of the two sources.
LISTING_TYPES = ("Cần bán", "Cho thuê")
PROPERTY_TYPES = ("Nhà mặt tiền", "Nhà trong hẻm", "Biệt thự, nhà liền kề", "Căn hộ chung cư", "Phòng trọ, nhà trọ")
PROVINCE = "Hồ Chí Minh"
DATASET_PREFIX, WEB_PREFIX = "bronze/dataset/", "bronze/web/"


def is_missing(text: Column) -> Column:
    """Whether a trimmed text is empty or one of the site's markers for a missing value."""
    return F.lower(F.trim(text)).isin(*MISSING)


#: The number of `listing_page.local_number` as one pattern: thousands, or what stands before and after a decimal sign.
_NUMBER = r"(?i)^\s*\+?(?:(\d{1,3}(?:\.\d{3})+)|([\d.]*),([\d.]*)|(\d+\.?\d*|\.\d+))\s*(?:m[2²]?)?\s*$"


def vn_number(text: Column) -> Column:
    """decimal(24,6): comma decimals, point thousands in groups of three, an m, m2 or m² behind; null where
    missing, negative or no number. (`1.500` is 1500, `1.5` is 1.5, `1,234,567` is none.)"""
    # what the pattern keeps: thousands and points lose their points, a comma becomes the decimal sign
    group = [F.regexp_extract(text, _NUMBER, i) for i in range(5)]
    bare = lambda c: F.replace(c, F.lit("."), F.lit(""))
    digits = F.when(group[1] != "", bare(group[1])).when(group[4] != "", group[4]).when(text.contains(","), F.concat(bare(group[2]), F.lit("."), bare(group[3])))
    return F.when(text.rlike(_NUMBER), digits).try_cast("decimal(24,6)")


def sanitize_dimension(value: Column, most: int) -> Column:
    """Null unless 0 < value <= most."""
    return F.when((value > 0) & (value <= most), value)


def sanitize_area(area: Column) -> tuple[Column, Column]:
    """(area or null, whether it was outside the plausible range)."""
    outside = F.coalesce((area < LEAST_AREA) | (area > MOST_AREA), F.lit(False))
    return F.when(~outside, area), outside


def price_outlier(price: Column, area: Column) -> Column:
    """price per m² above the threshold, false where either is null; exact, without a division."""
    return F.coalesce(price > F.lit(MOST_PER_M2) * area, F.lit(False)) & F.coalesce(area != 0, F.lit(False))


def listing_id_from_url(url: Column) -> Column:
    """The digits before .html or .htm at the end, as bigint; null without them."""
    return F.nullif(F.regexp_extract(F.trim(url), r"-(\d+)\.html?\s*$", 1), F.lit("")).try_cast("bigint")


def strip_symbols(text: Column) -> Column:
    """Without characters of the Unicode categories S*, trimmed."""
    return F.trim(F.regexp_replace(text, r"\p{S}", ""))


def old_address_part(raw: Column, from_end: int) -> Column:
    """The from_end-th last of at least three comma-separated parts, trimmed; '' otherwise."""
    parts = F.split(raw, ",")
    return F.when(F.size(parts) >= 3, F.trim(F.try_element_at(parts, F.lit(-from_end)))).otherwise(F.lit(""))


def infer_source(key: Column) -> Column:
    """dataset or web by the key's prefix, else null."""
    return F.when(key.startswith(DATASET_PREFIX), F.lit("dataset")).when(key.startswith(WEB_PREFIX), F.lit("web"))


def source_part(key: Column) -> Column:
    """The key's last part without its extension."""
    return F.regexp_extract(key, r"([^/]+)\.[^./]+$", 1)


def in_scope(province: Column, listing_type: Column, property_type: Column) -> Column:
    return (province == PROVINCE) & listing_type.isin(*LISTING_TYPES) & property_type.isin(*PROPERTY_TYPES)


def row_hash() -> Column:
    """MD5 of the tracked listing attributes."""
    return attribute_hash("price_vnd", "price_is_negotiable", "is_expired", "has_warning", "area_m2")


def feature_key() -> Column:
    """MD5 of the feature columns; null texts count as ''."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("orientation", "legal_status")]
    return attribute_hash(*texts, "has_dining_room", "has_kitchen", "has_rooftop", "has_car_parking", "owner_direct")


def price_per_m2(price: Column, area: Column, undetermined: Column) -> Column:
    """decimal(15,2), half up; null if the area is undetermined, null or 0, or the price is null."""
    known = ~undetermined & area.isNotNull() & (area != 0) & price.isNotNull()
    return F.when(known, F.round(price / area, 2).cast("decimal(15,2)"))


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; used on dimension names alone."""
    return text.str.normalize("NFC")




@F.pandas_udf(T.StringType())
def unaccented(text: pd.Series) -> pd.Series:
    """Without accents and spaces, in lower case; used on short lists of names alone."""
    plain = text.str.lower().str.replace("đ", "d").str.normalize("NFKD")
    return plain.str.replace(r"[\u0300-\u036f\s.]", "", regex=True)

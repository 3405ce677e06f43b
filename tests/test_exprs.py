"""Scalar expressions by examples."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brocade.functions import exprs as X
from brocade.functions.html import read_html
from brocade.functions.listing_page import local_number, parse_page, split_old_address
from brocade.sources import bronze

NUMBERS = {
    "1.500": 1500, "1.5": 1.5, "1.234,56": 1234.56, "1,234,567": None, "60 m²": 60, "5m": 5, "7 M2": 7, "-3": None, "---": None, "n/a": None,
    "": None, "m2": None, "12 34": None, "1.234.5": None, "0": 0, ".5": 0.5, "abc": None, " 42 ": 42,
}


def test_vn_number(spark):
    rows = spark.createDataFrame([(k,) for k in NUMBERS] + [(None,)], "t string")
    got = {r.t: r.n for r in rows.select("t", X.vn_number(F.col("t")).alias("n")).collect()}
    assert got.pop(None) is None
    assert {k: None if v is None else float(v) for k, v in got.items()} == NUMBERS


@pytest.mark.parametrize("text", NUMBERS)
def test_local_number_agrees(text):
    value = local_number(text)
    assert (None if value is None else float(value)) == NUMBERS[text]


def test_bounds(spark):
    area = [("2.99", None, True), ("3", 3, False), ("10000", 10000, False), ("10000.01", None, True), (None, None, False)]
    rows = spark.createDataFrame([(Decimal(a) if a else None,) for a, _, _ in area], "a decimal(10,2)")
    value, outside = X.sanitize_area(F.col("a"))
    got = rows.select(value.alias("v"), outside.alias("o")).collect()
    assert [(None if r.v is None else float(r.v), r.o) for r in got] == [(v, o) for _, v, o in area]
    sides = spark.createDataFrame([(Decimal(v),) for v in ("0", "500", "500.01", "-1")], "s decimal(6,2)").select(X.sanitize_dimension(F.col("s"), 500).alias("s"))
    assert [r.s and float(r.s) for r in sides.collect()] == [None, 500.0, None, None]


def test_price_outlier_is_strict(spark):
    rows = spark.createDataFrame([(Decimal(5 * 10**9), Decimal(1)), (Decimal(5 * 10**9 + 1), Decimal(1)), (None, Decimal(1)), (Decimal(9), Decimal(0))], "p decimal(16,0), a decimal(10,2)")
    assert [r.o for r in rows.select(X.price_outlier(F.col("p"), F.col("a")).alias("o")).collect()] == [False, True, False, False]


def test_texts(spark):
    one = spark.range(1)
    out = one.select(
        X.strip_symbols(F.lit("🔥 a+b $ ")).alias("s"), X.listing_id_from_url(F.lit("x-123.html ")).alias("u"), X.listing_id_from_url(F.lit("x/123")).alias("v"),
        X.old_address_part(F.lit("a, b, c, d"), 3).alias("w"), X.old_address_part(F.lit("a, b"), 3).alias("e"), X.infer_source(F.lit("bronze/web/x")).alias("src"),
        X.infer_source(F.lit("other")).alias("none"), X.source_part(F.lit("bronze/dataset/part=7.parquet")).alias("part"),
        bronze.run_key(F.lit(date(2024, 5, 1)), F.lit("run__2024-05-01T00:00:00+00:00")).alias("key"),
        bronze.asks_captcha(F.lit("... tôi không phải NGƯỜI máy ...")).alias("captcha"),
    ).first()
    assert (out.s, out.u, out.v, out.w, out.e, out.src, out.none, out.part) == ("ab", 123, None, "b", "", "web", None, "part=7")
    assert out.key == "bronze/web/date=2024-05-01/part-run__2024-05-01T00-00-00-00-00.parquet" and out.captcha
    assert split_old_address("a, b, c, d") == ("b", "c", "d") and split_old_address("a, b") == ("", "", "")


def test_nfc(spark):
    import unicodedata

    word = "Phường Ổi"
    rows = spark.createDataFrame([(unicodedata.normalize("NFD", word),), (None,)], "t string").select(X.nfc("t").alias("t")).collect()
    assert [r.t for r in rows] == [word, None]


PAGE = (
    "<html><aside><article class='property-item'><data itemprop=price value=1>x</data></article></aside><!-- <article class='property'></article> -->"
    "<ARTICLE class='box property'><h1 itemprop=name>🔥 Nhà &amp; sân</h1><time itemprop='datePosted' datetime=' 2024-5-1 '>x</time>"
    "<data itemprop='price' value='5000000000'>5 tỷ</data><span itemprop='floorSize'><span itemprop='value'>50,5 m²</span> m²</span>"
    "<div itemprop='address'><span itemprop='streetAddress'>1 Đường A</span></div><p class='old-address'>1 A, P. B, Q. C, D</p><i class='x expired'></i>"
    "<section class='moreinfor1'><table><tr><td>Loại tin<td>Cần bán<td>Hướng<td>---</tr><tr><td>Loại BDS<td>Nhà mặt tiền<td>Chính chủ<td><img alt='check'></tr>"
    "<tr><td>Số lầu<td>3<td>Chiều dài<td>600m</tr></table></section></ARTICLE></html>"
)
URL = "https://x.example/a-12.html"
BROKEN = {
    "no_article": ("<ARTICLE class='box property'>", "<article class='property-item'>"), "no_title": ("🔥 Nhà &amp; sân", "🔥"),
    "no_posted_date": ("datetime=' 2024-5-1 '", ""), "bad_posted_date": (" 2024-5-1 ", "hôm nay"), "no_price": ("value='5000000000'", ""),
    "price_not_numeric": ("'5000000000'", "'5 tỷ'"), "no_area": ("floorSize", "size"), "area_unparsed": ("50,5 m²", "năm mươi"),
    "no_detail_section": ("moreinfor1", "moreinfor2"), "no_listing_type": ("Loại tin<td>Cần bán", "Loại tin<td>"), "no_property_type": ("Loại BDS", "Loại nhà"),
}


def test_page():
    code, row = parse_page(PAGE.encode(), URL)
    assert code is None
    want = {
        "listing_id": 12, "title": "Nhà & sân", "listing_type": "Cần bán", "property_type": "Nhà mặt tiền", "posted_date": date(2024, 5, 1), "price_vnd": Decimal(5 * 10**9),
        "price_is_negotiable": False, "area_m2": Decimal("50.5"), "orientation": "", "owner_direct": True, "has_kitchen": None, "floors": 3, "length_m": None,
        "is_expired": True, "has_warning": False, "address_street_new": "1 Đường A", "address_ward_new": "", "address_district_old": "Q. C",
    }
    assert {k: row[k] for k in want} == want


@pytest.mark.parametrize("code", BROKEN)
def test_first_failing_check(code):
    assert parse_page(PAGE.replace(*BROKEN[code]).encode(), URL)[0] == code


def test_other_rejects():
    assert parse_page(None, URL)[0] == "html_error"
    assert parse_page(PAGE.encode(), None)[0] == parse_page(PAGE.encode(), "https://x.example/12")[0] == "no_listing_id"
    assert parse_page(b"", URL)[0] == parse_page(b"\x1f\x8b\x00\xff<", URL)[0] == "no_article"
    # an unclosed quote swallows what follows up to the next one
    assert parse_page(PAGE.replace("value='5000000000'", "value='5000000000").encode(), URL)[0] == "price_not_numeric"
    # negotiable and undetermined are no failures; nor are amounts too large for their columns
    assert parse_page(PAGE.replace("'5000000000'", "'0'").replace("50,5 m²", "kxđ").encode(), URL)[1]["price_is_negotiable"]


def test_html_tree():
    tree = read_html("<div><p>a<p>b<li>c<script>if (1<2) x</script></div>d <b>e</b> 1 < 2 <unclosed attr='x")
    assert tree.text() == "a b c d e 1 < 2"
    deep = read_html("<div>" * 50_000 + "x")
    assert deep.text() == "x"

"""Place mapping and address linkage, by examples and against brute force."""

import random

import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brocade.llm import queries_places
from brocade.llm.addresses import (
    ACCENTS, MISSING, NO_PLACE, ONE, OTHER, OTHER_DISTRICT, SAME, SAME_DISTRICT, SAME_WARD, SHORT, THREE, TWO,
    Reader, chance, comparable, compare_forms, estimate, houses, linked, place_level, read_street, same_house, settle, street_keys, street_levels, weigh,
)
from brocade.llm.places import Resolver, cores, deletes, edits_apart, fold, map_values, weighted_distance

NAMES = [
    ("ward_new", 1, "Phường Quế Ngà"), ("ward_new", 2, "Xã Huyền Liễu"), ("ward_new", 3, "Phường Thạch Nếp"), ("ward_new", 3, "Phường Cũ Kỹ"),
    ("district_old", 7, "Quận Vĩ Sen"), ("ward_old", 9, "Phường Diệp Vĩ"), ("ward_old", 10, "Xã Thông Oanh"),
]


@pytest.fixture(scope="module")
def resolver():
    return Resolver(NAMES, {"district_old": ("ward_old", "ward_new")}, {("ward_new", 1): 5})


@pytest.mark.parametrize(
    "typed, place",
    [
        ("phường quế ngà", 1), ("P. Que Nga", 1), ("F.Qui Nga", 1), ("PhuongQueNga", 1), ("Quế Ngà Ward", 1), ("Xã Quế Ngà (cũ)", 1), ("  Phường  Quế Ngà. ", 1), ("Phường Quế Ngà / gần chợ", 1),
        ("QUẾ NGÀ, Hồ Chí Minh", 1), ("Phường Quế Nàg", 1), ("huyen lieu", 2), ("xã huyền liễuu", 2), ("Phường Cũ Kỹ", 3), ("P.Thach Ne", 3),
        ("Phường Quế Ngà Thượng", 0), ("Phường", 0), ("", 0), ("??", 0), ("q" * 50_000, 0), ("P. Que Nga (" + "x" * 50_000 + ")", 1), (None, 0), ("Phường Vĩ Sen", 0),
    ],
)
def test_wards(resolver, typed, place):
    assert resolver.resolve("ward_new", typed) == place


def test_decoys(resolver):
    assert resolver.resolve("district_old", "q Vi Sen") == 7
    assert resolver.resolve("district_old", "P. Thong Oanh") == 0
    assert resolver.resolve("unknown", "Quận Vĩ Sen") == 0


NUMBERED = [
    ("district_old", 1, "Quận 1"), ("district_old", 3, "Quận 3"), ("district_old", 10, "Quận 10"), ("district_old", 20, "Quận Nếp Hồi"), ("district_old", 21, "Quận Vò"),
    ("ward_old", 5, "Phường 5"), ("ward_old", 15, "Phường 15"), ("ward_new", 31, "Phường Sen Vàng"), ("ward_new", 32, "Phường Sen Vang"), ("ward_new", 33, "Phường Lam Hoà"), ("ward_new", 34, "Phường Lam Hoè"),
]


@pytest.mark.parametrize(
    "kind, typed, place",
    [
        ("district_old", "Quận 13", 0), ("district_old", "Quận 2", 0), ("district_old", "Q.10", 10), ("district_old", "Q3", 3), ("district_old", "quan 1", 1), ("district_old", "Quận Võ", 21),
        ("district_old", "Quận Vòi", 0), ("district_old", "TP Kén Vải, Quận Nếp Hồi", 20), ("district_old", "Quận Nếp Hồi, TP Kén Vải", 20), ("district_old", "Phường 5, Quận 3", 3), ("ward_old", "Phường 5, Quận 3", 5),
        ("ward_old", "Quận 15", 15), ("ward_old", "P5", 5), ("ward_old", "Phường 51", 0), ("district_old", " , ; ", 0),
    ],
)
def test_numbers_short_names_and_parts(kind, typed, place):
    assert Resolver(NUMBERED).resolve(kind, typed) == place


def test_weight_and_frequency_decide_between_two():
    plain = Resolver(NUMBERED)
    # an accent weighs less than a letter: both are candidates, the nearer one is meant
    assert [p for _, _, p in plain.nearest("ward_new", "Sen Vàng")] == [31, 32] and plain.resolve("ward_new", "P. Sen Vàmg") == 31
    # typed without accents and with a slip both are as far; the more frequent one is meant, then the smaller id
    assert plain.resolve("ward_new", "P. Lam Ho") == 33
    assert Resolver(NUMBERED, frequency={("ward_new", 34): 9, ("ward_new", 33): 2}).resolve("ward_new", "P. Lam Ho") == 34


def test_too_many_names():
    with pytest.raises(ValueError, match="doesn't fit"):
        Resolver((("k", i, f"n{i}") for i in range(200_001)), edits=0)


words = st.text("abcdeê", min_size=1, max_size=7)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_deletes_find_every_near_word(a, b):
    a, b = fold(a), fold(b)
    shared = bool(deletes(a, 1) & deletes(b, 1))
    assert shared or edits_apart(a, b) > 1
    assert weighted_distance(a, b, 99) <= edits_apart(a, b) + 1e-9


def test_map_values(spark, resolver):
    rows = [(1, "Q. Vi Sen", "P.Que Nga", "x"), (1, "Q. Vi Sen", "P.Que Nga", "x"), (2, None, "nowhere at all", "x"), (3, "", None, "x")]
    df = spark.createDataFrame(rows, "location_key long, district_old string, ward_new string, place_id string")
    got = sorted((r.location_key, r.field_name, r.place_id) for r in map_values(df, "location_key", queries_places.FIELDS, resolver).collect())
    assert got == [(1, "district_old", 7), (1, "district_old", 7), (1, "ward_new", 1), (1, "ward_new", 1), (2, "ward_new", 0), (3, "district_old", 0)]
    assert map_values(df.limit(0), "location_key", queries_places.FIELDS, resolver).count() == 0


def test_cores():
    assert cores("Phường Quế Ngà")[0] == "quếngà" and "huyenlieu" in cores("huyen lieu")


def test_place_query_keeps_every_value(spark):
    loc = spark.read.parquet(f"{DATA}/dim_location.parquet")
    got = queries_places.p4_places(spark, DATA)
    assert got.count() == 2 * loc.count()
    exact = got.join(spark.read.parquet(f"{DATA}/place_reference.parquet").select(F.col("kind").alias("field_name"), F.col("name").alias("value"), F.col("place_id").alias("own")), ["field_name", "value"])
    assert exact.where("place_id != own").count() == 0 and exact.count() > 0


@pytest.mark.parametrize(
    "text, path, name",
    [
        ("212/21 Đường Châu Xuyến", "212/21", "châu xuyến"), ("số 21 hẻm 212 Đ. Châu Xuyến", "212/21", "châu xuyến"), ("số 4 hẻm 755/16  P. Cồn", "755/16/4", "p cồn"),
        ("Duyên Rơm, 27", "27", "duyên rơm"), ("đg Mach Truc nhà 698/24", "698/24", "mach truc"), ("No. 5/3B Ổi", "5/3b", "ổi"), ("phố Cầu", "", "phố cầu"), ("", "", ""), (None, "", ""),
    ],
)
def test_read_street(text, path, name):
    assert read_street(text) == (path, name)


def test_numbers_in_names_of_streets_and_places():
    assert read_street("Đường 3 Tháng 2 số 45") == ("45", "3 tháng 2") and read_street("45 Đường 3 Tháng 2")[0] == "45"
    assert read_street("12 Đường Số 7") == ("12", "số 7") and read_street("Đường 3 Tháng 2, 45")[0] == "45"
    reader = Reader(Resolver(NUMBERED), {5: 31}, {5: 3})
    assert reader.read("12/3 Lê Sen", "", "Phường 5, Quận 3", "") == ("12/3", "lê sen", "", 31, 3)
    assert reader.read("", "", "12/3 Lê Sen, P.5, Quận 3, HCM", "") == ("12/3", "lê sen", "", 31, 3)


def test_street_levels():
    assert street_levels("quế ngà", "quế ngà")[1:] == (SAME, SAME)
    assert street_levels("quế ngà", "que nga")[1:] == (SAME, SAME)
    assert street_levels("q ngà", "quế ngà")[1:] == (SHORT, SAME)
    assert street_levels("quế ngàa", "quế ngà")[1:] == (SAME, ONE)
    assert street_levels("nghê ngà", "nghệ ngà")[1:] == (ACCENTS, SAME)
    assert street_levels("huyền khương", "huyen khuong")[1:] == (SAME, SAME) and street_levels("hyuen khuongnh", "huyền khương")[1:] == (ONE, TWO)
    assert street_levels("quangr trưởngg", "quảng trưở")[1:] == (ONE, THREE)
    assert street_levels("tuyền mơ", "uyển mộc")[1:] == (TWO, OTHER)
    assert street_levels("", "quế ngà")[1:] == (MISSING, MISSING)


def test_street_keys_are_sounds():
    assert street_keys("Trần Xuân Sen") == street_keys("t suan xeng") and street_keys("Quế Ngà") == street_keys("Kuê Ngã")
    assert street_keys("Sen Trúc")[1] == street_keys("Sen Chút")[1] != street_keys("Sen Mộc")[1] and street_keys("") == ("", "")


def test_place_levels():
    assert place_level(1, 7, 1, 8) == SAME_WARD
    assert place_level(0, 7, 2, 7) == SAME_DISTRICT and place_level(0, 7, 2, 8) == OTHER_DISTRICT and place_level(0, 0, 2, 8) == NO_PLACE


WORD = [0.02, 0.02, 0.01, 0.02, 0.03, 0.05, 0.01, 0.84]
CHANCE = [WORD, WORD, [0.02, 0.9, 0.03, 0.05]]


def test_estimate_separates():
    patterns = [(SAME, SAME, SAME_WARD), (ONE, SAME, SAME_WARD), (OTHER, OTHER, SAME_WARD), (OTHER, SAME, SAME_WARD), (SAME, SAME, NO_PLACE), (SHORT, SAME, SAME_WARD), (MISSING, MISSING, SAME_WARD)]
    weight = estimate(patterns, [400, 60, 900, 20, 12, 40, 5], CHANCE, 4_000)
    assert [weight[p] >= 0.5 for p in patterns[:6]] == [True, True, False, False, True, True]
    # a missing street counts as evidence of its own, weaker than any that agrees
    assert weight[patterns[2]] < weight[patterns[6]] < weight[patterns[0]]
    assert estimate([], [], CHANCE, 0) == {}


def form(i, path, street, ward, district=7, old=""):
    return (bytes([i]), path, street, old, ward, district)


FORM_SCHEMA = "form binary, path string, street string, street_old string, ward long, district long"


def test_flat_weights_link_others(spark):
    """The weights decide: with the same weight for every pattern other pairs would be linked."""
    rng, rows = random.Random(5), []
    words = "que nga lam sa tram vi sen dua cuc truc mo xoai".split()
    for i in range(240):
        rows.append(form(i, str(i % 12), f"{rng.choice(words)} {rng.choice(words)}", 1 + i % 3))
    numbered = [(n.to_bytes(2), *r[1:]) for n, r in enumerate(rows)]
    typos = [(n.to_bytes(2), r[1], r[2] + r[2][-1], *r[3:]) for n, r in enumerate(rows[:80], 500)]
    forms = spark.createDataFrame([*numbered, *typos], FORM_SCHEMA)
    pairs = compare_forms(forms).cache()
    weight = weigh(pairs, forms)
    by_weight = {(r.a, r.b) for r in linked(pairs, weight).collect()}
    flat = {(r.a, r.b) for r in linked(pairs, dict.fromkeys(weight, 1.0)).collect()}
    assert len({(n.to_bytes(2), (n + 500).to_bytes(2)) for n in range(80)} & {(bytes(a), bytes(b)) for a, b in by_weight}) >= 78
    assert len(flat) > 2 * len(by_weight) and by_weight < flat
    assert all(abs(sum(u) - 1) < 1e-9 for u in chance(forms))


def test_a_vague_form_joins_no_two_houses(spark):
    """A–X and X–B, where X has no ward or only a letter of the street: X goes to the better one, A and B stay apart."""
    links = [("a", "x", 3, 1, 0.9), ("b", "x", 3, 1, 0.8), ("a", "c", 3, 3, 0.99), ("x", "y", 1, 1, 0.99), ("d", "s", 3, 2, 0.7), ("e", "s", 3, 2, 0.7), ("u", "v", 1, 1, 0.9)]
    ids = {k: bytes([n]) for n, k in enumerate("abcdesuvxy")}
    df = spark.createDataFrame([(ids[a], ids[b], p, q, w) for a, b, p, q, w in links], "a binary, b binary, a_rank int, b_rank int, weight double")
    forms = spark.createDataFrame([(v,) for v in ids.values()], "form binary")
    house = {bytes(r.form): bytes(r.house) for r in houses(forms, settle(df)).collect()}
    at = {k: house[v] for k, v in ids.items()}
    assert at["a"] == at["x"] == at["c"] != at["b"] and at["y"] == ids["y"]
    assert at["s"] == at["d"] != at["e"] and at["u"] == at["v"]


def test_long_chain_is_one_house(spark):
    n = 41
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n - 1)], "a binary, b binary")
    forms = spark.createDataFrame([(bytes([i]),) for i in range(n + 1)], "form binary")
    got = {bytes(r.form): bytes(r.house) for r in houses(forms, links).collect()}
    assert got == {bytes([i]): bytes([0]) for i in range(n)} | {bytes([n]): bytes([n])}


def test_missing_street_meets_its_path_and_ward(spark):
    forms = spark.createDataFrame([form(1, "5", "", 1), form(2, "5", "quế ngà", 1), form(3, "5", "quế ngà", 2), form(4, "6", "", 1)], FORM_SCHEMA)
    got = {(bytes(r.a), bytes(r.b)): (r.first_l, r.rest_l, r.place_l) for r in compare_forms(forms).collect()}
    assert got == {(bytes([1]), bytes([2])): (MISSING, MISSING, SAME_WARD)}
    # three pairs share a path, two of them stand in two known wards
    assert comparable(forms) == 1 and comparable(forms.limit(0)) == 0


def test_houses(spark, resolver):
    rng, rows, want = random.Random(2), [], set()
    wards = {"Phường Quế Ngà": ["P. Que Nga", "quế ngà", "Phường Quế Nga"], "Phường Thạch Nếp": ["Thach Nep ward", "Phường Thạch Nếpp"]}
    streets = ["Cồn Sa", "Lúa Dừa", "Phong Trúc", "Miên Hạnh", "Vông Khuê"]
    key = 0
    for house in range(220):
        ward = rng.choice(list(wards))
        street = streets[house % 5]
        lane, number = 100 + house // 5, 1 + house % 3
        ways = [f"{lane}/{number} Đường {street}", f"số {number} hẻm {lane} {fold(street).title()}", f"phố {street.upper()}, SN {lane}/{number}", f"{lane}/{number} {street}{street[-1]}"]
        group = []
        for way in rng.sample(ways, rng.choice([1, 2, 3])):
            key += 1
            old = f"{way}, x, Quận Vĩ Sen, Hồ Chí Minh"
            rows.append((key, way, rng.choice([ward, *wards[ward]]), old, "Quận Vĩ Sen"))
            group.append(key)
        want |= {(a, b) for a in group for b in group if a < b}
        # the same street, but a further lane and a letter: other houses
        rows.append((key + 1, f"{lane}/{number}/2 Đường {street}", ward, "", ""))
        rows.append((key + 2, f"{lane}/{number}B Đường {street}", ward, "", ""))
        key += 2
    odd = [(9000, None, None, None, None), (9001, "Đường Không Số", "Phường Quế Ngà", "", ""), (9002, "Đường Không Số", "Phường Quế Ngà", "", ""), (None, "1 A B", "Phường Quế Ngà", "", "")]
    df = spark.createDataFrame([*rows, *odd, *rows[:9]], "listing_id long, address_street_new string, address_ward_new string, address_old_raw string, address_district_old string").withColumn("key", F.lit("clash"))
    reader = Reader(resolver, {9: 1, 10: 3}, {9: 7, 10: 7})
    placed, pairs = same_house(df, "listing_id", queries_places.ADDRESS, reader)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    assert placed.count() == len({r[0] for r in rows})
    assert same_house(df.limit(0), "listing_id", queries_places.ADDRESS, reader)[1].count() == 0

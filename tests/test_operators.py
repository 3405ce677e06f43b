"""Histories, merges, units, rejects, the star and skew, on small made-up tables."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brocade.operators import quarantine, scd2, star
from brocade.operators.history import observations, type_two_merge
from brocade.operators.quarantine import parse_or_reject, read_delimited
from brocade.operators.skew import hot_keys, over_key, with_neighbour
from brocade.operators.units import harmonise, with_written
from brocade.plans import quality

DAY = datetime(2024, 1, 1)


def brute_history(rows):
    out = []
    for entity in {r[0] for r in rows if r[0] is not None}:
        seen = {}
        for _, at, a, b in sorted((r for r in rows if r[0] == entity and r[1] is not None), key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "")):
            seen[at] = (a, b)
        versions = []
        for at in sorted(seen):
            if not versions or versions[-1][1] != seen[at]:
                versions.append((at, seen[at]))
        for i, (at, state) in enumerate(versions):
            out.append((entity, *state, at, versions[i + 1][0] if i + 1 < len(versions) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_type_two_merge(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice([1, 1, 1, 2, 3, None]), rng.choice([DAY + timedelta(days=rng.randrange(12)), None]), rng.choice([1, 2, None]), rng.choice(["x", "y", None]))
        for _ in range(120)
    ]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "k long, at timestamp, a int, b string").withColumn("entity", F.lit("clash"))
    seen = observations(df, "k", ["at"], ["a", "b"])
    # whatever part of the evidence is kept already and whatever comes late, the history is the same
    late = F.xxhash64("at", "a", "b", F.lit(seed)) % 3 == 0
    got = type_two_merge(seen.where(~late), seen.where(late), ["a", "b"])
    assert sorted(((r.entity, r.a, r.b, r.valid_from, r.valid_to) for r in got.collect()), key=str) == brute_history(rows)
    assert got.where(F.col("valid_to").isNull() != F.col("is_current")).count() == 0
    assert got.where("is_current").groupBy("entity").count().where("count > 1").count() == 0


def test_type_two_merge_of_nothing(spark):
    empty = spark.createDataFrame([], "k long, at timestamp, a int, b string")
    none = observations(empty, "k", ["at", "at"], ["a", "b"])
    assert type_two_merge(none, none, ["a", "b"]).count() == 0
    one = observations(spark.createDataFrame([(1, DAY, 2, "x")], empty.schema), "k", ["at"], ["a", "b"])
    assert [(r.is_new, r.is_current) for r in type_two_merge(none, one, ["a", "b"]).collect()] == [(True, True)]
    assert [(r.is_new, r.is_current) for r in type_two_merge(one, one, ["a", "b"]).collect()] == [(False, True)]


def test_merge_closes_and_inserts(spark):
    day = lambda n: DAY + timedelta(days=n)
    frame = lambda rows: observations(spark.createDataFrame(rows, "k long, at timestamp, a int"), "k", ["at"], ["a"])
    # kept: seen as 5 on day 0 and on day 10; the batch brings a late row inside that version and a change after it
    got = type_two_merge(frame([(1, day(0), 5), (1, day(10), 5)]), frame([(1, day(4), 6), (1, day(12), 7), (1, day(13), 7)]), ["a"])
    assert sorted((r.a, r.valid_from, r.valid_to, r.is_new) for r in got.collect()) == [
        (5, day(0), day(4), False), (5, day(10), day(12), False), (6, day(4), day(10), True), (7, day(12), None, True),
    ]


def test_neighbours_of_a_hot_key(spark):
    rows = [(1, i, i % 7) for i in range(3000)] + [(2, i, i) for i in range(50)] + [(None, 5, 5), (None, 6, 6)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, o int, v int").repartition(5)
    assert hot_keys(df, "k", share=0.1) == [1] and sorted(hot_keys(df, "k", share=0.001)) == [1, 2] and hot_keys(df.limit(0), "k") == []
    for ahead in (False, True):
        plain = with_neighbour(df, "k", ["o"], "v", "n", [], ahead)
        split = with_neighbour(df, "k", ["o"], "v", "n", [1], ahead, ranges=7)
        assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
    both = [over_key(df, "k", {"s": F.sum("v"), "m": F.min("o")}, hot) for hot in ([], [1])]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))


def test_merge_of_a_batch(spark):
    def b(i, listing, day, price):
        return (i, listing, DAY + timedelta(days=day), Decimal(price), False, False, False, Decimal("50.00"))

    values = "price_vnd decimal(16,0), price_is_negotiable boolean, is_expired boolean, has_warning boolean, area_m2 decimal(10,2)"
    kept = spark.createDataFrame(
        [(1, 1, DAY, None, True, DAY, Decimal(5), False, False, False, Decimal("50.00")), (2, 2, DAY, None, True, DAY, Decimal(7), False, False, False, Decimal("50.00"))],
        f"listing_key long, listing_id long, valid_from timestamp, valid_to timestamp, is_current boolean, last_seen_at timestamp, {values}",
    )
    batch = spark.createDataFrame([b(1, 1, 3, 5), b(2, 1, 5, 6), b(3, 1, 7, 5), b(4, 2, 4, 7), b(5, 3, 1, 9), b(6, 3, 1, 9)], f"obs_id long, listing_id long, crawl_date timestamp, {values}")
    rows = {(r.listing_id, (r.valid_from - DAY).days): r for r in scd2.merge(batch, kept).collect()}
    assert len(rows) == 5
    assert rows[1, 0].valid_to == DAY + timedelta(days=5) and not rows[1, 0].is_current
    assert rows[1, 5].valid_to == DAY + timedelta(days=7) and rows[1, 7].is_current
    assert rows[2, 0].is_current and rows[2, 0].last_seen_at == DAY + timedelta(days=4)
    assert rows[3, 1].is_new and rows[3, 1].is_current
    # what was merged once changes nothing when it comes again
    after = scd2.merge(batch, kept).withColumn("listing_key", F.monotonically_increasing_id())
    values = batch.select("listing_id", F.col("crawl_date").alias("valid_from"), *scd2.KEEP).unionByName(kept.select("listing_id", "valid_from", *scd2.KEEP)).distinct()
    again = scd2.opened(*scd2.compare(batch, after.join(values, ["listing_id", "valid_from"])))
    assert again.count() == 0


UNITS = [("price", "đồng", "đồng", 1.0), ("price", "triệu", "đồng", 1e6), ("price", "tỷ", "đồng", 1e9), ("price", "USD", "đồng", 25400.0), ("area", "m²", "m²", 1.0), ("area", "sào", "m²", 500.0)]


def test_units(spark):
    rows = []
    for k in range(40):  # each thing is written in several ways; half of the dollar rows are recorded without conversion
        million = 1010 + 30 * k
        rows += [
            (k, f"{million / 1000:.2f} tỷ".replace(".", ","), million * 10**6, "70 m²", 70.0),
            (k, f"{million}tr", million * 10**6, "70,0 m2", 70.0),
            (k, f"{million // 1000} tỷ {million % 1000:03d}", million * 10**6, "5 x 14", 70.0),
            (k, f"{million * 10**6:,} VND", million, "0,14 sao", None),
            (1000 + k, f"$ {million:,},000", million * 1000 * (25400 if k % 2 else 1), "1 sào", None),
            (1000 + k, f"{million:,}.000 USD".replace(",", "."), million * 1000 * 25400, "1 sào", 500.0),
        ]
    rows += [(1, None, 5, None, 5.0), (1, "", None, "", None), (1, "thỏa thuận", None, "kxđ", None), (None, "5 tỷ", None, "9 m²", None), (2, "20 triệu/m²/tháng", 20, "70 m²", 70.0), (2, "x" * 100_000, 1, "1" * 5000, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k long, p string, pv long, a string, av double")
    forms = with_written(with_written(df, "a", "area"), "p", "price")
    out = harmonise(forms, {"area": "av", "price": "pv"}, "k", UNITS, per={"price": "area"}).orderBy("i").collect()
    assert len(out) == len(rows)
    for k in range(40):
        million = 1010 + 30 * k
        got = [int(r.price_amount) for r in out[6 * k : 6 * k + 4]]
        assert got[1:] == [million * 10**6] * 3
        assert [int(r.price_amount) for r in out[6 * k + 4 : 6 * k + 6]] == [million * 1000 * 25400] * 2
        assert [int(r.area_amount) for r in out[6 * k : 6 * k + 4]] == [70] * 4
    tail = out[240:]
    assert [r.price_amount and int(r.price_amount) for r in tail[:5]] == [None, None, None, 5 * 10**9, 1400 * 10**6]
    empty = harmonise(forms.limit(0), {"area": "av", "price": "pv"}, "k", UNITS, per={"price": "area"})
    assert empty.count() == 0


def test_scales_travel_to_the_end_of_a_chain(spark):
    """Six forms in a row, each seen with its neighbour alone: every one gets its scale, however many rounds it takes."""
    forms, rows = ["tỷ", "aa", "bb", "cc", "dd", "ee", "gg"], []
    for i, (a, b) in enumerate(zip(forms, forms[1:])):
        for k in range(8):
            rows += [(100 * i + k, f"{3 + k} {a}"), (100 * i + k, f"{3000 + 1000 * k} {b}" if i == 2 else f"{3 + k} {b}")]
    df = spark.createDataFrame([(n, k, p, None, None, None) for n, (k, p) in enumerate(rows)], "i int, k long, p string, pv long, a string, av double")
    out = harmonise(with_written(with_written(df, "a", "area"), "p", "price"), {"area": "av", "price": "pv"}, "k", UNITS)
    got = {r.p.split()[1]: int(r.price_amount / r.price_value) if r.price_amount is not None else None for r in out.collect()}
    assert got == {"tỷ": 10**9, "aa": 10**9, "bb": 10**9, "cc": 10**6, "dd": 10**6, "ee": 10**6, "gg": 10**6}


def test_amounts_in_two_units(spark):
    texts = ["5 tỷ 200 nghìn", "5 tỷ 200 triệu", "5 tỷ 200", "5 tỷ 200 lạ", "5 x 14 m"]
    units = [*UNITS, ("price", "nghìn", "đồng", 1e3)]
    df = spark.createDataFrame([(i, i, t, None, "1 m²", 1.0) for i, t in enumerate([*texts, "1 tỷ", "1 triệu", "1 nghìn"])], "i int, k long, p string, pv long, a string, av double")
    out = harmonise(with_written(with_written(df, "a", "area"), "p", "price"), {"area": "av", "price": "pv"}, "k", units)
    got = {r.p: r.price_amount for r in out.collect()}
    # a form without links that names no unit has no scale: '# tỷ #' here, and the second of two where it is unknown
    assert [got[t] and int(got[t]) for t in texts[:4]] == [5_000_200_000, 5_200_000_000, None, None]


def test_records_over_lines(spark):
    files = {
        "f": ["1,a,2", '2,"b', "", 'c ""d"" ",3', '4,"x', "y", "z,5", '6,"e",7', "8,f,9"],  # the quote of record 4 is never closed
        "g": ['1,"' + "q", "r" * 10, 's",2', None, "3,t,4"],
    }
    rows = [(k, 10 * i, t, "clash") for k, ls in files.items() for i, t in enumerate(ls)]
    df = spark.createDataFrame(rows, "f string, n long, t string, lines string").repartition(3)
    whole = {(r.source, r.first_line): (r.lines, r.record) for r in quarantine.assemble_records(df, "f", "n", "t", r"^\d+,").collect()}
    assert whole["f", 10] == (3, '2,"b\n\nc ""d"" ",3') and whole["g", 0] == (3, '1,"q\n' + "r" * 10 + '\ns",2') and whole["g", 30] == (1, None)
    assert whole["f", 40] == (3, '4,"x\ny\nz,5') and whole["f", 70] == (1, '6,"e",7') and sum(n for n, _ in whole.values()) == len(rows)
    blind = {(r.source, r.first_line): r.lines for r in quarantine.assemble_records(df, "f", "n", "t").collect()}
    assert blind["f", 40] == 5  # it runs on until quotes balance again, here to the end
    made = T.StructType.fromDDL("id int, name string, amount int")
    records = quarantine.assemble_records(df, "f", "n", "t", r"^\d+,")
    got = {(r.source, r.first_line): (r.reason_code, r.name) for r in read_delimited(records, "record", ["source", "first_line"], made, {"id": int, "amount": int}).collect()}
    assert got["f", 40] == ("bad_quoting", None) and got["f", 10] == (None, 'b\n\nc "d" ') and got["g", 30][0] == "null_record" and got["f", 70] == (None, "e")
    assert quarantine.assemble_records(df.limit(0), "f", "n", "t").count() == 0


@pytest.mark.parametrize("chunk, most", [(3, 10_000), (2, 10_000), (50_000, 4)])
def test_records_over_chunks(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(quarantine, "CHUNK", chunk)
    monkeypatch.setattr(quarantine, "MOST_LINES", most)
    text = ['0,"a', "b", "c", "d", 'e",1', "2,f,3", '4,"g', 'h",5']
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "f string, n long, t string")
    got = sorted((r.first_line, r.lines, r.record) for r in quarantine.assemble_records(df, "f", "n", "t").collect())
    assert "\n".join(r for _, _, r in got) == "\n".join(text)
    assert [(a, n) for a, n, _ in got] == ([(0, 5), (5, 1), (6, 2)] if most > 5 else [(0, 4), (4, 1), (5, 1), (6, 2)])


def test_too_large_is_a_reason(spark):
    record = T.StructType.fromDDL("id smallint, amount decimal(4,2)")
    df = spark.createDataFrame([(1, "40000,1"), (2, "1,100"), (3, "1,99.994"), (4, "1,99.995"), (5, "1,NaN")], "n int, line string")
    got = {r.n: r.reason_code for r in read_delimited(df, "line", ["n"], record, {"id": int, "amount": Decimal}).collect()}
    assert got == {1: "overflow_id", 2: "overflow_amount", 3: None, 4: "overflow_amount", 5: "overflow_amount"}


def test_scratch_deletes_its_tables(spark):
    from brocade.session import cut, keep, scratch, there

    with scratch(spark):
        path, kept = keep(spark.range(3))
        inside = cut(spark.range(5))
        files = inside.inputFiles()
        assert inside.count() == 5 and files
    assert there(spark, path) and kept.count() == 3 and not there(spark, files[0].rsplit("/", 1)[0])


def test_delimited_rejects(spark):
    lines = ["1,a,2.5", '2,"b, c",3', "3,d", "4,e,x", '5,"open,1', "y,f,1", "6,,", None, "", '7,"a""b",1']
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    record = T.StructType.fromDDL("id bigint, name string, amount decimal(9,2)")
    got = {r.n: r for r in read_delimited(df, "line", ["n"], record, {"id": int, "amount": Decimal}).collect()}
    assert {n: r.reason_code for n, r in got.items() if r.reason_code} == {2: "column_count", 3: "invalid_amount", 4: "bad_quoting", 5: "invalid_id", 7: "null_record", 8: "column_count"}
    assert (got[1].name, got[6].name, got[9].name, got[0].amount) == ("b, c", None, 'a"b', Decimal("2.50"))
    assert read_delimited(df.limit(0), "line", ["n"], record, {}).count() == 0
    with pytest.raises(ValueError, match="clash"):
        parse_or_reject(df, ["n"], ["line"], lambda x: (None, {}), T.StructType.fromDDL("n int"))


def test_star_keys_stay(spark):
    known = spark.createDataFrame([(7, "b", "y"), (9, None, "z")], "key bigint, a string, b string")
    found = spark.createDataFrame([("b", "y"), ("c", "x"), ("a", "x"), (None, "z"), ("d", "x")], "a string, b string")
    rows = star.insert_ignore(known, found, ["a", "b"], "key").collect()
    assert {(r.a, r.b): r.key for r in rows} == {("b", "y"): 7, (None, "z"): 9, ("a", "x"): 10, ("c", "x"): 11, ("d", "x"): 12}
    assert star.insert_ignore(known, found.limit(0), ["a", "b"], "key").count() == 2
    new = spark.createDataFrame([(7, "n", "n")], "key bigint, a string, b string")
    assert sorted((r.key, r.a) for r in star.upsert(known.fillna("-"), new, "key").collect()) == [(7, "n"), (9, "-")]


def test_dim_date(spark):
    days = spark.createDataFrame([("2024-02-27",), ("2024-03-01",), (None,)], "d string").select(F.to_date("d").alias("posted_date"))
    assert [r.date_key for r in star.dim_date(days).orderBy("date_key").collect()] == [20240227, 20240228, 20240229, 20240301]
    assert star.dim_date(days.limit(0)).count() == 0


def test_failed_checks_raise(spark):
    checks = spark.createDataFrame([("good", True), ("bad", False)], "check_name string, passed boolean")
    with pytest.raises(ValueError, match="bad"):
        quality.require_valid(checks)
    quality.require_valid(checks.where("passed"))


def test_required_columns(spark, tmp_path):
    from brocade.sources import bronze

    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="html"):
        bronze.read_pages(spark, str(tmp_path / "x"))


def test_append_replaces_its_own_partitions(spark, tmp_path):
    from brocade.sources import bronze

    path = str(tmp_path / "staging")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, source_bronze_key string")
    bronze.append_table(df, path)
    bronze.append_table(df.where("v = 2").withColumn("v", F.lit(3)), path)
    bronze.append_table(df.where("v = 1"), path)
    assert sorted((r.v, r.source_bronze_key) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]

"""Percentiles against brute force and DuckDB, and source mixing against its own promises."""

import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from conftest import DATA, compare
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brocade.llm import queries_numbers, queries_text
from brocade.llm.mixing import budgets, choose, fit_lengths, plan_lengths
from brocade.llm.percentiles import combine, percentiles, significant, summarise

TARGETS = {"p01": (1, 100), "p50": (1, 2), "p99": (99, 100), "p100": (1, 1)}


@pytest.mark.parametrize("name", sorted(queries_numbers.QUERIES))
def test_against_sql(spark, duck, name):
    compare(spark, duck, queries_numbers.QUERIES[name], queries_numbers.SQL[name])


def test_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, float("nan"), float("inf"), float("-inf"), None, 3.0)], "g string, x double")
    assert [(r.n, r.p50) for r in percentiles(summarise(df, ["g"], "x"), ["g"], TARGETS).collect()] == [(2, 1)]


def brute(values, p, q):
    ordered = sorted(values)
    return ordered[max(1, -(-len(ordered) * p // q)) - 1]


@pytest.mark.parametrize("digits", [None, 3])
def test_percentiles(spark, digits):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, Decimal(rng.randrange(-10**6, 10**7)) / 100, Decimal("5.00")]), "clash") for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x decimal(15,2), n string")
    halves = [summarise(part, ["g"], "x", decimals=2, digits=digits) for part in df.randomSplit([0.5, 0.5], 1)]
    whole = combine(halves[0].unionByName(halves[1]), ["g"])
    got = {r.g: r for r in percentiles(whole, ["g"], TARGETS, ranges=5).collect()}
    assert got.keys() == {"a", "b", None}
    for g, row in got.items():
        units = [int(x * 100) for k, x, _ in rows if k == g and x is not None]
        assert row.n == len(units)
        for name, (p, q) in TARGETS.items():
            exact = brute(units, p, q)
            assert row[name] == exact if digits is None else abs(row[name] - exact) <= 0.5 * 10 ** (1 - digits) * abs(exact)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, x decimal(15,2)")
    assert percentiles(summarise(df, ["g"], "x", 2), ["g"], TARGETS).count() == 0


def test_significant(spark):
    cases = {0: 0, 7: 7, 12345: 12350, 12344: 12340, -12345: -12350, 99995: 100000, 10**17 + 1: 10**17}
    rows = spark.createDataFrame([(k,) for k in cases], "u long").select("u", significant(F.col("u"), 4).alias("s")).collect()
    assert {r.u: r.s for r in rows} == cases


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=8), st.integers(0, 2000))
def test_fit_is_exact_where_it_can_be(histogram, budget):
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))
    take = fit_lengths(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    reach = 1
    for length, n in histogram.items():
        for _ in range(n):
            reach |= reach << length
    best = max(s for s in range(min(budget, int((lengths * counts).sum())) + 1) if reach >> s & 1)
    assert int((take * lengths).sum()) == best


def test_fit_of_large_sources():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(5, 5000, 900))
    counts = rng.integers(1, 3000, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (0, 1, total // 3, total - 1, total, total + 5):
        take = fit_lengths(lengths, counts, budget)
        assert (take <= counts).all() and 0 <= min(budget, total) - int((take * lengths).sum()) <= lengths.min()


def test_budgets():
    # b can give 30 at most; what it lacks goes to the others in proportion
    assert budgets([("a", 0.5, 1, 200), ("b", 0.5, 3, 10)], 100) == {"a": 70, "b": 30}
    assert budgets([("a", 0.4, 1, 500), ("b", 0.4, 1, 500), ("c", 0.2, 9, 0)], 100) == {"a": 50, "b": 50, "c": 0}
    assert budgets([("a", 0.0, 1, 5)], 10) == {"a": 0} and budgets([], 10) == {}


def test_choice_is_seeded_and_exact(spark):
    docs = [(i, "one", 10) for i in range(20_000)] + [(100_000 + i, "many", 1 + i % 50) for i in range(3000)] + [(900_000, "none", 5)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("one", 0.6, 1), ("many", 0.4, 3), ("absent", 0.0, 2)], "source string, share double, cap int")
    totals = {"one": 200_000, "many": sum(d[2] for d in docs if d[1] == "many"), "absent": 0}
    size = 150_000
    histogram = sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    runs = [sorted(map(tuple, choose(sized.repartition(k), plan_lengths(histogram, targets, size, totals)).collect())) for k in (3, 7)]
    assert runs[0] == runs[1]
    used = Counter()
    for _, source, n, uses in runs[0]:
        used[source] += n * uses
        assert 1 <= uses <= {"one": 1, "many": 3}[source]
    assert used == {"one": 90_000, "many": 60_000}


def test_mix_query(spark):
    shares = {r.source: r for r in queries_text.p8_shares(spark, DATA).collect()}
    mix = queries_text.p8_mix(spark, DATA).collect()
    assert len({r.doc_id for r in mix}) == len(mix)
    total = sum(r.n_tokens * r.uses for r in mix)
    corpus = next(iter(shares.values())).corpus_tokens
    assert 0.95 * corpus <= total <= corpus + len(shares)  # whole documents: a small source can miss its budget
    assert all(r.uses <= shares[r.source].max_repeats for r in mix)
    assert sum(r.mix_tokens for r in shares.values()) == total

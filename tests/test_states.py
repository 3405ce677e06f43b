"""State tables: guards, claims, late returns and crash decisions, on small made-up tables; percentiles by ranks."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from brocade.operators import states
from brocade.operators.ranks import percentile_cont

NOW = datetime(2025, 6, 1)


@pytest.fixture
def queue(spark):
    rows = [(1, "pending", NOW, None, "x"), (2, "pending", NOW, None, "x"), (3, "processing", NOW, NOW - timedelta(days=2), "x"), (4, "done", NOW, NOW - timedelta(days=2), "x"), (5, None, NOW, None, None)]
    return spark.createDataFrame(rows, "id long, status string, discovered_at timestamp, claimed_at timestamp, other string")


def test_claim_breaks_ties_by_key(queue):
    after, first = states.claim(queue, 1, ["discovered_at"], "id", "pending", {"status": F.lit("processing")})
    assert [r.id for r in first.collect()] == [1] and {r.id: r.status for r in after.collect()} == {1: "processing", 2: "pending", 3: "processing", 4: "done", 5: None}
    assert states.claim(queue.limit(0), 1, [], "id", "pending", {})[0].count() == 0


def test_moves_are_guarded(queue):
    stale = states.older_than(F.col("claimed_at"), 3600, F.lit(NOW))
    assert {r.id: r.status for r in states.move(queue, stale, "pending", states.UNDER_WAY).collect()} == {1: "pending", 2: "pending", 3: "pending", 4: "done", 5: None}
    hits = queue.select("id").where("id in (2, 4, 5)").union(queue.select("id")).where("id > 3")
    assert {r.id: r.status for r in states.move_keys(queue, "id", hits, "failed", ("done",)).collect()}[4] == "failed"
    assert states.move_keys(queue, "id", hits, "failed", ("done",)).columns == queue.columns


def test_crash_decisions(spark):
    runs = spark.createDataFrame(
        [("cur", NOW, None, 3), ("full", NOW - timedelta(days=1), None, 99), ("lost", NOW - timedelta(days=1), None, 99), ("few", NOW - timedelta(days=1), None, 3), ("new", NOW, None, 3), ("end", NOW - timedelta(days=1), NOW, 3)],
        "run_id string, started_at timestamp, ended_at timestamp, detail_pages_done int",
    )
    files = spark.createDataFrame([("full", "a.parquet.inprogress"), ("few", "b.parquet.inprogress")], "run_id string, open_key string")
    got = {r.run_id: (r.decision, r.final_key) for r in states.crash_decisions(runs, files, "cur", 50, 3600, F.lit(NOW)).collect()}
    assert got == {"cur": ("reset", None), "full": ("recovered", "a.parquet"), "lost": ("incomplete", None), "few": ("incomplete", None)}


def test_fetch_outcome_order(spark):
    rows = [(True, "e", 200, "", "proxy_issue"), (False, "e", 429, "", "fetch_error"), (False, None, None, "", "fetch_error"), (False, None, 429, "", "proxy_issue"), (False, None, 502, "", "fetch_error"),
            (False, None, 404, "Tôi không phải Người Máy", "proxy_issue"), (False, None, 404, None, "fetch_error"), (False, None, 204, None, "ok"), (False, None, 301, "x", "fetch_error")]
    df = spark.createDataFrame(rows, "p boolean, e string, s int, h string, want string")
    assert df.where(states.fetch_outcome(F.col("p"), F.col("e"), F.col("s"), F.col("h")) != F.col("want")).count() == 0


def test_percentile_cont(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, -3.5, 7.25, rng.uniform(-5, 1e9), rng.uniform(0, 1e-6), None])) for _ in range(800)] + [("c", None), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.1, 0.5, 0.93, 1.0):
        got = {r.g: r.m for r in percentile_cont(df, ["g"], "v", q, "m").collect()}
        want = {g: float(np.quantile([v for k, v in rows if k == g and v is not None], q)) for g in ("a", "b", None, "d")}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-12) for g in want)
    assert percentile_cont(df, [], "v", 0.5, "m").first().m == pytest.approx(float(np.median([v for _, v in rows if v is not None])))
    assert percentile_cont(df.limit(0), ["g"], "v", 0.5, "m").count() == 0

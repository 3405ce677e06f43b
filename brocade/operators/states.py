"""Tables of states as frames: claims, guarded moves, late returns and what is left to do.

A state table is never updated in place: each operator is a function from the table to the table after it, to be
written as a new snapshot by one writer (a batch of a stream, say), which takes the place of row locks. `as_of` is
always given, so that a run can be repeated.

Defined cases: null states and times satisfy no guard; keys that aren't in the table change nothing; ties in an
order are broken by the key; empty tables give empty tables; other columns pass through as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brocade.sources.bronze import CAPTCHA

#: States of a queued page and of a file, reasons of a run that ended as planned.
UNDER_WAY = ("processing", "fetched", "flushed")
PLANNED = ("max_pages", "time_box", "no_more_data")
LONGEST_ERROR = 2000


def fetch_outcome(proxy_failed: Column, error: Column, status: Column, html: Column) -> Column:
    """ok, fetch_error or proxy_issue: what becomes of a request. The first that holds decides."""
    asks = F.coalesce(F.contains(F.lower(html), F.lit(CAPTCHA.lower())), F.lit(False))
    proxy, failed = F.lit("proxy_issue"), F.lit("fetch_error")
    return (
        F.when(proxy_failed, proxy).when(error.isNotNull() | status.isNull(), failed).when(status == 429, proxy).when(status >= 500, failed)
        .when(asks, proxy).when(status.between(200, 299), F.lit("ok")).otherwise(failed)
    )


def run_succeeded(reason: Column, pages: Column, least: int) -> Column:
    return F.coalesce(reason.isin(*PLANNED), F.lit(False)) | F.coalesce(pages >= least, F.lit(False))


def older_than(at: Column, seconds: int, as_of: Column) -> Column:
    return F.coalesce(at < as_of - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))


def shortened(error: Column) -> Column:
    return F.substring(error, 1, LONGEST_ERROR)


def move(table: DataFrame, chosen: Column, to: str, guard: Sequence[str] | None = None, sets: Mapping[str, Column] | None = None) -> DataFrame:
    """table with status `to` and the columns of sets where chosen holds and the status is one of guard (any, if None)."""
    hit = F.coalesce(chosen, F.lit(False)) & (F.coalesce(F.col("status").isin(*guard), F.lit(False)) if guard is not None else F.lit(True))
    new = {"status": F.lit(to), **(sets or {})}
    return table.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def move_keys(table: DataFrame, key: str, keys: DataFrame, to: str, guard: Sequence[str] | None = None, sets: Mapping[str, Column] | None = None) -> DataFrame:
    """`move` of the rows whose key is among keys (one column of the key's name)."""
    marked = table.join(keys.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return move(marked, F.col("__hit"), to, guard, sets).select(*table.columns)


def claim(table: DataFrame, n: int, order: Sequence[str], key: str, waiting: str, sets: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table after the first n waiting rows by order have been claimed, and those rows as they were."""
    first = table.where(F.col("status") == waiting).orderBy(*order, key).limit(n)
    marked = table.join(first.select(key, F.lit(True).alias("__hit")), key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    return marked.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in table.columns]), first


def add_missing(table: DataFrame, rows: DataFrame, key: Sequence[str], first_by: Sequence[str]) -> DataFrame:
    """table and those of rows whose key it lacks, one row a key: the first by first_by."""
    rest = [c for c in rows.columns if c not in key]
    one = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*first_by)).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])
    return table.unionByName(one.join(table.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def parts_to_process(states: DataFrame, keys: DataFrame) -> DataFrame:
    """part_number of parts that wait or failed, and of those called done whose file isn't among keys; in order."""
    stored = keys.select(F.col("key").alias("s3_key")).distinct()
    lost = states.where("status = 'done'").join(stored, "s3_key", "left_anti")
    return states.where("status in ('pending', 'failed')").select("part_number").union(lost.select("part_number")).distinct().orderBy("part_number")


def crash_decisions(runs: DataFrame, open_files: DataFrame, current: str, least: int, seconds: int, as_of: Column) -> DataFrame:
    """run_id, decision, final_key of runs without an end: the current one, and others started long enough ago. A run
    with enough pages whose unfinished file is there is promoted (its pages are done), another one is discarded (its
    pages wait again); of the current run only the counter is reset then."""
    mine = F.col("run_id") == current
    died = runs.where(F.col("ended_at").isNull() & (mine | older_than(F.col("started_at"), seconds, as_of)))
    there = died.join(open_files.select("run_id", "open_key").distinct(), "run_id", "left")
    promoted = (F.col("detail_pages_done") >= least) & F.col("open_key").isNotNull()
    # a current run with enough pages but no file goes on as it is
    kept = mine & (F.col("detail_pages_done") >= least)
    decision = F.when(promoted, F.lit("recovered")).when(kept, F.lit("continued")).when(mine, F.lit("reset")).otherwise(F.lit("incomplete"))
    return there.select("run_id", decision.alias("decision"), F.when(promoted, F.regexp_replace("open_key", r"\.inprogress$", "")).alias("final_key"))

"""Neighbour rows within a key, safe when one key holds a large part of all rows.

A plain window puts every row of a key into one task. Here the keys that hold more than a
given share of the rows (at most 1/share of them, so the list is small by construction) take a
second way: their rows are range-partitioned by (key, order), looked at within each range, and
the ranges' edge rows, one per range and key, supply the neighbours across range borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brocade.session import cut

HOT_SHARE = 1 / 500


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Values of key (null left out) that hold more than share of the rows; fewer than 1/share values, whatever the
    data. One aggregate that reads the key alone, after a count of the rows, which reads none of their columns. (An Observation
    would count on the way, but a session that has held one can't run models of MLlib any more: Spark 4.1 then fails to
    serialise their functions.)"""
    rows = df.count()
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.where(F.col(key).isNotNull()).orderBy(F.desc("__n"), key).limit(int(1 / share)).collect()
    floor = rows * share
    return [r[key] for r in top if r["__n"] > floor]


def over_key(df: DataFrame, key: str, aggregates: Mapping[str, Column], hot: Sequence) -> DataFrame:
    """df with the aggregates over all rows of its key. Keys in hot are aggregated apart and joined: one row a key."""
    cold_rows = df if not hot else df.where(F.col(key).isNull() | ~F.col(key).isin(list(hot)))
    cold = cold_rows.withColumns({n: a.over(Window.partitionBy(key)) for n, a in aggregates.items()})
    if not hot:
        return cold
    rows = df.where(F.col(key).isin(list(hot)))
    return cold.unionByName(rows.join(F.broadcast(rows.groupBy(key).agg(*[a.alias(n) for n, a in aggregates.items()])), key))  # at most 1/share rows


def with_neighbour(
    df: DataFrame, key: str, order: Sequence[str], value: str, out: str, hot: Sequence, ahead: bool = False, ranges: int | None = None
) -> DataFrame:
    """df with column out: value of the row before (ahead: after) in its key by order, null at the end.

    order must be a total order within a key. Keys in hot are split by range; the result is the same."""
    step = F.lead if ahead else F.lag
    cold_rows = df if not hot else df.where(F.col(key).isNull() | ~F.col(key).isin(list(hot)))
    cold = cold_rows.withColumn(out, step(value).over(Window.partitionBy(key).orderBy(*order)))
    if not hot:
        return cold
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = cut(
        df.where(F.col(key).isin(list(hot))).repartitionByRange(ranges, key, *order).withColumn("__range", F.spark_partition_id())
    )
    first: Column = F.struct(*order)
    edge = F.min_by if ahead else F.max_by
    edges = split.groupBy(key, "__range").agg(edge(F.struct(F.col(value).alias("v")), first).alias("__edge"))
    across = edges.select(key, "__range", step("__edge").over(Window.partitionBy(key).orderBy("__range")).alias("__next"))
    inside = Window.partitionBy(key, "__range").orderBy(*order)
    last = step(F.lit(True)).over(inside).isNull()
    near = (
        split.withColumn("__own", step(value).over(inside)).withColumn("__last", last)
        .join(F.broadcast(across), [key, "__range"], "left")
        .withColumn(out, F.when(F.col("__last"), F.col("__next.v")).otherwise(F.col("__own")))
        .select(*df.columns, out)
    )
    return cold.unionByName(near)

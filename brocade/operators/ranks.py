"""Interpolated percentiles per group by counts and ranks, so that no task holds a group's values.

Values are counted by group and value, which combines before the shuffle. A monotone bucket of the value (1,024 to
an octave) gives each group a short list of bucket sums; their running sums show which buckets hold the two ranks
that are asked for, and only those buckets' values are looked through.

Defined cases: null values are left out and a group of nothing else isn't in the result; a null group is a group of
its own; ties and repeated rows only add to counts; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(v: Column) -> Column:
    size = F.floor((F.log2(F.abs(v)) + 1100) * 1024)  # the smallest double is 2 ** -1074
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def percentile_cont(df: DataFrame, groups: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """groups and out (double): the q-th percentile of value, interpolated between the two values around it."""
    g = [f"__g{i}" for i in range(len(groups))] or ["__g"]
    keys = [F.col(c).alias(n) for c, n in zip(groups, g)] or [F.lit(0).alias("__g")]
    v = F.col(value).cast("double").alias("__v")
    counts = df.select(*keys, v).where("__v is not null").groupBy(*g, "__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", _bucket(F.col("__v")))
    sums = counts.groupBy(*g, "__b").agg(F.sum("__n").alias("__bn"))
    in_order = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    at = F.lit(q) * (F.col("__total") - 1)
    placed = (
        sums.withColumn("__upto", F.sum("__bn").over(in_order)).withColumn("__total", F.sum("__bn").over(Window.partitionBy(*g)))
        .withColumn("__before", F.col("__upto") - F.col("__bn")).withColumn("__low", F.floor(at) + 1).withColumn("__high", F.ceil(at) + 1)
    )
    holds = lambda rank: (F.col("__before") < F.col(rank)) & (F.col(rank) <= F.col("__upto"))
    asked = placed.where(holds("__low") | holds("__high")).select(*[F.col(c).alias(f"{c}_") for c in g], F.col("__b").alias("__b_"), "__before", "__low", "__high", (at - F.floor(at)).alias("__part"))
    near = counts.join(asked, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in g] + [F.col("__b") == F.col("__b_")])
    inside = Window.partitionBy(*g, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("__rank", F.col("__before") + F.sum("__n").over(inside))
    first = lambda rank: F.min(F.when(F.col("__rank") >= F.col(rank), F.col("__v")))
    found = ranked.groupBy(*g).agg(first("__low").alias("__x"), first("__high").alias("__y"), F.first("__part").alias("__part"))
    return found.select(*[F.col(n).alias(c) for c, n in zip(groups, g)], (F.col("__x") + F.col("__part") * (F.col("__y") - F.col("__x"))).alias(out))

"""Problem 1: percentiles of very large numeric columns, per group, with bounded error.

The summary of any part of the data is a table of (group, value, n): counts by value, the value in
minor units (bigint) rounded half up to `digits` significant digits. Two summaries combine by adding
the counts (`combine`), so files or days can be summarised apart. Percentiles are read off the
cumulative frequencies: the counts are range-sorted by (group, value), running sums are taken within
each range, the sums of the ranges before are added, and the first value that reaches a target rank
is taken.

Error: rounding is monotone, so the answer is exactly the rounded percentile_disc of the exact values:
a relative error of at most 0.5 * 10**(1 - digits), 0.05 % for 4 digits; with digits None it is none.
Size: with d digits a group holds at most 9 * 10**(d-1) values per decade and sign, whatever its rows;
that bound keeps a hot group from filling one task. Exact summaries hold the distinct values.

Defined cases
- null, NaN and infinite values are left out; a group with no other value isn't in the result.
- a null group is a group of its own.
- zero stays zero, negative values round by magnitude. Ties and repeated rows only add to n.
- rank of percentile q among n values: ceil(q * n), at least 1 (percentile_disc).
- an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brocade.session import cut

DIGITS = 4


def significant(units: Column, digits: int | None) -> Column:
    """A bigint rounded half up, by magnitude, to so many significant digits."""
    if digits is None:
        return units
    powers = F.array(*[F.lit(10**i).cast("bigint") for i in range(19)])
    size = F.abs(units)
    unit = F.element_at(powers, F.greatest(F.length(size.cast("string")) - digits, F.lit(0)) + 1)
    kept = F.call_function("div", size + F.call_function("div", unit, F.lit(2)), unit) * unit
    return F.when(units < 0, -kept).otherwise(kept)


def minor_units(value: Column, decimals: int) -> Column:
    """The value in whole units of 10**-decimals, rounded half up."""
    return F.round(value * F.lit(10**decimals), 0).cast("bigint")


def summarise(df: DataFrame, groups: Sequence[str], value: str, decimals: int = 0, digits: int | None = DIGITS) -> DataFrame:
    """groups, v, n: the mergeable summary. Counted before it is shuffled."""
    v = significant(minor_units(F.col(value), decimals), digits)
    there = F.col(value).isNotNull()
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        there = there & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return df.where(there).groupBy(*groups, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def combine(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The summary of the union of what several summaries stand for."""
    return parts.groupBy(*groups, "v").agg(F.sum("n").alias("n"))


def percentiles(summary: DataFrame, groups: Sequence[str], targets: Mapping[str, tuple[int, int]], ranges: int | None = None) -> DataFrame:
    """groups, n and one bigint column (minor units) for each target, name -> (numerator, denominator)."""
    spark = summary.sparkSession
    n_ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = summary.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], "v", "n")
    g = [f"g{i}" for i in range(len(groups))]
    # fixed before use: the ranges' borders are sampled, so two readings must not sample twice
    ranged = cut(keyed.repartitionByRange(n_ranges, *g, "v").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy(*g, "part").agg(F.sum("n").alias("here"))
    by_part = Window.partitionBy(*g).orderBy("part")
    offsets = parts.select(
        *g, "part",
        (F.sum("here").over(by_part) - F.col("here")).alias("before"),
        F.sum("here").over(Window.partitionBy(*g)).alias("total"),
    )
    inside = Window.partitionBy(*g, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.select(*g, "part", "v", F.sum("n").over(inside).alias("run"))
    same = [running[c].eqNullSafe(offsets[c]) for c in g] + [running["part"] == offsets["part"]]
    cumulative = running.join(offsets, same).select(
        *[running[c] for c in g], "v", (F.col("before") + F.col("run")).alias("cum"), "total"
    )
    first = [
        F.min(F.when(F.col("cum") >= F.greatest(F.lit(1), F.call_function("div", F.col("total") * p + (q - 1), F.lit(q))), F.col("v"))).alias(name)
        for name, (p, q) in targets.items()
    ]
    return cumulative.groupBy(*g).agg(F.max("total").alias("n"), *first).select(
        *[F.col(c).alias(name) for c, name in zip(g, groups)], "n", *targets
    )

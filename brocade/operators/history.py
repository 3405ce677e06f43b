"""History of changing entity attributes: type-two versions by a merge of observations into what is kept.

Problem 5. `type_two_merge` merges a batch of observations into the kept evidence of earlier ones: the hash of
each observation's attributes is compared with that of the version valid at its moment; where it differs, that
version is closed at the moment and a new one inserted, open until the next change. Evidence comes late and
out of order, so the version valid at a moment is the one of the observation before it in time, kept or new;
a late row inside a version splits it, since the version was seen again after it. All three steps look at
neighbours in one order, so the rows are shuffled and sorted once and nothing is updated in place.

Defined cases
- null attributes: a null equals a null and differs from every value (hash text 'NULL').
- an observation with null entity or null time is no evidence and is left out.
- equal observations at one moment are one. Of several that differ at one moment, one is kept: the
  last by the attributes' values in their order, so the result doesn't depend on row order.
- an empty batch gives the versions of the kept evidence, empty evidence those of the batch, both empty an
  empty history. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brocade.operators.skew import hot_keys, with_neighbour


def attribute_hash(*columns: str | Column) -> Column:
    """MD5 of the columns' text joined by '|'; null is the text 'NULL'."""
    parts: list[Column] = []
    for i, c in enumerate(columns):
        col = F.col(c) if isinstance(c, str) else c
        parts += ([F.lit("|")] if i else []) + [F.coalesce(col.cast("string"), F.lit("NULL"))]
    return F.md5(F.concat(*parts))


def observations(df: DataFrame, entity: str, times: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row per row of df and time column: entity, attributes, at. A row with several time columns was seen at
    each of them."""
    at = F.explode(F.array(*[F.col(t) for t in times])) if len(times) > 1 else F.col(times[0])
    seen = df.select(F.col(entity).alias("entity"), *attributes, at.alias("at"))
    return seen.where("entity is not null and at is not null")


def type_two_merge(kept: DataFrame, batch: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per version after the merge of two tables of `observations`: entity, attributes, row_hash, valid_from,
    valid_to (null while current), is_current, is_new (the batch opened it).

    Entities that hold a large part of the rows are split by time range."""
    seen = kept.withColumn("__kept", F.lit(True)).unionByName(batch.withColumn("__kept", F.lit(False)))
    hot = hot_keys(seen, "entity")
    order = ["at", *attributes, "__kept"]  # of several at one moment the last counts, the kept one of two equal ones
    moments = with_neighbour(seen, "entity", order, "at", "__next_at", hot, ahead=True)
    once = moments.where(F.col("__next_at").isNull() | (F.col("__next_at") != F.col("at"))).drop("__next_at")
    hashed = once.withColumn("row_hash", attribute_hash(*attributes))  # after the shuffle, so that no hash is sent
    compared = with_neighbour(hashed, "entity", order, "row_hash", "__valid_hash", hot)
    inserted = compared.where(~F.col("__valid_hash").eqNullSafe(F.col("row_hash"))).drop("__valid_hash")
    closed = with_neighbour(inserted, "entity", order, "at", "valid_to", hot, ahead=True)
    return closed.select(
        "entity", *attributes, "row_hash", F.col("at").alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"), (~F.col("__kept")).alias("is_new")
    )

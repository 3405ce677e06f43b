"""Parquet tables by name under a scale-factor folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from brocade.session import ship


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The table; with columns, only these (a missing one is an error naming the table)."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns is None:
        return df
    require_columns(df, columns, name)
    return df.select(*columns)


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "input") -> DataFrame:
    """df itself, or an error naming the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    return df

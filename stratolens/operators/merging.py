"""Row-level merges: first or best row of a key, unions by precedence, tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def best_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. An aggregation, not a window: each task passes on one row a key, so a busy key costs nothing. order must be of numbers or of columns that compare upwards; ascending."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*cols).alias("_row"))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b._row.{c}").alias(c) for c in cols])


def replaced(existing: DataFrame, new: DataFrame, scope: Column, keys: Sequence[str], *tie: Column) -> DataFrame:
    """new instead of the rows of existing within a scope; of rows with one key the new one stays."""
    both = existing.filter(~scope).withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return best_per_key(both, keys, F.col("_age"), *tie).drop("_age")


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def unpivoted(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A row for each of the columns."""
    return df.unpivot(list(ids), list(columns), name, value)

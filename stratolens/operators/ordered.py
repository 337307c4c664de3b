"""Order-dependent columns for keys that may hold any share of the rows.

A key's rows are cut into parts that follow one another in the order (say, days). Windows run inside a part; what goes on
from part to part is one row a part, and only those rows of a key meet in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import staging


def neighbours(df: DataFrame, keys: Sequence[str], part: str, order: Sequence[str], **columns: tuple[str, int]) -> DataFrame:
    """Adds name=(column, step): the column of the row before (step -1) or after (step 1) in the order within the keys."""
    inside = W.partitionBy(*keys, part).orderBy(*order)
    across = W.partitionBy(*keys).orderBy(part)
    held = list(dict.fromkeys(c for c, _ in columns.values()))
    row = F.struct(*order, *[F.col(c).alias(f"_v_{c}") for c in held])
    ends = df.groupBy(*keys, part).agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    ends = ends.select(*keys, part, F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    out = df.join(ends, [*keys, part])
    for name, (c, step) in columns.items():
        near, far, edge = (F.lag(c), "_before", F.lag(F.lit(1))) if step < 0 else (F.lead(c), "_after", F.lead(F.lit(1)))
        out = out.withColumn(name, F.when(edge.over(inside).isNull(), F.col(f"{far}._v_{c}")).otherwise(near.over(inside)))
    return out.drop("_before", "_after")


def running(df: DataFrame, keys: Sequence[str], part: str, order: Sequence[str], name: str, column: str, how: str = "max", own: bool = True) -> DataFrame:
    """Adds the running max or sum of a column within the keys, with the row's own value or (own=False) up to the row before."""
    f = getattr(F, how)
    inside = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    totals = df.groupBy(*keys, part).agg(f(column).alias("_total"))
    before = totals.select(*keys, part, f("_total").over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    here = f(column).over(inside)
    both = F.greatest(here, F.col("_carried")) if how == "max" else F.coalesce(here, F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return df.join(before, [*keys, part]).withColumn(name, both).drop("_carried")


def top_per_group(df: DataFrame, group: Sequence[str], k: int, order: Sequence[Column], spread: str, name: str = "rank", parts: int = 64, dealt: bool = False) -> DataFrame:
    """The first k rows of each group with their rank, from the first k of each of the parts that a hash of the column `spread` deals it into. dealt: sorts run over as many tasks as the session shuffles into, not over whole files and joined partitions; for groups as many as rows."""
    deal = staging.spread if dealt else lambda d, *_: d
    some = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)))
    some = deal(some, *group, "_part").withColumn(name, F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))).filter(F.col(name) <= k).drop("_part")
    return deal(some, *group).withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).filter(F.col(name) <= k)

"""Joins and folds on time intervals (microseconds as long)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import running


#: How much wider buckets of the next level are.
FAN = 16


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: int, how: str = "inner") -> DataFrame:
    """Rows of left (start, end) and right (r_start, r_end) with equal keys whose intervals share time, and `overlap`.

    Both sides are cut into buckets of time, so the join is on equality and a busy key spreads over its buckets; a pair
    that meets in several buckets is kept in the first. An interval is cut at the level of its length: buckets grow by FAN
    from level to level, so that none is in more than FAN + 1 of them, a year's no more than a minute's; each side is also
    written at all coarser levels that the other side has, in the few buckets that it touches there.

    how is inner or left: left rows that meet none stay once, with nulls, as do those with a null key, start or end.
    """
    level = lambda a, z: F.coalesce(F.greatest(F.lit(0), F.ceil(F.log(float(FAN), F.greatest(F.col(z) - F.col(a), F.lit(1)) / bucket) - 1)), F.lit(0)).cast("int")
    width = lambda k: F.lit(bucket) * F.pow(F.lit(FAN), k).cast("long")
    there = {r[0] for df, a, z in ((left, "start", "end"), (right, "r_start", "r_end")) for r in df.select(level(a, z)).distinct().collect()}  # a dozen at most
    levels = F.array(*[F.lit(k) for k in sorted(there | {0})])
    cell = lambda c, k: F.floor(F.col(c) / width(k))

    def cells(own: str, a: str, z: str) -> Column:
        some = F.filter(levels, lambda k: k >= F.col(own))
        return F.flatten(F.transform(some, lambda k: F.transform(F.sequence(F.floor(F.col(a) / width(k)), F.floor(F.greatest(F.col(z) - 1, F.col(a)) / width(k))), lambda c: F.struct(k.alias("k"), c.alias("c")))))

    on = left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_level", level("start", "end")).withColumn("_cell", F.explode_outer(cells("_level", "start", "end")))
    r = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns], F.lit(True).alias("_met")).withColumn("_r_level", level("r_start", "r_end")).withColumn("_r_cell", F.explode(cells("_r_level", "r_start", "r_end")))
    k = F.col("_cell.k")
    same = (F.col("_cell") == F.col("_r_cell")) & (k == F.greatest("_level", "_r_level")) & (F.col("_cell.c") == F.greatest(cell("start", k), cell("r_start", k)))
    for c in keys:
        same &= F.col(c) == F.col(f"_r_{c}")
    on = on.join(r, same & (F.col("r_end") > F.col("start")) & (F.col("r_start") < F.col("end")), how)
    if how == "left":
        one = W.partitionBy("_id")
        on = on.withColumn("_any", F.max("_met").over(one)).withColumn("_nth", F.row_number().over(one.orderBy("_cell")))
        on = on.filter(F.col("_met") | (F.col("_any").isNull() & (F.col("_nth") == 1))).drop("_any", "_nth")
    return on.withColumn("overlap", F.least("end", "r_end") - F.greatest("start", "r_start") if how == "inner" else F.when(F.col("_met"), F.least("end", "r_end") - F.greatest("start", "r_start"))).drop("_id", "_cell", "_r_cell", "_level", "_r_level", "_met", *[f"_r_{c}" for c in keys])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: int, tie: str) -> DataFrame:
    """Each left row (at) with the right row (r_at) nearest in time within the tolerance; the earlier, then smaller tie, wins. Left rows without one stay, with nulls, as do those with a null key or time. Rows meet by buckets of the tolerance's length."""
    cells = F.sequence(F.floor((F.col("at") - tolerance) / tolerance), F.floor((F.col("at") + tolerance) / tolerance))
    l = left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_cell", F.explode_outer(cells))
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "r_at", F.col(tie).alias("_tie"), F.floor(F.col("r_at") / tolerance).alias("_r_cell"))
    same, gap = F.col("_cell") == F.col("_r_cell"), F.abs(F.col("at") - F.col("r_at"))
    for k in keys:
        same &= F.col(k) == F.col(f"_r_{k}")
    met = l.join(r, same & (gap <= tolerance), "left")
    best = F.min(F.when(F.col("r_at").isNotNull(), F.struct(gap.alias("gap"), "r_at", "_tie"))).alias("_b")
    out = met.groupBy("_id").agg(F.first(F.struct(*left.columns)).alias("_l"), best)
    return out.select("_l.*", F.col("_b.r_at").alias("r_at"), F.col("_b._tie").alias(tie), F.col("_b.gap").alias("gap"))


def coalesced(df: DataFrame, keys: Sequence[str], gap: int, part: int = 86_400_000_000) -> DataFrame:
    """Islands of intervals (start, end): those that begin at most gap after the furthest end so far are one. Columns keys, start, end, n. part: length of time whose rows of a key are ordered together."""
    order = ["start", "end"]
    seen = running(df.withColumn("_part", F.floor(F.col("start") / part)), keys, "_part", order, "_reach", "end", own=False)
    seen = seen.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), 1).otherwise(0))
    island = running(seen, keys, "_part", order, "_island", "_new", "sum")
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def split(df: DataFrame, longest: int) -> DataFrame:
    """Intervals cut into the least number of equal parts of at most `longest`; part counts from 0."""
    parts = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / longest))
    cut = df.withColumn("_parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    size = (F.col("end") - F.col("start")) / F.col("_parts")
    return cut.select(*[c for c in df.columns if c not in ("start", "end")], "part", (F.col("start") + F.floor(F.col("part") * size)).alias("start"), (F.col("start") + F.floor((F.col("part") + 1) * size)).alias("end"))


def folded(df: DataFrame, key: str, at: str, step: Callable, last: Callable, columns: str) -> DataFrame:
    """key and columns (of bigint): a fold over all points of a key in order of `at` that gives rows on its way. Partitions hold whole keys, sorted; the state goes on from batch to batch, so memory doesn't grow with a key, but its time does. step(state, point) gives the next state and a row or None, from state None on; last(state) a row or None."""
    names = [key, *columns.split()]

    def rows(batches):
        now, state, kind = None, None, None
        for b in batches:
            kind = kind or b.schema.field(0).type
            out = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is not None and k != now:
                    out += [(now, *r)] if (r := last(state)) else []
                    state = None
                now = k
                state, r = step(state, x)
                out += [(now, *r)] if r else []
            yield table(out, kind)
        if state is not None and (r := last(state)):
            yield table([(now, *r)], kind)

    def table(out, kind):
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate([kind, *[pa.int64()] * (len(names) - 1)])], names=names)

    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *[f"`{c}` bigint" for c in names[1:]]])
    return df.select(key, at).repartition(key).sortWithinPartitions(key, at).mapInArrow(rows, schema)


def carried(df: DataFrame, key: str, at: str, first: Callable, step: Callable, result: Callable, columns: str) -> DataFrame:
    """A fold with one row a key, see folded: first(point) and step(state, point) give a state, result(state) a row, or None for no row."""
    return folded(df, key, at, lambda s, x: (first(x) if s is None else step(s, x), None), result, columns)

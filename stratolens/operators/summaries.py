"""Greedy choice of distinct texts under a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import ordered
from .staging import stored

#: Candidates of a group in a round; as many of all groups are broadcast; parts of a group's rows in a join.
ROUND, FEW, PARTS = 256, 100_000, 64


def comparable(text: Column) -> Column:
    """Lower-case letters and digits of a text, with one space between runs of them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def distinct_texts(df: DataFrame, group: str, key: str, size: str, text: str, budget: int) -> DataFrame:
    """group, kept (array of i, n, h), total. Of a group's texts, the longest first, then by key, each that neither contains nor is contained in one already picked (as comparable text) and still fits; the first always does.

    Copies of one length get one decision, so one stays of them. Candidates come in rounds of ROUND by rank: those that no
    longer fit never will, so a round takes only what fits, and the rounds end when no group has any left.
    """
    h = comparable(F.col(text))
    slim = df.select(group, F.col(key).alias("i"), F.col(size).cast("long").alias("n"), F.when(h == "", F.concat(F.lit("#"), F.col(key).cast("string"))).otherwise(F.md5(h)).alias("_h"))
    slim = stored(slim.groupBy(group, "_h", "n").agg(F.min("i").alias("i")).drop("_h"))
    order = [F.col("n").desc(), F.col("i")]
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, y: s + y["n"])
    meets = lambda x, y: (x["h"] != "") & (y["h"] != "") & (F.contains(x["h"], y["h"]) | F.contains(y["h"], x["h"]))
    step = lambda a, x: F.when((F.size(a) > 0) & ((total(a) + x["n"] > budget) | F.exists(a, lambda y: meets(x, y))), a).otherwise(F.concat(a, F.array(x)))
    pick = lambda c: F.transform(c, lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), x["h"].alias("h")))
    state = None
    while True:
        todo = slim
        if state is not None:
            at = state.filter(F.col("total") < budget).select(group, "total", "at_n", "at_i")
            at = at.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
            todo = slim.withColumn("_salt", F.pmod(F.xxhash64("i"), F.lit(PARTS)).cast("int")).join(at, [group, "_salt"]).filter((F.col("n") <= budget - F.col("total")) & ((F.col("n") < F.col("at_n")) | ((F.col("n") == F.col("at_n")) & (F.col("i") > F.col("at_i")))))
        best = ordered.top_per_group(todo.select(group, "n", "i"), [group], 1 if state is None else ROUND, order, "i", "_r").select("_r", F.col("i").alias(key))
        best = stored(best)  # so the texts need no shuffle
        s = df.join(F.broadcast(best) if best.count() <= FEW else best, key).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(key).alias("i"), F.col(size).cast("long").alias("n"), h.alias("h")))).alias("_s"))
        s = s.withColumn("at_n", F.element_at("_s", -1)["n"]).withColumn("at_i", F.element_at("_s", -1)["i"]).withColumn("_s", pick("_s"))
        if state is None:
            now = s.withColumn("kept", F.col("_s"))
        else:
            s = s.select(group, F.col("_s"), F.col("at_n").alias("_n"), F.col("at_i").alias("_i"))
            now = state.join(s, group, "left").select(
                group, F.when(F.col("_s").isNull(), F.col("kept")).otherwise(F.aggregate("_s", F.col("kept"), step)).alias("kept"),
                F.coalesce("_n", F.lit(-1)).alias("at_n"), F.coalesce("_i", "at_i").alias("at_i"),
            )
        state = stored(now.select(group, "kept", "at_n", "at_i", total(F.col("kept")).alias("total")))
        if not state.filter((F.col("total") < budget) & (F.col("at_n") >= 0)).limit(1).count():
            return state.select(group, "kept", "total")

"""Records of one thing from several providers: groups by shared keys, and the best value of each field with its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .staging import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def linked(records: DataFrame) -> DataFrame:
    """records (id, keys: array) -> id, group of those ids that share a key with another; see groups.

    Keys of one id link nothing and go first; the others are joined by their hash and themselves, as a number sorts faster. Each id then stands with the smallest first id of its keys, and only ids whose
    keys have several first ids link those: the rounds hold these links, not an edge a record. Large-star and small-star steps
    turn each component of links into a star around its smallest id, each written to the shared folder.
    """
    held = records.filter("id is not null").select("id", F.explode("keys").alias("k")).filter("k is not null")
    shared = stored(held.groupBy("k").agg(F.min("id").alias("b"), F.max("id").alias("_z")).filter("b < _z").select("k", "b"))
    hashed = lambda df: df.withColumn("h", F.xxhash64("k"))
    own = W.partitionBy("id").orderBy("b")
    firsts = hashed(held).join(hashed(shared), ["h", "k"]).select("id", "b", F.first("b").over(own).alias("m"), F.row_number().over(own).alias("nth"))
    firsts = stored(firsts.filter("nth = 1 or b != m"))
    edges = stored(firsts.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    now = _state(edges)
    while now[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(both.join(least, F.col("a") == F.col("u")).filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        edges = stored(small.select("a", F.col("m").alias("b")).union(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        then = _state(edges)
        if then == now:
            break
        now = then
    return firsts.filter("nth = 1").select("id", "m").join(edges, F.col("m") == F.col("a"), "left").select("id", F.coalesce("b", "m").alias("group"))


def groups(records: DataFrame) -> DataFrame:
    """records (id, keys: array) -> id, group: the smallest id among all records that are linked by shared keys, directly or through others. Null keys link nothing; records without keys are groups of their own. Null ids are left out."""
    ids = records.filter("id is not null").select("id").distinct()
    return ids.join(linked(records), "id", "left").select("id", F.coalesce("group", "id").alias("group"))


def survivors(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """records (group, id, provider, fields) -> group, records, providers, primary_provider, and each field with <field>_from (struct of provider and id).

    A field takes the non-null value of the record with the most non-null fields; ties go by provider, id, then value. Each field is
    chosen by itself, so one row may bring values of many; the primary provider is that of the fullest record. Everything is
    a minimum of structs, so a group of a third of all records is a row a task before the shuffle. Null providers come first.
    """
    full = -sum((F.when(F.col(f).isNull(), 0).otherwise(1) for f in fields), F.lit(0))
    best = [F.min(F.when(F.col(f).isNotNull(), F.struct(full.alias("full"), "provider", "id", F.col(f).alias("value")))).alias(f) for f in fields]
    out = records.groupBy("group").agg(F.count("*").alias("records"), F.count_distinct("provider").alias("providers"), F.min(F.struct(full.alias("full"), "provider", "id"))["provider"].alias("primary_provider"), *best)
    each = [c for f in fields for c in (F.col(f"{f}.value").alias(f), F.when(F.col(f).isNotNull(), F.struct(f"{f}.provider", f"{f}.id")).alias(f"{f}_from"))]
    return out.select("group", "records", "providers", "primary_provider", *each)

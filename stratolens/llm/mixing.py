"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions alone.

Every source gets its weight's share of all words, at most max_repeat times its own words; what a capped source leaves
goes to the others by weight. The words of the mix are equal blocks: the source with the highest quotient
weight / (2 k - 1) gets the next block. A source's documents are dealt into shards by a seeded hash (a hot source has
many), its blocks go to teams of FAN shards and then to the shards by the same rule with their words as weights, and every
shard takes whole rounds of its blocks and a run of blocks, in seeded document order, from a seeded start. So all but two documents of a shard are
taken whole, and reruns agree.

The highest quotients are found without listing every block: a count differs from its exact quota by less than
1 + n w / 2W (n parties, weight w of W), and only seats in that range are ranked.

Sources meet in one window, a row each, so they are taken to be at most some millions; everything else is dealt to shards.
Null and empty texts have size 0 and are never taken. Null is a source of its own, the last. Repeated rows count each. A very
long text is in one shard, which grows by it. Equal quotients go to the source of smaller rank, the smaller team and shard.
Other columns are left out, so names can't clash. Empty tables give an empty result. Sources of no words have target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import n_words, stored

#: Words in a block and, nearly, in a shard; shards that share a source's blocks among them at once.
BLOCK, SHARD_WORDS, FAN = 32, 32_768, 4096


def _seeded(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def _number(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, 1, 8), 16, 10).cast("long")


def _apportion(parties: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """parties (id columns, weight w, all_w, n, seats, most) with quota: of seats, the highest quotients w / (2 k - 1) in each group of by; at most `most` each."""
    share = F.col("seats") * F.col("w") / F.col("all_w")
    reach = 1 + F.col("n") * F.col("w") / (2 * F.col("all_w"))
    p = parties.withColumn("lo", F.least(F.greatest(F.floor(share - reach) - 1, F.lit(0)), F.col("most"))).withColumn("hi", F.least(F.ceil(share + reach) + 1, F.col("most")))
    group = W.partitionBy(*by)
    p = p.withColumn("rest", F.col("seats") - F.sum("lo").over(group))
    k = p.withColumn("k", F.explode_outer(F.when(F.col("hi") > F.col("lo"), F.sequence(F.col("lo") + 1, F.col("hi")))))
    k = k.withColumn("quotient", F.col("w") / (2 * F.col("k") - 1))
    k = k.withColumn("place", F.row_number().over(group.orderBy(F.col("quotient").desc_nulls_last(), order)))
    won = F.sum(F.when(F.col("k").isNotNull() & (F.col("place") <= F.col("rest")), 1).otherwise(0))
    return k.groupBy(*dict.fromkeys([*by, order])).agg((F.max("lo") + won).alias("quota"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, block: int = BLOCK, shard_words: int = SHARD_WORDS, fan: int = FAN, seed: int = 0) -> DataFrame:
    """doc_id, digest (xxhash64 of the text, for joins), source, size, source_size, target, taken of every row. weights go to the sources in order of their names, repeating."""
    # Identifier and text, so that rows without an identifier or with the same one are spread over the shards too.
    key = _seeded(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text_col)), F.lit("null"))), seed)
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key")), "mix-sizes")
    one = W.partitionBy("one")
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    s = s.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", max_repeat * F.col("source_size"))
    filling = one.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(one))
    s = s.withColumn("open_words", F.col("total") - F.coalesce(F.sum("cap").over(filling), F.lit(0)))
    s = s.withColumn("open_w", F.sum("w").over(one) - F.coalesce(F.sum("w").over(filling), F.lit(0)))
    s = s.withColumn("capped", F.col("cap") * F.col("open_w") <= F.col("w") * F.col("open_words"))
    s = s.withColumn("open_words", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(one))
    s = s.withColumn("all_w", F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0)).over(one))
    s = s.withColumn("n", F.sum(F.when(~F.col("capped"), 1).otherwise(0)).over(one))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("open_words")).cast("double") / F.col("all_w")))
    s = s.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    s = s.withColumn("seats", F.round(F.col("open_words") / block).cast("long")).withColumn("most", F.ceil(F.col("cap") / block).cast("long"))
    quota = _apportion(s.filter(~F.col("capped")), ["one"], "rank")
    s = stored(s.join(quota.select("rank", "quota"), "rank", "left").select("source", "source_size", "target", "capped", "n_shards", "quota"), "mix-sources")

    dealt = rows.join(s, rows["source"].eqNullSafe(s["source"])).drop(s["source"]).withColumn("shard", F.pmod(_number(F.col("key")), F.col("n_shards")))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("w"), *[F.first(c).alias(c) for c in ("source_size", "capped", "quota")])
    shards = shards.withColumn("blocks", F.ceil(F.col("w") / block)).withColumn("most", max_repeat * F.col("blocks"))
    shards = stored(shards.filter("w > 0"), "mix-shards")
    parts = shards.filter(~F.col("capped")).withColumn("team", F.floor(F.col("shard") / fan))
    team = W.partitionBy("source", "team")
    teams = parts.groupBy("source", "team").agg(F.sum("w").alias("w"), F.sum("most").alias("most"), *[F.first(c).alias(c) for c in ("source_size", "quota")])
    teams = teams.select("source", "team", "w", F.col("source_size").alias("all_w"), F.col("quota").alias("seats"), "most").withColumn("n", F.count("*").over(W.partitionBy("source")))
    seats = _apportion(teams, ["source"], "team").select(F.col("source").alias("s3"), F.col("team").alias("t3"), F.col("quota").alias("seats"))
    parts = parts.select("source", "team", "shard", "w", F.sum("w").over(team).alias("all_w"), "most", F.count("*").over(team).alias("n"))
    parts = parts.join(seats, F.col("source").eqNullSafe(F.col("s3")) & (F.col("team") == F.col("t3")))
    won = _apportion(parts, ["source", "team"], "shard").withColumnRenamed("quota", "won").withColumnRenamed("source", "s2").withColumnRenamed("shard", "h2")
    shards = shards.join(won, F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("h2")), "left")
    begin = F.pmod(_number(_seeded(F.concat_ws("/", F.coalesce("source", F.lit("")), "shard"), seed)), F.col("blocks"))
    shards = shards.select(F.col("source").alias("s1"), F.col("shard").alias("h1"), "blocks", F.coalesce(F.when(F.col("capped"), F.col("most")).otherwise(F.col("won")), F.lit(0)).alias("take"), begin.alias("begin"))
    place = W.partitionBy("source", "shard").orderBy("key", "doc_id", "size", "digest").rowsBetween(W.unboundedPreceding, 0)
    dealt = dealt.withColumn("end", F.sum("size").over(place)).withColumn("start", F.col("end") - F.col("size"))
    out = dealt.join(shards, F.col("source").eqNullSafe(F.col("s1")) & (F.col("shard") == F.col("h1")), "left")
    out = out.withColumn("rounds", F.floor(F.col("take") / F.col("blocks"))).withColumn("run", F.pmod(F.col("take"), F.col("blocks")))
    a, z, ring = F.col("begin") * block, (F.col("begin") + F.col("run")) * block, F.col("blocks") * block
    head = F.greatest(F.lit(0), F.least(F.col("end"), z) - F.greatest(F.col("start"), a))
    wrapped = F.greatest(F.lit(0), F.least(F.col("end"), z - ring) - F.col("start"))
    taken = F.coalesce(F.col("rounds") * F.col("size") + head + wrapped, F.lit(0)).cast("long")
    return out.select("doc_id", "digest", "source", "size", "source_size", "target", taken.alias("taken"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents, with weights 1, 2, 3 repeating. Edge cases: see the module."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
s1 AS (SELECT *, 1 + (rank - 1) % 3 AS w, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
f AS (SELECT 0 AS round, [0::BIGINT][1:0] AS capped UNION ALL
      SELECT round + 1, (SELECT list(rank) FROM s1 WHERE list_contains(f.capped, rank) OR cap * (SELECT sum(w) FROM s1 WHERE NOT list_contains(f.capped, rank)) <= w * (total - coalesce((SELECT sum(cap) FROM s1 WHERE list_contains(f.capped, rank)), 0)))
      FROM f WHERE round < 30),
k AS (SELECT coalesce(capped, []) AS capped FROM f ORDER BY round DESC LIMIT 1),
s2 AS (SELECT s1.*, list_contains(capped, rank) AS capped FROM s1, k),
s3 AS (SELECT *, CAST(total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT) AS open_words, CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS BIGINT) AS all_w FROM s2),
s4 AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * open_words AS DOUBLE) / all_w END AS target, greatest(1, CAST(ceil(source_size / 32768) AS BIGINT)) AS n_shards FROM s3),
q0 AS (SELECT rank, w / (2 * unnest(range(1, CAST(ceil(cap / 32) AS BIGINT) + 1)) - 1) AS quotient, CAST(round(open_words / 32) AS BIGINT) AS seats FROM s4 WHERE NOT capped),
q1 AS (SELECT rank, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, rank) AS place FROM q0) WHERE place <= seats GROUP BY rank),
s AS (SELECT s4.*, coalesce(quota, 0) AS quota FROM s4 LEFT JOIN q1 USING (rank)),
x AS (SELECT d.*, source_size, target, capped, rank, quota, CAST('0x' || substr(key, 1, 8) AS BIGINT) % n_shards AS shard FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source),
h AS (SELECT rank, shard, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS w, any_value(capped) AS capped, any_value(quota) AS quota, CAST(ceil(sum(size) / 32) AS BIGINT) AS blocks FROM x GROUP BY rank, shard HAVING sum(size) > 0),
v AS (SELECT rank, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY quotient DESC, shard) AS place FROM (SELECT rank, shard, quota, w / (2 * unnest(range(1, 3 * blocks + 1)) - 1) AS quotient FROM h WHERE NOT capped)) WHERE place <= quota GROUP BY rank, shard),
g AS (SELECT h.rank, h.shard, blocks, CASE WHEN capped THEN 3 * blocks ELSE coalesce(won, 0) END AS take, CAST('0x' || substr(md5('0:' || coalesce(source, '') || '/' || CAST(h.shard AS VARCHAR)), 1, 8) AS BIGINT) % blocks AS start_block FROM h LEFT JOIN v USING (rank, shard)),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY rank, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS z FROM x),
y AS (SELECT o.*, z - size AS a, blocks, take // blocks AS rounds, take % blocks AS run, start_block FROM o LEFT JOIN g USING (rank, shard))
SELECT doc_id, size, source_size, target, CAST(coalesce(rounds * size + greatest(0, least(z, (start_block + run) * 32) - greatest(a, start_block * 32)) + greatest(0, least(z, (start_block + run - blocks) * 32) - a), 0) AS BIGINT) AS taken FROM y
"""

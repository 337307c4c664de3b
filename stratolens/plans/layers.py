"""Windows joined with all layers of their asset, and metadata that survives from several providers."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from ..operators import sweep, survivors as S
from ..operators.intervals import micros
from .base import Tables, query

DAY, MINUTE = 86_400_000_000, 60_000_000
#: Layers by the kind of event that stands for them, and how many minutes a row lasts, in SQL.
LAYERS = {"speech": ("click", "1 + floor(value)"), "screen": ("signup", "10"), "shot": ("error", "120"), "vision": ("purchase", "30")}
_SPAN = "epoch_us(ts) AS s, epoch_us(ts) + CAST({0} AS BIGINT) * 60000000 AS z"
_LAYER = f"""SELECT e.event_id, count(l.event_id) AS n, coalesce(sum(least(e.z, l.z) - greatest(e.s, l.s)) FILTER (l.event_id IS NOT NULL), 0) AS overlap, arg_min(l.event_id, (l.s, l.event_id)) FILTER (l.event_id IS NOT NULL) AS first,
arg_min(l.event_id, (greatest(e.s, l.s) - least(e.z, l.z), l.s, l.event_id)) FILTER (l.event_id IS NOT NULL) AS best
FROM w e LEFT JOIN (SELECT event_id, user_id, {_SPAN} FROM events WHERE event_type = '{{1}}') l ON l.user_id = e.user_id AND l.s < e.z AND l.z > e.s GROUP BY e.event_id"""
_NAMED = ", ".join(f"CAST({k}.n AS BIGINT) AS {k}_n, CAST({k}.overlap AS BIGINT) AS {k}_overlap, {k}.first AS {k}_first, {k}.best AS {k}_best" for k in LAYERS)


@query(f"""WITH w AS (SELECT event_id, user_id, {_SPAN.format("60")} FROM events WHERE event_type = 'view'),
{", ".join(f"{k} AS ({_LAYER.format(minutes, kind)})" for k, (kind, minutes) in LAYERS.items())}
SELECT w.event_id, user_id, {_NAMED}, concat_ws(',', {", ".join(f"CASE WHEN {k}.n > 0 THEN '{k}' END" for k in LAYERS)}, 'metadata') AS sources FROM w {" ".join(f"JOIN {k} ON {k}.event_id = w.event_id" for k in LAYERS)}""")
def scene_layers(t: Tables):
    """Each hour-long window of a user with the speech, screen text, shots and vision that share time with it, in one sweep."""
    e = t.events.select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("start"))
    kind = lambda k, minutes: e.filter(F.col("event_type") == k).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "start", (F.col("start") + F.expr(minutes).cast("long") * MINUTE).alias("end"))
    out = sweep.layered(kind("view", "60"), {name: kind(*x) for name, x in LAYERS.items()}, DAY)
    sources = F.concat_ws(",", *[F.when(F.col(f"{k}_n") > 0, k) for k in LAYERS], F.lit("metadata"))
    return out.withColumn("sources", sources).drop("start", "end").withColumnsRenamed({"id": "event_id", "key": "user_id"})


FIELDS = {"title": "CASE WHEN l_discount < 0.05 THEN l_extendedprice END", "runtime": "CASE WHEN l_tax < 0.04 THEN l_quantity END", "studio": "CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END", "label": "CASE WHEN l_quantity > 40 THEN l_returnflag END"}
_FULL = " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in FIELDS)
_BEST = ", ".join(f"arg_min({x}, (-filled, provider, id, {f})) FILTER ({f} IS NOT NULL) AS {n}" for f in FIELDS for x, n in ((f, f), ("provider", f"{f}_provider"), ("id", f"{f}_id")))


@query(f"""WITH RECURSIVE r AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS o, l_partkey AS p, l_shipdate AS d, l_returnflag || l_linestatus AS provider, {", ".join(f"{x} AS {f}" for f, x in FIELDS.items())} FROM lineitem),
e AS (SELECT DISTINCT a.o AS x, b.o AS y FROM r a JOIN r b ON a.p = b.p AND a.d = b.d AND a.o <> b.o),
c AS (SELECT o, o AS label FROM (SELECT DISTINCT o FROM r) UNION SELECT e.y, c.label FROM c JOIN e ON e.x = c.o),
m AS (SELECT o, min(label) AS low FROM c GROUP BY o), g AS (SELECT low, min(id) AS grp FROM m JOIN r USING (o) GROUP BY low),
s AS (SELECT r.*, grp, {_FULL} AS filled FROM r JOIN m USING (o) JOIN g USING (low))
SELECT grp AS "group", count(*) AS records, count(DISTINCT provider) AS providers, arg_min(provider, (-filled, provider, id)) AS primary_provider, {_BEST} FROM s GROUP BY grp""")
def metadata_survivorship(t: Tables):
    """Records that share an order, or part and day, are one thing; each of its fields comes from the fullest record that has it."""
    key = lambda kind, *c: F.when(reduce(and_, [x.isNotNull() for x in c]), F.struct(F.lit(kind).alias("kind"), c[0].alias("a"), (c[1] if c[1:] else F.lit(0)).cast("long").alias("b")))
    keys = F.array(key("o", F.col("l_orderkey")), key("p", F.col("l_partkey"), micros(F.col("l_shipdate"))))
    rows = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.concat("l_returnflag", "l_linestatus").alias("provider"), keys.alias("keys"), *[F.expr(x).alias(f) for f, x in FIELDS.items()]).filter("id is not null")
    rows = rows.drop("keys").join(S.linked(rows.select("id", "keys")), "id", "left").withColumn("group", F.coalesce("group", "id"))
    out = S.survivors(rows, list(FIELDS))
    return out.select("group", "records", "providers", "primary_provider", *[c for f in FIELDS for c in (f, F.col(f"{f}_from.provider").alias(f"{f}_provider"), F.col(f"{f}_from.id").alias(f"{f}_id"))])

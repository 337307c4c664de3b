"""Roster and track identities. The tables have no matches: a user is an asset with ten customers as its roster, six days are a segment, and the events of a type in it are a track whose points are at the hours and minutes of its events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as D
from .base import Tables, query

SCOPE = ["user_id", "segment"]
#: Position groups by market segment.
GROUPS = {"AUTOMOBILE": "goalkeeper", "BUILDING": "defender", "FURNITURE": "midfielder", "HOUSEHOLD": "forward", "MACHINERY": "wide"}
TYPES = ["click", "error", "purchase", "signup", "view"]


def tracks(t: Tables):
    x, y = F.hour("ts") / 24, F.minute("ts") / 60
    third = lambda c, a, b, z: F.when(c < 1 / 3, a).when(c < 2 / 3, b).otherwise(z)
    p = t.events.select("event_id", "user_id", "event_type", "ts", ((F.dayofmonth("ts") - 1) / 6).cast("int").alias("segment"), x.alias("x"), y.alias("y"))
    p = p.withColumn("zone", third(F.col("x"), "defensive_third", "middle_third", "final_third")).withColumn("lane", third(F.col("y"), "far_side", "central", "near_side"))
    counts = [F.sum((F.col("zone") == z).cast("int")).alias(z) for z in ("defensive_third", "middle_third", "final_third")] + [F.sum((F.col("lane") == z).cast("int")).alias(z) for z in ("far_side", "central", "near_side")]
    at = F.struct("ts", "event_id", "x")
    g = p.groupBy(*SCOPE, F.col("event_type").alias("track")).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.min(at).alias("a"), F.max(at).alias("z"), *counts)
    g = g.withColumn("zone", third(F.round(F.col("sx") / F.col("n"), 9), "defensive_third", "middle_third", "final_third")).withColumn("lane", third(F.round(F.col("sy") / F.col("n"), 9), "far_side", "central", "near_side"))
    pick = lambda c, names: F.coalesce(*[F.when(F.col(c) == k, F.col(k)) for k in names])
    g = g.withColumn("displacement", F.round(F.abs(F.col("z.x") - F.col("a.x")), 6)).withColumn("speed", F.round(F.abs(F.col("z.x") - F.col("a.x")) / F.greatest(F.lit(1), F.col("n") - 1), 6))
    even = F.col("user_id") % 2 == 0
    return g.select(*SCOPE, "track", (F.col("segment") * 6).alias("start"), (F.col("segment") * 6 + 6).alias("end"), "zone", "lane", "n", pick("zone", ("defensive_third", "middle_third", "final_third")).alias("in_zone"), pick("lane", ("far_side", "central", "near_side")).alias("in_lane"), "speed", "displacement", (F.col("n") >= 3).alias("clock"), F.when(even, 5500).otherwise(4000).alias("context"), even.alias("confirmed"))


def roster(t: Tables):
    group = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[F.col("c_mktsegment")]
    first = F.col("c_custkey") * 7 % 30
    return t.customer.select((F.col("c_custkey") / 10).cast("long").alias("user_id"), F.col("c_custkey").alias("player"), group.alias("group"), (F.col("c_nationkey") % 2 == 1).alias("flipped"), first.alias("valid_from"), F.when(F.col("c_custkey") % 4 != 0, first + 12).alias("valid_to"))


def faces(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("user_id", ((F.dayofmonth("ts") - 1) / 6).cast("int").alias("segment"), F.col("event_type").alias("track"), (F.col("user_id") * 10 + k % 10).alias("player"), F.least(F.lit(98), F.floor(F.col("value") * 2)).cast("int").alias("face"))


def found(t: Tables):
    return D.candidates(tracks(t), roster(t), faces(t), SCOPE, "track", "player")


def edits(t: Tables):
    """Orders as a review log: of a customer's track in a segment; open ones reject."""
    kinds = F.array(*[F.lit(x) for x in TYPES])
    return t.orders.select(F.col("o_orderkey").alias("edit"), (F.col("o_custkey") / 10).cast("long").alias("user_id"), (F.col("o_orderkey") % 5).cast("int").alias("segment"), F.get(kinds, ((F.col("o_orderkey") / 5).cast("long") % 5).cast("int")).alias("track"), F.col("o_custkey").alias("player"), F.when(F.col("o_orderstatus") == "O", "rejected").otherwise("confirmed").alias("decision"), F.col("o_orderpriority").alias("reviewer"))


SQL_FOUND = f"""(WITH p AS (SELECT *, (day(ts) - 1) // 6 AS segment, hour(ts) / 24 AS x, minute(ts) / 60 AS y FROM events),
q AS (SELECT *, CASE WHEN x < 1/3 THEN 0 WHEN x < 2/3 THEN 1 ELSE 2 END AS zx, CASE WHEN y < 1/3 THEN 0 WHEN y < 2/3 THEN 1 ELSE 2 END AS zy FROM p),
g AS (SELECT user_id, segment, event_type AS track, count(*) AS n, round(sum(x) / count(*), 9) AS mx, round(sum(y) / count(*), 9) AS my, abs(arg_max(x, (ts, event_id)) - arg_min(x, (ts, event_id))) AS d, [sum((zx = 0)::INT), sum((zx = 1)::INT), sum((zx = 2)::INT)] AS zs, [sum((zy = 0)::INT), sum((zy = 1)::INT), sum((zy = 2)::INT)] AS ls FROM q GROUP BY ALL),
k AS (SELECT *, CASE WHEN mx < 1/3 THEN 0 WHEN mx < 2/3 THEN 1 ELSE 2 END AS zone, CASE WHEN my < 1/3 THEN 0 WHEN my < 2/3 THEN 1 ELSE 2 END AS lane, round(d, 6) AS displacement, round(d / greatest(1, n - 1), 6) AS speed, n >= 3 AS clock, user_id % 2 = 0 AS even FROM g),
r AS (SELECT c_custkey // 10 AS user_id, c_custkey AS player, c_mktsegment AS s, c_nationkey % 2 = 1 AS flipped, c_custkey * 7 % 30 AS a, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 7 % 30 + 12 END AS z FROM customer),
f AS (SELECT user_id, segment, event_type AS track, user_id * 10 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS player, max(least(98, floor(value * 2))) AS face FROM p GROUP BY ALL),
m AS (SELECT k.*, r.player, s, CASE WHEN flipped THEN 2 - zone ELSE zone END AS tz, zs[zone + 1] AS iz, ls[lane + 1] AS il, CAST(greatest(0, coalesce(face, 0)) AS INT) AS face FROM k JOIN r ON r.user_id = k.user_id AND segment * 6 < coalesce(z, 1000) AND segment * 6 + 6 > a LEFT JOIN f ON f.user_id = k.user_id AND f.segment = k.segment AND f.track = k.track AND f.player = r.player),
b AS (SELECT *, CASE s WHEN 'AUTOMOBILE' THEN CASE WHEN tz <> 1 AND 100 * iz >= 45 * n AND speed <= 0.06 AND displacement <= 0.12 THEN 1400 ELSE 0 END
  WHEN 'BUILDING' THEN CASE tz WHEN 0 THEN 1200 WHEN 1 THEN 700 ELSE 0 END + CASE WHEN speed <= 0.08 THEN 200 ELSE 0 END
  WHEN 'FURNITURE' THEN CASE tz WHEN 1 THEN 1200 ELSE 0 END + CASE WHEN lane = 1 AND 100 * il >= 45 * n THEN 300 ELSE 0 END
  WHEN 'HOUSEHOLD' THEN CASE tz WHEN 2 THEN 1200 WHEN 1 THEN 600 ELSE 0 END
  ELSE CASE WHEN lane <> 1 THEN 1100 ELSE 0 END + CASE WHEN tz <> 0 THEN 400 ELSE 0 END END AS base FROM m),
w AS (SELECT *, least(4200, CASE WHEN n >= 2 AND base > 0 THEN least(2200, base + CASE WHEN 100 * iz >= 55 * n THEN 300 ELSE 0 END) ELSE 0 END + CASE WHEN face >= 62 THEN least(2400, (face * 24 + 5) // 10 * 10) ELSE 0 END) AS score FROM b),
h AS (SELECT * FROM w WHERE score >= 1400 OR face >= 62 QUALIFY row_number() OVER (PARTITION BY user_id, segment, track ORDER BY score DESC, face DESC, player) <= 3)
SELECT user_id, CAST(segment AS INT) AS segment, track, player, CAST(score AS INT) AS score, face, CAST(least(9100, CASE WHEN even THEN 5500 ELSE 4000 END + 1000 + least(1800, score) + CASE WHEN face >= 62 THEN face * 18 ELSE 0 END + CASE WHEN clock THEN 400 ELSE 0 END) AS INT) AS confidence, CASE WHEN face >= 88 AND even AND clock THEN 'confirmed' ELSE 'candidate' END AS status FROM h)"""
#: The greedy choice of each scope as a fold over its sorted pairs.
SQL_GREEDY = """(SELECT user_id, segment, unnest(p.x).l AS track, unnest(p.x).r AS player FROM (SELECT user_id, segment,
list_reduce(list({{'x': [{{'l': track, 'r': player}}]}} ORDER BY confidence DESC, track, player), lambda a, x: CASE WHEN len(list_filter(a.x, lambda y: y.l = x.x[1].l OR y.r = x.x[1].r)) > 0 THEN a ELSE {{'x': list_concat(a.x, x.x)}} END) AS p FROM {0} GROUP BY user_id, segment))"""


@query(f"SELECT * FROM {SQL_FOUND}")
def roster_track_candidates(t: Tables):
    """The best three roster players of each track, by movement, zones and faces, while their windows last."""
    return found(t)


@query(f"SELECT f.* FROM {SQL_FOUND} f JOIN {SQL_GREEDY.format(SQL_FOUND)} g USING (user_id, segment, track, player)")
def roster_track_assignment(t: Tables):
    """Each track of a segment with at most one player, and back."""
    return D.one_to_one(found(t), SCOPE, "track", "player", "confidence")


SQL_EDITS = f"(SELECT o_orderkey AS edit, o_custkey // 10 AS user_id, CAST(o_orderkey % 5 AS INT) AS segment, {TYPES!r}[o_orderkey // 5 % 5 + 1] AS track, o_custkey AS player, CASE WHEN o_orderstatus = 'O' THEN 'rejected' ELSE 'confirmed' END AS decision, o_orderpriority AS reviewer FROM orders)"
SQL_REVIEWED = f"""(SELECT f.user_id, f.segment, f.track, f.player, score, face, CAST(CASE WHEN decision = 'rejected' THEN 0 WHEN was THEN 9800 WHEN e.edit IS NOT NULL THEN greatest(confidence, 9800) ELSE confidence END AS INT) AS confidence, coalesce(decision, status) AS status, e.edit AS last_edit, coalesce(n, 0) AS reviews, reviewer FROM {SQL_FOUND} f
LEFT JOIN (SELECT user_id, segment, track, player, max(edit) AS edit, arg_max(decision, edit) AS decision, arg_max(reviewer, edit) AS reviewer, bool_or(decision = 'rejected') AS was, count(*) AS n FROM {SQL_EDITS} GROUP BY ALL) e USING (user_id, segment, track, player))"""


@query(f"SELECT * FROM {SQL_REVIEWED}")
def identity_review(t: Tables):
    return D.reviewed(found(t), edits(t), [*SCOPE, "track", "player"])


@query(f"WITH w AS (SELECT * FROM {SQL_REVIEWED} WHERE status <> 'rejected') SELECT w.* FROM w JOIN {SQL_GREEDY.format('w')} g USING (user_id, segment, track, player)")
def reviewed_assignment(t: Tables):
    """Assignments after the review: rejected candidates don't come back, confirmed ones go first."""
    return D.one_to_one(identity_review(t).filter("status <> 'rejected'"), SCOPE, "track", "player", "confidence")


@query(f"""SELECT e.edit, CASE WHEN f.player IS NOT NULL THEN 'applied' WHEN s.user_id IS NOT NULL THEN 'no_candidate' ELSE 'no_segment' END AS outcome FROM {SQL_EDITS} e
LEFT JOIN (SELECT user_id, segment, track, player FROM {SQL_FOUND}) f USING (user_id, segment, track, player) LEFT JOIN (SELECT DISTINCT user_id, segment FROM {SQL_FOUND}) s ON s.user_id = e.user_id AND s.segment = e.segment""")
def identity_review_outcomes(t: Tables):
    return D.outcomes(found(t), edits(t), [*SCOPE, "track", "player"], SCOPE)

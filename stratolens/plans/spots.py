"""Spotted actions: cues aligned with recorded plays. The tables have no games: a user is a recording, a week of it a quarter; clicks and views are cues, purchases and signups the plays that a provider recorded, errors the windows' own events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spotting as S
from ..operators.intervals import micros
from .base import Tables, query

SCOPE = ["user_id", "week"]
HOUR = 3_600_000_000
#: Points a shared term; teams are asked only where the others find fewer than FEW plays.
INDEXES, FALLBACK, FEW, LEAST = {"players": 20, "words": 10}, {"teams": 5}, 2, 25


def _rows(t: Tables, prefix: str = ""):
    k = F.get_json_object("props", "$.k").cast("long")
    v = F.floor("value").cast("long")
    terms = {"players": F.array(F.concat(F.lit("p"), F.floor(k / 10))), "words": F.array(F.concat(F.lit("w"), v % 8), F.concat(F.lit("w"), k % 8)), "teams": F.array(F.concat(F.lit("t"), k % 2))}
    return t.events.select("user_id", F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("week"), "event_id", "event_type", "value", k.alias("k"), micros(F.col("ts")).alias("time"), *[c.alias(prefix + n) for n, c in terms.items()])


def cues(t: Tables):
    """Confidence in thousandths: by kind, and more where speech, a caption or screen text stand by it; the weak ones go."""
    base = F.when(F.col("event_type") == "click", 720).otherwise(640) + F.when(F.col("k") % 2 == 0, 40).otherwise(0) + F.when(F.col("value") >= 20, 60).otherwise(0) + F.when(F.col("k") % 3 == 0, 30).otherwise(0)
    c = _rows(t).filter("event_type in ('click', 'view')").withColumn("base", F.least(F.lit(900), base).cast("long")).filter("base >= 680")
    return c.withColumnsRenamed({"event_id": "cue", "event_type": "label", "time": "at"})


def plays(t: Tables):
    return _rows(t, "p_").filter("event_type in ('purchase', 'signup')").select(*SCOPE, F.col("event_id").alias("play"), F.col("time").alias("play_at"), F.col("event_type").alias("p_type"), "p_players", "p_words", "p_teams")


def found(t: Tables):
    same = F.when((F.col("label") == "click") == (F.col("p_type") == "purchase"), 25).otherwise(0)
    return S.candidates(cues(t), plays(t), SCOPE, INDEXES, FALLBACK, FEW, LEAST, same)


def predicted(t: Tables):
    return S.predictions(cues(t), S.aligned(found(t), SCOPE), SCOPE)


SQL_CUES = """(SELECT *, least(900, CASE WHEN event_type = 'click' THEN 720 ELSE 640 END + CASE WHEN k % 2 = 0 THEN 40 ELSE 0 END + CASE WHEN value >= 20 THEN 60 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 30 ELSE 0 END) AS base FROM r WHERE event_type IN ('click', 'view') AND base >= 680)"""
SQL_WITH = f"""r AS (SELECT *, CAST((day(ts) - 1) // 7 AS INT) AS week, epoch_us(ts) AS time, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events),
b AS (SELECT c.user_id, c.week, c.event_id AS cue, c.time AS "at", p.event_id AS play, p.time AS play_at, c.k // 10 = p.k // 10 AS players, len(list_intersect([c.v % 8, c.k % 8], [p.v % 8, p.k % 8])) AS words, c.k % 2 = p.k % 2 AS teams, (c.event_type = 'click') = (p.event_type = 'purchase') AS same
FROM {SQL_CUES} c JOIN r p ON p.user_id = c.user_id AND p.week = c.week AND p.event_type IN ('purchase', 'signup')),
f AS (SELECT user_id, week, cue, "at", play, play_at, players::INT * 20 + words * 10 + teams::INT * 5 + same::INT * 25 AS score, CASE WHEN players THEN 'players' WHEN words > 0 THEN 'words' ELSE 'teams' END AS found_by FROM b
QUALIFY players OR words > 0 OR (teams AND sum((players OR words > 0)::INT) OVER (PARTITION BY cue) < 2)),
s AS (SELECT * FROM f WHERE score >= 25)"""
#: The dearest chain as a fold over a scope's pairs: all chains so far by their end, each new pair after the best that it can follow.
SQL_CHAIN = """g AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, week ORDER BY "at", cue) AS c, dense_rank() OVER (PARTITION BY user_id, week ORDER BY play_at, play) AS p FROM s),
l AS (SELECT user_id, week, list_reduce(list({'x': [{'total': CAST(score AS BIGINT), 'p': -p, 'c': -c, 'chain': [{'cue': cue, 'play': play, 'score': CAST(score AS BIGINT)}]}]} ORDER BY c, p),
 lambda a, n: {'x': list_concat(a.x, [{'total': n.x[1].total + coalesce(list_max(list_filter(a.x, lambda y: y.c > n.x[1].c AND y.p > n.x[1].p)).total, 0), 'p': n.x[1].p, 'c': n.x[1].c,
  'chain': list_concat(coalesce(list_max(list_filter(a.x, lambda y: y.c > n.x[1].c AND y.p > n.x[1].p)).chain, []), n.x[1].chain)}])}) AS z FROM g GROUP BY user_id, week),
m AS (SELECT user_id, week, h.cue AS cue, h.play AS play, h.score AS score FROM (SELECT user_id, week, unnest(list_max(z.x).chain) AS h FROM l)),
d AS (SELECT c.user_id, c.week, c.event_id AS cue, c.event_type AS label, c.time AS "at", m.play, m.score, CAST(CASE WHEN m.play IS NULL THEN base ELSE least(960, base + least(960, 520 + m.score * 5) * 12 // 100) END AS BIGINT) AS confidence FROM """ + SQL_CUES + """ c LEFT JOIN m ON m.cue = c.event_id)"""


@query(f"WITH {SQL_WITH} SELECT * FROM s", score="BIGINT")
def action_play_candidates(t: Tables):
    """Plays of the same week that share players or words with a cue, or a team where those are few."""
    return found(t)


@query(f"WITH {SQL_WITH}, {SQL_CHAIN} SELECT * FROM d")
def action_spots(t: Tables):
    """Cues as predictions, those that can be aligned in order with the play that they stand for."""
    return predicted(t)


@query(f"""WITH {SQL_WITH}, {SQL_CHAIN}, w AS (SELECT event_id AS win, user_id, time AS a, time + 6 * 3600000000 AS z, k, value FROM r WHERE event_type = 'error'),
u AS (SELECT w.user_id, win, 'spot' AS kind, d.cue AS id, label, confidence FROM w JOIN d ON d.user_id = w.user_id AND d."at" >= a AND d."at" < z
UNION ALL SELECT user_id, win, 'event', win, 'error', 500 + k * 5 FROM w WHERE value >= 10)
SELECT user_id, win AS "window", CAST(row_number() OVER (PARTITION BY win ORDER BY confidence DESC, kind DESC, id) AS BIGINT) AS rank, kind, id, label, CAST(confidence AS BIGINT) AS confidence FROM u QUALIFY rank <= 5""")
def action_spot_events(t: Tables):
    """The first five events of each window of six hours: spotted actions in it and what it had itself, where that is trusted."""
    e = _rows(t).filter("event_type = 'error'").withColumn("window", F.col("event_id"))
    windows = e.select("user_id", "window", F.col("time").alias("start"), (F.col("time") + 6 * HOUR).alias("end"))
    own = e.filter("value >= 10").select("window", F.col("event_id").alias("id"), F.col("event_type").alias("label"), (500 + F.col("k") * 5).alias("confidence"))
    spots = predicted(t).select("user_id", "at", F.col("cue").alias("id"), "label", "confidence")
    return S.applied(windows, spots, own, ["user_id"], 6 * HOUR)

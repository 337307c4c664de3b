"""An import of a provider's files. The tables have none, so the queries first write them as a provider would: a region is a competition, a year its season, an order a match, its lines what happened in it; a third of the orders have no scores yet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import provider as P
from ..streaming.jobs import shared_dir
from .base import Tables, query

#: What is chosen; files of other competitions and years are never opened.
NAMES, SEASONS = ("america", "Asia ", "EUROPE", "Middle  East"), ("1996/97", "1997/98", "1998/99", "1999/00", "2000/01")
LAYOUT = {k: top + "/competition_id={competition_id}/season_id={season_id}" for k, top in (("matches", "matches"), ("lineups", "lines/kind=lineups"), ("events", "lines/kind=events"))}


def written(t: Tables) -> str:
    """The root of the provider's files: a list, and folders a season of matches, lineups and events (the latter two below `lines`)."""
    root = shared_dir(t.spark)
    year = F.year("o_orderdate")
    label = F.format_string("%d-%02d", F.col("season_id"), (F.col("season_id") + 1) % 100)
    cents = F.floor("o_totalprice").cast("long")
    team = lambda c, n: F.concat(F.lit("team "), c % n)
    score = lambda x: F.when(F.col("o_orderstatus") != "P", x.cast("int"))
    orders = t.orders.select((F.col("o_custkey") % 5).alias("competition_id"), year.cast("long").alias("season_id"), F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").cast("date").cast("string").alias("match_date"), team(F.col("o_custkey"), 40).alias("home_team"), F.when(F.col("o_orderkey") % 40 != F.col("o_custkey") % 40, team(F.col("o_orderkey"), 40)).alias("away_team"), score(cents % 5).alias("home_score"), score(F.floor(cents / 10) % 4).alias("away_score"))
    line = t.lineitem.join(orders.select("competition_id", "season_id", F.col("match_id").alias("l_orderkey")), "l_orderkey")
    type_ = F.when(F.col("l_returnflag") == "A", "Goal").when(F.col("l_returnflag") == "R", "Card").when(F.col("l_linenumber") % 2 == 0, "Substitution").otherwise("Pass")
    none = F.lit(None)
    event = F.struct(F.lit("events").alias("kind"), F.col("l_linenumber").cast("long").alias("event_id"), F.col("l_quantity").cast("int").alias("minute"), type_.alias("type"), none.cast("int").alias("shirt"))
    listed = F.struct(F.lit("lineups").alias("kind"), none.cast("long").alias("event_id"), none.cast("int").alias("minute"), none.cast("string").alias("type"), F.col("l_linenumber").cast("int").alias("shirt"))
    of = F.when(F.col("l_linenumber") % 2 == 0, F.array(event, listed)).otherwise(F.array(event))
    who = ["competition_id", "season_id", F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player_id"), F.concat(F.lit("player "), "l_suppkey").alias("player")]
    # Lineups and events in one pass: the lines meet their orders once. Nulls aren't written, so neither has the other's fields.
    line.select(*who, F.explode(of).alias("r")).select("competition_id", "season_id", "match_id", "player_id", "player", "r.*").write.partitionBy("kind", "competition_id", "season_id").json(f"{root}/lines")
    seasons = orders.groupBy("competition_id", "season_id").agg(F.max("match_date").alias("available"))
    regions = t.region.select(F.col("r_regionkey").cast("long").alias("competition_id"), F.col("r_name").alias("competition"))
    seasons.join(regions, "competition_id").withColumn("season", label).write.json(f"{root}/competitions.json")
    orders.write.partitionBy("competition_id", "season_id").json(f"{root}/matches")
    return root


def taken(t: Tables):
    return P.imported(t.spark, written(t), NAMES, SEASONS, LAYOUT, lines=True)


SQL_MATCHES = """m AS (SELECT r_name AS competition, year(o_orderdate) AS y, printf('%d-%02d', year(o_orderdate), (year(o_orderdate) + 1) % 100) AS season, o_orderkey AS match_id, o_custkey % 40 AS home, o_orderkey % 40 AS away, o_orderstatus <> 'P' AS done, CAST(floor(o_totalprice) AS BIGINT) % 5 AS hs, CAST(floor(o_totalprice) AS BIGINT) // 10 % 4 AS aw
FROM orders JOIN region ON r_regionkey = o_custkey % 5 WHERE r_name IN ('AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST') AND year(o_orderdate) BETWEEN 1996 AND 2000)"""


@query(f"""WITH {SQL_MATCHES}, s AS (SELECT competition, season, home AS team, hs AS own, aw AS other FROM m WHERE done AND home <> away UNION ALL SELECT competition, season, away, aw, hs FROM m WHERE done AND home <> away),
g AS (SELECT competition, season, 'team ' || team AS team, count(*) AS played, sum((own > other)::INT) AS wins, sum((own = other)::INT) AS draws, sum((own < other)::INT) AS losses, sum(own) AS goals_for, sum(other) AS goals_against FROM s GROUP BY ALL)
SELECT competition, season, team, metric, CAST(value AS BIGINT) AS value FROM (SELECT competition, season, team, unnest([{{'n': 'played', 'v': played}}, {{'n': 'wins', 'v': wins}}, {{'n': 'draws', 'v': draws}}, {{'n': 'losses', 'v': losses}}, {{'n': 'goals_for', 'v': goals_for}}, {{'n': 'goals_against', 'v': goals_against}}]) AS u FROM g), LATERAL (SELECT u.n AS metric, u.v AS value)""")
def provider_import_facts(t: Tables):
    """Facts of each team and season from the matches of the chosen seasons."""
    return taken(t)["facts"]


@query(f"""WITH {SQL_MATCHES}, k AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'Goal' WHEN 'R' THEN 'Card' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'Substitution' ELSE 'Pass' END END AS type FROM lineitem),
e AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_suppkey, type, CAST(l_quantity AS INT) AS minute, NULL::INT AS shirt FROM k ORDER BY l_orderkey, l_linenumber, l_suppkey, type, l_quantity),
a AS (SELECT * FROM e UNION ALL SELECT l_orderkey, l_suppkey, NULL, NULL, l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT competition, season, match_id, l_suppkey AS player_id, 'player ' || l_suppkey AS player, CAST(NULL AS VARCHAR) AS team, min(shirt) AS shirt, bool_or(shirt IS NOT NULL) AS listed,
count(*) FILTER (type = 'Goal') AS goals, count(*) FILTER (type = 'Card') AS cards, count(*) FILTER (type = 'Substitution') AS substitutions, CAST(0 AS BIGINT) AS assists, min(minute) AS first_minute, max(minute) AS last_minute
FROM m JOIN a ON l_orderkey = match_id GROUP BY competition, season, match_id, l_suppkey""")
def provider_import_activities(t: Tables):
    """What each player did in each match of the chosen seasons, from lineups and events."""
    return taken(t)["activities"]

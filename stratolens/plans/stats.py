"""Aggregates, knowledge merges and statistics; orders and line items stand for match facts."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import merging as M
from ..operators.staging import spread
from .base import Tables, query


@query("""SELECT (SELECT count(*) FROM documents) AS assets, (SELECT count(*) FROM documents WHERE lang = 'en') AS english, (SELECT sum(n_chars) FROM documents) AS duration,
(SELECT count(*) FROM conversations) AS segments, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) FROM embeddings) AS vectors""", duration="BIGINT")
def dashboard_metrics(t: Tables):
    one = [
        t.documents.agg(F.count("*").alias("assets"), F.count_if(F.col("lang") == "en").alias("english"), F.sum("n_chars").alias("duration")),
        t.conversations.agg(F.count("*").alias("segments")),
        t.events.agg(F.count_if(F.col("event_type") == "error").alias("errors")),
        t.embeddings.agg(F.count("*").alias("vectors")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(F.broadcast(x))  # one row each
    return out


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS high, count(DISTINCT event_type) AS kinds, max(event_id) AS last_id FROM events GROUP BY user_id")
def conditional_counts(t: Tables):
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("high"), F.count_distinct("event_type").alias("kinds"), F.max("event_id").alias("last_id")
    )


@query("""SELECT c_mktsegment AS domain, c_nationkey AS provider, CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS kind, count(*) AS n, CAST(grouping(domain, provider, kind) AS BIGINT) AS level
FROM customer GROUP BY GROUPING SETS ((), (domain), (provider), (kind), (domain, provider), (domain, kind))""")
def status_grouping_sets(t: Tables):
    rows = t.customer.select(F.col("c_mktsegment").alias("domain"), F.col("c_nationkey").alias("provider"), F.when(F.col("c_acctbal") < 0, "debit").otherwise("credit").alias("kind"))
    sets = [[], ["domain"], ["provider"], ["kind"], ["domain", "provider"], ["domain", "kind"]]
    return rows.groupingSets([[F.col(c) for c in x] for x in sets], "domain", "provider", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT p_brand AS team, p_size % 5 AS position, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size % 5) HAVING p_brand IS NOT NULL")
def roster_rollup(t: Tables):
    p = t.part.select(F.col("p_brand").alias("team"), (F.col("p_size") % 5).alias("position"))
    return p.rollup("team", "position").agg(F.count("*").alias("n")).filter("team is not null")


SQL_MATCHES = """(SELECT l_orderkey, year(o_orderdate) AS season, c_nationkey AS home, s_nationkey AS away, CAST(l_quantity AS INT) % 5 AS hg, l_linenumber % 4 AS ag FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"""
SQL_TABLE = f"""(SELECT season, team, count(*) AS played, count(*) FILTER (gf > ga) AS won, count(*) FILTER (gf = ga) AS drawn, count(*) FILTER (gf < ga) AS lost, sum(gf) AS gf, sum(ga) AS ga,
3 * count(*) FILTER (gf > ga) + count(*) FILTER (gf = ga) AS points, sum(gf) - sum(ga) AS diff FROM (SELECT season, home AS team, hg AS gf, ag AS ga FROM {SQL_MATCHES} UNION ALL SELECT season, away, ag, hg FROM {SQL_MATCHES}) GROUP BY season, team)"""


def league(t: Tables):
    """Each match gives a row for either side, by explode, so the joins are done once."""
    o = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"))
    m = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    m = m.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    m = m.filter("c_nationkey <> s_nationkey").withColumn("hg", F.col("l_quantity").cast("int") % 5).withColumn("ag", F.col("l_linenumber") % 4)
    side = lambda team, f, a: F.struct(F.col(team).alias("team"), F.col(f).alias("gf"), F.col(a).alias("ga"))
    rows = m.select("season", F.explode(F.array(side("c_nationkey", "hg", "ag"), side("s_nationkey", "ag", "hg"))).alias("r")).select("season", "r.*")
    won, drawn, lost = (F.count_if(c) for c in (F.col("gf") > F.col("ga"), F.col("gf") == F.col("ga"), F.col("gf") < F.col("ga")))
    return rows.groupBy("season", "team").agg(
        F.count("*").alias("played"), won.alias("won"), drawn.alias("drawn"), lost.alias("lost"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), (3 * won + drawn).alias("points"), (F.sum("gf") - F.sum("ga")).alias("diff")
    )


@query(f"SELECT *, row_number() OVER (PARTITION BY season ORDER BY points DESC, diff DESC, gf DESC, team) AS place FROM {SQL_TABLE}", season="INTEGER", gf="BIGINT", ga="BIGINT", diff="BIGINT")
def league_table(t: Tables):
    w = W.partitionBy("season").orderBy(F.col("points").desc(), F.col("diff").desc(), F.col("gf").desc(), "team")
    return league(t).withColumn("place", F.row_number().over(w).cast("long"))


@query(f"SELECT season, team, metric, value FROM (SELECT season, team, played, won, drawn, lost, CAST(gf AS BIGINT) AS gf, CAST(ga AS BIGINT) AS ga, points, CAST(diff AS BIGINT) AS diff FROM {SQL_TABLE}) UNPIVOT (value FOR metric IN (played, won, drawn, lost, gf, ga, points, diff))", season="INTEGER")
def league_facts_unpivot(t: Tables):
    return M.unpivoted(league(t), ["season", "team"], ["played", "won", "drawn", "lost", "gf", "ga", "points", "diff"])


SQL_BEST = "(SELECT l_orderkey, l_partkey, l_quantity, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC, l_quantity DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1)"


def best_lines(t: Tables):
    l = t.lineitem.select("l_orderkey", "l_returnflag", "l_partkey", "l_quantity", "l_linenumber", "l_suppkey")
    return M.best_per_key(l, ["l_orderkey", "l_returnflag"], -F.col("l_linenumber"), -F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey")).drop("l_returnflag")


@query(f"SELECT * FROM {SQL_BEST}")
def best_row_per_key(t: Tables):
    return best_lines(t)


@query(f"SELECT o_custkey AS player, sum(l_quantity) AS total, max(l_linenumber) AS provider_rank, count(*) AS facts FROM {SQL_BEST} JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey ORDER BY total DESC, provider_rank DESC, player LIMIT 20")
def leaderboard(t: Tables):
    j = best_lines(t).join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy(F.col("o_custkey").alias("player")).agg(F.sum("l_quantity").alias("total"), F.max("l_linenumber").alias("provider_rank"), F.count("*").alias("facts"))
    return g.orderBy(F.col("total").desc(), F.col("provider_rank").desc(), "player").limit(20)


@query("""WITH s AS (SELECT o_custkey, sum(o_totalprice) AS stat FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), c AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS events FROM orders GROUP BY o_custkey)
SELECT c_custkey AS player, round(coalesce(stat, events, 0), 2) AS total, CASE WHEN stat IS NOT NULL THEN 'answered' WHEN events IS NOT NULL THEN 'fallback' ELSE 'missing' END AS status,
CASE WHEN stat IS NOT NULL THEN 0.88 WHEN events IS NOT NULL THEN 0.74 ELSE 0.28 END AS confidence FROM customer LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey""", confidence="DOUBLE")
def stat_player_total(t: Tables):
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("stat"), F.count_distinct("o_orderkey").alias("events"))
    j = t.customer.select(F.col("c_custkey").alias("player")).join(o, F.col("player") == F.col("k"), "left")
    has, some = F.col("stat").isNotNull(), F.col("events").isNotNull()
    return j.select(
        "player", F.round(F.coalesce("stat", "events", F.lit(0)), 2).alias("total"), F.when(has, "answered").when(some, "fallback").otherwise("missing").alias("status"), F.when(has, 0.88).when(some, 0.74).otherwise(0.28).alias("confidence")
    )


@query("SELECT o_custkey AS player, arg_max(o_totalprice, (year(o_orderdate), o_orderpriority, o_orderkey)) AS value, max(year(o_orderdate)) AS season FROM orders GROUP BY o_custkey")
def latest_metric(t: Tables):
    best = t.orders.groupBy(F.col("o_custkey").alias("player")).agg(F.max(F.struct(F.year("o_orderdate").alias("season"), "o_orderpriority", "o_orderkey", "o_totalprice")).alias("b"))
    return best.select("player", F.col("b.o_totalprice").alias("value"), F.col("b.season").cast("long").alias("season"))


@query("""WITH h AS (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS any_open FROM orders GROUP BY o_custkey) SELECT o_orderkey, orders.o_custkey AS player FROM orders JOIN h USING (o_custkey) WHERE o_orderstatus = 'O' OR NOT any_open""")
def prefer_roster_team(t: Tables):
    h = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("any_open"))
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").join(h, "o_custkey").filter("o_orderstatus = 'O' or not any_open").select("o_orderkey", F.col("o_custkey").alias("player"))


@query("""WITH u AS (SELECT 1 AS age, s_suppkey AS key, s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT 0, c_custkey, c_name, c_nationkey FROM customer)
SELECT key, arg_min(name, age) AS name, arg_min(nation, age) AS nation FROM u GROUP BY key""")
def merge_first_wins(t: Tables):
    s = t.supplier.select(F.lit(1).alias("age"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    c = t.customer.select(F.lit(0).alias("age"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return M.best_per_key(s.unionByName(c), ["key"], F.col("age")).select("key", "name", "nation")


@query("SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey")
def upsert_latest(t: Tables):
    b = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("b"))
    return b.select("id", F.col("b.o_orderkey").alias("last_order"), F.col("b.o_orderstatus").alias("status"))


@query("""SELECT c_nationkey AS player, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS aliases, count(DISTINCT c_custkey % 10) AS seasons, arg_min(c_name, c_custkey) AS position FROM customer GROUP BY c_nationkey""")
def merge_players_arrays(t: Tables):
    return t.customer.groupBy(F.col("c_nationkey").alias("player")).agg(
        F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("aliases"), F.count_distinct(F.col("c_custkey") % 10).alias("seasons"), F.min(F.struct("c_custkey", "c_name"))["c_name"].alias("position")
    )


@query("""WITH n AS (SELECT s_suppkey + 5 AS key, s_nationkey AS nation, 'new' AS origin FROM supplier WHERE s_nationkey < 10), e AS (SELECT s_suppkey AS key, s_nationkey AS nation, 'kept' AS origin FROM supplier WHERE s_nationkey >= 10)
SELECT * FROM n UNION ALL SELECT * FROM e WHERE key NOT IN (SELECT key FROM n)""")
def provider_replace_merge(t: Tables):
    old = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.lit("kept").alias("origin"))
    new = t.supplier.filter("s_nationkey < 10").select((F.col("s_suppkey") + 5).alias("key"), F.col("s_nationkey").alias("nation"), F.lit("new").alias("origin"))
    return M.replaced(old, new, F.col("nation") < 10, ["key"], F.col("nation"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def tombstone_anti(t: Tables):
    gone = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return M.without(t.orders.select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_by_names(t: Tables):
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM g))
SELECT 'customer' AS table_name, count(*) AS deleted FROM g UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT * FROM o)""")
def cascade_delete_counts(t: Tables):
    gone = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = t.orders.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = t.lineitem.select("l_orderkey").join(orders, "l_orderkey", "left_semi")
    n = lambda name, df: df.agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
    return n("customer", gone).union(n("orders", orders)).union(n("lineitem", lines))


@query("SELECT l_orderkey % 1000 AS key, min(l_orderkey) AS first_id, count(*) - 1 AS ignored FROM (SELECT DISTINCT l_orderkey FROM lineitem) GROUP BY 1")
def insert_if_absent(t: Tables):
    o = t.lineitem.select("l_orderkey").distinct()
    return o.groupBy((F.col("l_orderkey") % 1000).alias("key")).agg(F.min("l_orderkey").alias("first_id"), (F.count("*") - 1).alias("ignored"))


@query("""WITH r AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(flags, x))), ',') AS missing, len(list_intersect(flags, ['A', 'R'])) AS shared FROM r""")
def required_tags_difference(t: Tables):
    need = F.array(*[F.lit(x) for x in "ANR"])
    r = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return r.select("l_orderkey", F.array_join(F.array_except(need, "flags"), ",").alias("missing"), F.size(F.array_intersect("flags", F.array(F.lit("A"), F.lit("R")))).cast("long").alias("shared"))


@query("""WITH g AS (SELECT c_custkey AS id, 'a' AS origin FROM customer WHERE c_acctbal > 5000), v AS (SELECT c_custkey AS id, 'b' AS origin FROM customer WHERE c_nationkey < 8) SELECT id, min(origin) AS origin FROM (SELECT * FROM g UNION ALL SELECT * FROM v) GROUP BY id""")
def evidence_union(t: Tables):
    g = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.lit("a").alias("origin"))
    v = t.customer.filter("c_nationkey < 8").select(F.col("c_custkey").alias("id"), F.lit("b").alias("origin"))
    return g.unionByName(v).groupBy("id").agg(F.min("origin").alias("origin"))


@query("""SELECT o_orderkey AS match_id, count(*) AS activities, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey""")
def group_activities_by_match(t: Tables):
    o = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("match_id"))
    g = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("match_id")).groupBy("match_id").agg(F.count("*").alias("activities"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    return g.select("match_id", "activities", F.array_join(F.transform("p", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("""WITH v AS (SELECT l_suppkey AS track, l_partkey % 99 + 1 AS number, avg(l_discount) AS mean, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT *, mean + least(0.12, 0.04 * (n - 1)) AS score FROM v WHERE number NOT IN (6, 9) OR n >= 2)
SELECT * EXCLUDE (mean, score), round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, n DESC, number) AS place FROM s) WHERE place <= 3""")
def jersey_votes(t: Tables):
    """Discounts are averaged as decimals: sums of doubles differ in their last bit with the order they are added in, and equal scores would then be ranked by chance."""
    v = t.lineitem.groupBy(F.col("l_suppkey").alias("track"), (F.col("l_partkey") % 99 + 1).alias("number")).agg(F.avg(F.col("l_discount").cast("decimal(30,18)")).alias("mean"), F.count("*").alias("n"))
    s = v.withColumn("score", F.expr("mean + least(0.12, cast(0.04 * (n - 1) as decimal(20,2)))")).filter("number not in (6, 9) or n >= 2")
    place = F.row_number().over(W.partitionBy("track").orderBy(F.col("score").desc(), F.col("n").desc(), "number"))
    return s.withColumn("place", place.cast("long")).filter("place <= 3").select("track", "number", "n", "place", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("""WITH m AS (SELECT o_custkey % 50 AS cluster, o_custkey AS track, c_nationkey AS team, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), a AS (SELECT cluster, count(DISTINCT team) AS teams FROM m GROUP BY cluster)
SELECT cluster, track, team, teams > 1 AS ambiguous, round(CASE WHEN teams > 1 THEN greatest(0.2, 0.72 * least(0.88, 0.3 + 0.02 * n)) ELSE least(0.88, 0.3 + 0.02 * n) END, 6) AS confidence FROM m JOIN a USING (cluster)""", confidence="DOUBLE")
def cluster_team_ambiguity(t: Tables):
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    m = o.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("o_custkey") % 50).alias("cluster"), F.col("o_custkey").alias("track"), F.col("c_nationkey").alias("team"), "n")
    a = m.groupBy("cluster").agg(F.count_distinct("team").alias("teams"))
    base = F.least(F.lit(0.88), 0.3 + 0.02 * F.col("n"))
    return m.join(a, "cluster").select("cluster", "track", "team", (F.col("teams") > 1).alias("ambiguous"), F.round(F.when(F.col("teams") > 1, F.greatest(F.lit(0.2), 0.72 * base)).otherwise(base), 6).alias("confidence"))


SQL_SCORE = """(SELECT o_orderkey, s_suppkey, CAST(2.3 AS DOUBLE) * CAST(c_nationkey = s_nationkey AS INT) + 0.7 * CAST(c_nationkey % 5 = s_nationkey % 5 AS INT) + 1.2 * CAST(l_shipdate >= o_orderdate AS INT) + least(3.2, 1.2 * l_linenumber) + 0.6 * CAST(o_orderpriority LIKE '1%' AS INT)
 + 0.4 * CAST(l_returnflag = 'N' AS INT) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""


@query(f"""WITH m AS (SELECT o_orderkey, s_suppkey, max(score) AS score FROM {SQL_SCORE} GROUP BY ALL HAVING max(score) >= 2.5), b AS (SELECT *, max(score) OVER (PARTITION BY o_orderkey) AS best, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, s_suppkey) AS r FROM m)
SELECT o_orderkey, s_suppkey, round(score, 4) AS score, round(least(0.96, score / 8), 4) AS confidence, CASE WHEN score >= 6 THEN 'confirmed' WHEN score >= 3.2 THEN 'candidate' ELSE 'weak' END AS status FROM b WHERE r <= 2 AND score >= best - 1""")
def match_rule_score(t: Tables):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    l = t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate", "l_linenumber", "l_returnflag").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    # Both sides are dealt by order once, over all tasks: the maximum and the windows below stay in those, small as they are.
    j = spread(l, "l_orderkey").join(spread(o, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    yes = lambda c, w: w * c.cast("int")
    score = (
        yes(F.col("c_nationkey") == F.col("s_nationkey"), 2.3) + yes(F.col("c_nationkey") % 5 == F.col("s_nationkey") % 5, 0.7) + yes(F.col("l_shipdate") >= F.col("o_orderdate"), 1.2)
        + F.least(F.lit(3.2), 1.2 * F.col("l_linenumber")) + yes(F.col("o_orderpriority").startswith("1"), 0.6) + yes(F.col("l_returnflag") == "N", 0.4)
    )
    m = j.withColumn("score", score).groupBy("o_orderkey", "s_suppkey").agg(F.max("score").alias("score")).filter("score >= 2.5")
    by = W.partitionBy("o_orderkey")
    m = m.withColumn("best", F.max("score").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.col("score").desc(), "s_suppkey"))).filter("r <= 2 and score >= best - 1")
    return m.select("o_orderkey", "s_suppkey", F.round("score", 4).alias("score"), F.round(F.least(F.lit(0.96), F.col("score") / 8), 4).alias("confidence"), F.when(F.col("score") >= 6, "confirmed").when(F.col("score") >= 3.2, "candidate").otherwise("weak").alias("status"))


@query("SELECT l_suppkey AS track, count(*) AS n, round(avg(l_discount), 8) AS confidence, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(DISTINCT l_orderkey) AS segments FROM lineitem GROUP BY l_suppkey")
def track_summaries(t: Tables):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("track")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 8).alias("confidence"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.count_distinct("l_orderkey").alias("segments"))


@query("""WITH e AS (SELECT l_returnflag AS kind, l_linestatus AS origin, count(*) AS n, avg(l_discount) AS c, max(l_linenumber) AS trust FROM lineitem GROUP BY ALL)
SELECT kind, sum(n) AS n, round(sum(c * n) / sum(n), 6) AS confidence, max(trust) AS trust, string_agg(origin || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, origin) AS sources FROM e GROUP BY kind""", n="BIGINT")
def event_type_aggregate(t: Tables):
    e = t.lineitem.groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("origin")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("c"), F.max("l_linenumber").alias("trust"))
    g = e.groupBy("kind").agg(F.sum("n").alias("n"), (F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("confidence"), F.max("trust").alias("trust"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "origin"))).alias("s"))
    return g.select("kind", "n", F.round("confidence", 6).alias("confidence"), "trust", F.array_join(F.transform("s", lambda x: F.concat(x["origin"], F.lit("="), (-x["m"]).cast("string"))), ",").alias("sources"))


@query("""WITH s AS (SELECT n_regionkey AS domain, n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT r_name AS domain, count(n_nationkey) AS scoped, count(*) FILTER (n > 0) AS matched, CASE WHEN count(*) FILTER (n > 0) = count(n_nationkey) THEN 'ready' WHEN count(*) FILTER (n > 0) > 0 THEN 'partial' ELSE 'missing' END AS status, round(count(*) FILTER (n > 0) / greatest(1, count(n_nationkey)), 3) AS ratio
FROM region LEFT JOIN s ON domain = r_regionkey GROUP BY r_name""")
def scope_coverage(t: Tables):
    c = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    s = t.nation.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    g = t.region.join(s, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy(F.col("r_name").alias("domain")).agg(F.count("n_nationkey").alias("scoped"), F.count_if(F.col("n") > 0).alias("matched"))
    return g.select("*", F.when(F.col("matched") == F.col("scoped"), "ready").when(F.col("matched") > 0, "partial").otherwise("missing").alias("status"), F.round(F.col("matched") / F.greatest(F.lit(1), "scoped"), 3).alias("ratio"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_tax), 6) AS avg_tax, count(*) AS n FROM lineitem GROUP BY ALL")
def fact_rollup(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_tax"), 6).alias("avg_tax"), F.count("*").alias("n"))

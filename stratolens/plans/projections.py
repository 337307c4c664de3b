"""Projections, predicates and diagnostics of segments and their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ordered as O
from .base import Tables, query
from .intervals import HOUR, MIN, S, beside, ev
from .search import NORM, SQL_TERMS

EV = "(SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS t_at FROM events)"


@query(f"""SELECT event_id, greatest(0, t_at - {2 * S}) AS start, t_at + {2 * S} AS "end", event_type || ' by user ' || CAST(user_id AS VARCHAR) AS title, CASE WHEN value > 80 THEN 'trusted' WHEN value > 20 THEN 'weak' ELSE 'failed' END AS trust FROM {EV}""")
def clip_projection(t: Tables):
    trust = F.when(F.col("value") > 80, "trusted").when(F.col("value") > 20, "weak").otherwise("failed")
    return ev(t).select("event_id", F.greatest(F.lit(0), F.col("at") - 2 * S).alias("start"), (F.col("at") + 2 * S).alias("end"), F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("title"), trust.alias("trust"))


@query("""SELECT d.doc_id, coalesce(d.source, 'unknown_source') AS source, coalesce(CASE max(toxic) WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' END, 'unknown_safety') AS safety, coalesce(CASE max(quality) WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'unknown_quality') AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id, d.source""")
def feature_projection(t: Tables):
    l = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("x"), F.max("quality").alias("q"))
    d = t.documents.select("doc_id", "source").join(l, "doc_id", "left")
    return d.select("doc_id", F.coalesce("source", F.lit("unknown_source")).alias("source"), F.coalesce(F.when(F.col("x") == 1, "toxic").when(F.col("x") == 0, "clean"), F.lit("unknown_safety")).alias("safety"), F.coalesce(F.when(F.col("q") == 1, "good").when(F.col("q") == 0, "poor"), F.lit("unknown_quality")).alias("quality"))


@query(f"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS play_no, 1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS down, 'User ' || CAST(user_id AS VARCHAR) || ' did ' || event_type || ' at ' || CAST(t_at // {MIN} AS VARCHAR) AS source_text FROM {EV} WHERE value IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL""")
def play_projection(t: Tables):
    e = ev(t).withColumn("play_no", F.get_json_object("props", "$.k").try_cast("int")).filter("value is not null and play_no is not null")
    text = F.format_string("User %d did %s at %d", "user_id", "event_type", F.floor(F.col("at") / MIN))
    return e.select("event_id", "play_no", (1 + F.col("play_no") % 4).alias("down"), text.alias("source_text"))


@query("""WITH u AS (SELECT 0 AS o, 'region' AS kind, r_regionkey AS id, r_name AS title FROM region UNION ALL SELECT 1, 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 2, 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 3, 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 4, 'part', p_partkey, p_name FROM part)
SELECT lower(trim(title)) AS key, arg_min(kind, (o, id)) AS kind, arg_min(id, (o, id)) AS id, count(*) AS merged FROM u WHERE trim(title) <> '' GROUP BY 1""")
def knowledge_documents(t: Tables):
    row = lambda df, o, kind, i, title: df.select(F.lit(o).alias("o"), F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), F.col(title).alias("title"))
    u = row(t.region, 0, "region", "r_regionkey", "r_name").union(row(t.nation, 1, "nation", "n_nationkey", "n_name")).union(row(t.supplier, 2, "supplier", "s_suppkey", "s_name"))
    u = u.union(row(t.customer, 3, "customer", "c_custkey", "c_name")).union(row(t.part, 4, "part", "p_partkey", "p_name")).filter(F.trim("title") != "")
    g = u.groupBy(F.lower(F.trim("title")).alias("key")).agg(F.min(F.struct("o", "id", "kind")).alias("b"), F.count("*").alias("merged"))
    return g.select("key", "b.kind", "b.id", "merged")


@query("""SELECT event_id, unnest(list_filter([CASE WHEN value > 50 THEN 'ball' END, CASE WHEN event_type IN ('click', 'view') THEN 'player' END, CASE WHEN value > 50 AND event_type IN ('click', 'view') THEN 'link' END], lambda x: x IS NOT NULL)) AS track_type FROM events""")
def tracking_rows(t: Tables):
    ball, player = F.col("value") > 50, F.col("event_type").isin("click", "view")
    kinds = F.array(F.when(ball, "ball"), F.when(player, "player"), F.when(ball & player, "link"))
    return t.events.select("event_id", F.explode(F.array_compact(kinds)).alias("track_type"))


@query("""SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT tag))[1:6], ',') AS tags, count(DISTINCT tag) AS n FROM (SELECT l_orderkey, unnest([l_returnflag, l_linestatus, 'line-' || CAST(l_linenumber AS VARCHAR)]) AS tag FROM lineitem) GROUP BY l_orderkey""")
def metadata_tags(t: Tables):
    tags = F.array("l_returnflag", "l_linestatus", F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")))
    g = t.lineitem.select("l_orderkey", F.explode(tags).alias("tag")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("tag")).alias("s"))
    return g.select("l_orderkey", F.array_join(F.slice("s", 1, 6), ",").alias("tags"), F.size("s").cast("long").alias("n"))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN '/mobile/' || substr(url, 11) WHEN starts_with(url, 'https://') THEN '/web/' || substr(url, 9) ELSE url END AS path FROM pages""")
def path_reroot(t: Tables):
    u = F.col("url")
    return t.pages.select("page_id", F.when(u.startswith("https://m."), F.concat(F.lit("/mobile/"), F.expr("substring(url, 11)"))).when(u.startswith("https://"), F.concat(F.lit("/web/"), F.expr("substring(url, 9)"))).otherwise(u).alias("path"))


@query("""WITH g AS (SELECT conv_id, list(struct_pack(t := turn, r := role) ORDER BY turn) AS turns FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system') OR count(*) > 6)
SELECT conv_id, len(list_filter(turns, lambda x: x.r <> 'system')) AS kept, array_to_string(list_transform(list_filter(turns, lambda x: x.r = 'user'), lambda x: CAST(x.t AS VARCHAR)), ',') AS user_turns FROM g""")
def scope_filter(t: Tables):
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("t"), F.col("role").alias("r")))).alias("turns"), F.bool_or(F.col("role") == "system").alias("s"))
    g = g.filter(F.col("s") | (F.size("turns") > 6))
    users = F.transform(F.filter("turns", lambda x: x["r"] == "user"), lambda x: x["t"].cast("string"))
    return g.select("conv_id", F.size(F.filter("turns", lambda x: x["r"] != "system")).cast("long").alias("kept"), F.array_join(users, ",").alias("user_turns"))


@query("""WITH h AS (SELECT doc_id, source FROM documents WHERE contains(text, '[id 7]')), n AS (SELECT count(*) AS n FROM h) SELECT d.doc_id FROM documents d, n WHERE (n = 0 AND d.lang = 'de') OR d.doc_id IN (SELECT doc_id FROM h)""")
def referenced_scope(t: Tables):
    """The texts that are named, or all in the language if none is."""
    d = t.documents.select("doc_id", "lang", F.col("text").contains("[id 7]").alias("hit"))
    n = d.agg(F.count_if("hit").alias("n"))  # one row
    return d.crossJoin(F.broadcast(n)).filter("hit or (n = 0 and lang = 'de')").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains({NORM}, 'the ') AND contains({NORM}, 'tion') AND contains({NORM}, source) = FALSE")
def asset_text_filter(t: Tables):
    n = X.normalised(F.col("text"))
    return t.documents.filter(n.contains("the ") & n.contains("tion") & ~n.contains(F.col("source"))).select("doc_id")


@query("""SELECT user_id, bool_or(event_type = 'purchase' AND value > 50 AND CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0) AS accepted, bool_or(event_type = 'purchase') AND bool_or(event_type = 'error' AND value > 90) AS conflict FROM events GROUP BY user_id""")
def event_exists_predicate(t: Tables):
    buy = F.col("event_type") == "purchase"
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.groupBy("user_id").agg(F.bool_or(buy & (F.col("value") > 50) & (k % 2 == 0)).alias("accepted"), (F.bool_or(buy) & F.bool_or((F.col("event_type") == "error") & (F.col("value") > 90))).alias("conflict"))


@query("""SELECT p_partkey, contains(a, b) OR contains(b, a) OR contains(regexp_replace(a, '[^a-z0-9]+', '', 'g'), regexp_replace(b, '[^a-z0-9]+', '', 'g')) AS matches FROM (SELECT p_partkey, lower(p_brand) AS a, lower(substr(p_type, 1, 5)) AS b FROM part WHERE p_brand <> '' AND p_type <> '')""")
def metadata_predicate(t: Tables):
    a, b = F.lower("p_brand"), F.lower(F.substring("p_type", 1, 5))
    bare = lambda c: F.regexp_replace(c, "[^a-z0-9]+", "")
    return t.part.filter("p_brand <> '' and p_type <> ''").select("p_partkey", (a.contains(b) | b.contains(a) | bare(a).contains(bare(b))).alias("matches"))


@query(f"""WITH w AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY t_at, event_id) AS before, value, t_at FROM {EV}) SELECT user_id, count(*) AS n, count(*) FILTER (before <> event_type) AS switches, count(*) FILTER (value > 50) AS high, count(DISTINCT t_at // {24 * HOUR}) AS days, max(t_at) AS updated FROM w GROUP BY user_id""")
def tracking_summary(t: Tables):
    w = beside(t, before=("event_type", -1))
    return w.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("event_type")).alias("switches"), F.count_if(F.col("value") > 50).alias("high"), F.count_distinct("day").alias("days"), F.max("at").alias("updated"))


@query(f"""WITH w AS (SELECT conv_id, turn, unnest(list_distinct({SQL_TERMS})) AS term FROM conversations), f AS (SELECT conv_id, term, min(turn) AS first_turn, count(*) AS turns FROM w WHERE length(term) > 3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turns DESC, first_turn, term) AS rank FROM f)
SELECT conv_id, term, turns, first_turn FROM r WHERE rank <= 5""")
def token_merge(t: Tables):
    w = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term")).filter(F.length("term") > 3)
    f = w.groupBy("conv_id", "term").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"))
    return O.top_per_group(f, ["conv_id"], 5, [F.col("turns").desc(), F.col("first_turn"), F.col("term")], "term").select("conv_id", "term", "turns", "first_turn")


@query("""WITH a AS (SELECT 'competition' AS kind, n_nationkey AS id, n_name AS title FROM nation ORDER BY id LIMIT 8), b AS (SELECT 'player', c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 80), c AS (SELECT 'fact', o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30),
d AS (SELECT 'activity', l_orderkey * 10 + l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_extendedprice DESC, 2, l_partkey, l_suppkey LIMIT 80), p AS (SELECT 'play', event_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 80),
v AS (SELECT 'video', doc_id, source FROM (SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM documents WHERE source IS NOT NULL GROUP BY source))
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM p UNION ALL SELECT * FROM v""")
def grounded_evidence(t: Tables):
    a = t.nation.orderBy("n_nationkey").limit(8).select(F.lit("competition").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"))
    b = t.customer.filter("c_acctbal > 0").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(80).select(F.lit("player"), "c_custkey", "c_name")
    c = t.orders.filter("o_orderstatus = 'P'").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(30).select(F.lit("fact"), "o_orderkey", "o_orderpriority")
    d = t.lineitem.filter("l_returnflag = 'R'").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).orderBy(F.col("l_extendedprice").desc(), "id", "l_partkey", "l_suppkey").limit(80).select(F.lit("activity"), "id", "l_returnflag")
    p = t.events.filter("event_type = 'purchase'").orderBy(F.col("value").desc(), "event_id").limit(80).select(F.lit("play"), "event_id", "event_type")
    v = t.documents.filter("source is not null").groupBy("source").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("d")))["d"].alias("d")).select(F.lit("video"), -F.col("d"), "source")
    return a.union(b).union(c).union(d).union(p).union(v)


@query(f"""WITH p AS (SELECT user_id, round((t_at % {24 * HOUR}) / {S}, 2) AS second, event_id FROM {EV}), k AS (SELECT user_id, second, max(event_id) AS event_id FROM p WHERE second > 0.2 AND second < 86399.8 GROUP BY ALL) SELECT user_id, second, event_id, least(86400, second + 1.0) - second >= 1 AS whole FROM k""")
def scene_boundary_normalise(t: Tables):
    p = ev(t).select("user_id", F.round((F.col("at") % (24 * HOUR)) / S, 2).alias("second"), "event_id").filter("second > 0.2 and second < 86399.8")
    k = p.groupBy("user_id", "second").agg(F.max("event_id").alias("event_id"))
    return k.select("user_id", "second", "event_id", (F.least(F.lit(86400.0), F.col("second") + 1.0) - F.col("second") >= 1).alias("whole"))


@query(f"""WITH d AS (SELECT user_id, t_at // {24 * HOUR} AS day, count(DISTINCT t_at // {HOUR}) AS hours FROM {EV} GROUP BY ALL) SELECT user_id, day, hours, round(1 - hours / 24, 4) AS silent, 1 - hours / 24 > 0.2 AS music FROM d""")
def speech_share(t: Tables):
    d = ev(t).groupBy("user_id", F.floor(F.col("at") / (24 * HOUR)).alias("day")).agg(F.count_distinct(F.floor(F.col("at") / HOUR)).alias("hours"))
    rest = 1 - F.col("hours") / 24
    return d.select("user_id", "day", "hours", F.round(rest, 4).alias("silent"), (rest > 0.2).alias("music"))


@query("""SELECT o_orderkey, quarter(o_orderdate) AS quarter, (quarter(o_orderdate) - 1) * 15 + 15 - (day(o_orderdate) % 15) AS elapsed, year(o_orderdate) IN (1995, 1997) AS exact_season, contains('1995,1997-98', CAST(year(o_orderdate) AS VARCHAR)) AS loose_season FROM orders""", quarter="INTEGER", elapsed="INTEGER")
def clock_and_season_match(t: Tables):
    q = F.quarter("o_orderdate")
    return t.orders.select("o_orderkey", q.alias("quarter"), ((q - 1) * 15 + 15 - F.day("o_orderdate") % 15).alias("elapsed"), F.year("o_orderdate").isin(1995, 1997).alias("exact_season"), F.lit("1995,1997-98").contains(F.year("o_orderdate").cast("string")).alias("loose_season"))


@query("""WITH m AS (SELECT c_nationkey AS scope, c_mktsegment AS name, max(c_acctbal) AS confidence, count(*) AS n FROM customer GROUP BY ALL) SELECT scope, name, round(confidence, 2) AS confidence, n, confidence >= 9000 AS strong FROM m WHERE confidence > 0""")
def mentions_max_confidence(t: Tables):
    m = t.customer.groupBy(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("name")).agg(F.max("c_acctbal").alias("c"), F.count("*").alias("n")).filter("c > 0")
    return m.select("scope", "name", F.round("c", 2).alias("confidence"), "n", (F.col("c") >= 9000).alias("strong"))


@query("""WITH g AS (SELECT l_suppkey AS cluster, count(*) AS boxes, count(DISTINCT l_partkey) AS tracks, avg(l_tax) AS c FROM lineitem WHERE l_linenumber > 3 GROUP BY l_suppkey) SELECT s_suppkey AS cluster, coalesce(boxes, 0) AS boxes, coalesce(tracks, 0) AS tracks, round(c, 6) AS confidence, boxes IS NULL AS empty FROM supplier LEFT JOIN g ON cluster = s_suppkey""")
def detection_diagnostics(t: Tables):
    g = t.lineitem.filter("l_linenumber > 3").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("b"), F.count_distinct("l_partkey").alias("p"), F.avg("l_tax").alias("c"))
    j = t.supplier.select(F.col("s_suppkey").alias("cluster")).join(g, F.col("cluster") == F.col("k"), "left")
    return j.select("cluster", F.coalesce("b", F.lit(0)).alias("boxes"), F.coalesce("p", F.lit(0)).alias("tracks"), F.round("c", 6).alias("confidence"), F.col("b").isNull().alias("empty"))


@query("""WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS tags FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(list_filter(tags, lambda x: x NOT IN ('1-URGENT', '5-LOW')), '|') AS left_tags, CASE WHEN list_contains(tags, '1-URGENT') THEN 'active' ELSE 'idle' END AS status FROM a""")
def array_element_removal(t: Tables):
    a = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("tags"))
    gone = F.array(F.lit("1-URGENT"), F.lit("5-LOW"))
    return a.select("o_custkey", F.array_join(F.array_except("tags", gone), "|").alias("left_tags"), F.when(F.array_contains("tags", "1-URGENT"), "active").otherwise("idle").alias("status"))



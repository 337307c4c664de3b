"""Whole timelines and texts put together from the parts: fused windows, search texts, activities, traces, clusters' ranks, flags."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as X
from ..operators import intervals as I, ordered as O
from ..streaming import jobs
from . import evidence  # noqa: F401  its queries are built upon here
from .base import ORACLE_SQL, QUERIES, Tables, query
from .intervals import HOUR, ORDER, SQL_POINTS, ev
from .search import NORM

GAP, SHORT, LONG = HOUR // 2, 3 * HOUR, 6 * HOUR


def fuse(state, x):
    """state: last point kept, begin of the window held back (none yet), the open window's begin. -> state, a window that is sure now."""
    if state is None:
        return (x, None, x), None
    kept, held, begin = state
    if x - kept < GAP:
        return state, None
    if x - begin >= SHORT:
        return (x, begin, x), (held, begin) if held is not None else None
    return (x, held, begin), None


def last_window(state):
    """What is left over at the end extends the window held back."""
    kept, held, begin = state
    begin = held if held is not None else begin
    return (begin, kept) if kept > begin else None


@query(f"""WITH k AS (SELECT user_id, list_reduce(list_transform(points, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= {GAP} THEN list_concat(a, x) ELSE a END) AS p FROM {SQL_POINTS}),
b AS (SELECT user_id, p, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= {SHORT} THEN list_concat(a, x) ELSE a END) AS b FROM k WHERE len(p) > 1), e AS (SELECT user_id, CASE WHEN len(b) = 1 THEN [b[1], p[len(p)]] ELSE list_concat(b[1:len(b) - 1], [p[len(p)]]) END AS b FROM b),
w AS (SELECT user_id, b[i] AS start, b[i + 1] AS "end" FROM (SELECT *, unnest(range(1, len(b))) AS i FROM e)), l AS (SELECT *, greatest(1, CAST(ceil(("end" - start) / {LONG}) AS BIGINT)) AS parts FROM w), x AS (SELECT *, unnest(range(parts)) AS part FROM l),
s AS (SELECT user_id, start + CAST(floor(part * (("end" - start) / parts)) AS BIGINT) AS start, start + CAST(floor((part + 1) * (("end" - start) / parts)) AS BIGINT) AS "end" FROM x),
o AS (SELECT s.*, event_type, count(*) AS n FROM s JOIN (SELECT user_id, event_type, epoch_us(ts) AS t_at FROM events) e ON e.user_id = s.user_id AND t_at >= s.start AND t_at < s."end" GROUP BY ALL)
SELECT s.user_id, s.start, s."end", arg_max(event_type, (n, event_type)) AS best_type, coalesce(sum(n), 0) AS points FROM s LEFT JOIN o ON o.user_id = s.user_id AND o.start = s.start AND o."end" = s."end" GROUP BY ALL""", points="BIGINT")
def timeline_fusion(t: Tables):
    """Points thinned, windows between them joined until they last, what is too long split, and each window with the kind of event it has most of."""
    w = I.folded(ev(t), "user_id", "at", fuse, last_window, "start end")
    s = I.split(w, LONG)
    e = ev(t).select("user_id", "event_type", F.col("at").alias("r_start"), (F.col("at") + 1).alias("r_end"))
    o = I.overlap_join(s, e, ["user_id"], LONG).groupBy("user_id", "start", "end", "event_type").agg(F.count("*").alias("n"))
    o = o.groupBy("user_id", "start", "end").agg(F.max(F.struct("n", "event_type"))["event_type"].alias("best_type"), F.sum("n").alias("points"))
    return s.drop("part").join(o, ["user_id", "start", "end"], "left").select("user_id", "start", "end", "best_type", F.coalesce("points", F.lit(0)).alias("points"))


@query(f"""SELECT doc_id, md5(concat_ws(' ', source, lang, text, CASE WHEN tox = 0 THEN 'trusted' END)) AS search_text, md5({NORM.replace('text', "concat_ws(' ', source, text)")}) AS haystack, 'Label: ' || coalesce(source, 'none') || '. Language: ' || coalesce(lang, 'unknown') || '.' AS to_embed
FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS tox FROM labels GROUP BY doc_id) l USING (doc_id)""")
def segment_texts(t: Tables):
    """The texts that search, filters and embeddings read of a segment; trusted layers only where they are trusted. Whole texts, as digests."""
    tox = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("tox"))
    d = t.documents.join(tox, "doc_id", "left")
    search = F.concat_ws(" ", "source", "lang", "text", F.when(F.col("tox") == 0, "trusted"))
    to_embed = F.concat(F.lit("Label: "), F.coalesce("source", F.lit("none")), F.lit(". Language: "), F.coalesce("lang", F.lit("unknown")), F.lit("."))
    return d.select("doc_id", F.md5(search).alias("search_text"), F.md5(X.normalised(F.concat_ws(" ", "source", "text"))).alias("haystack"), to_embed.alias("to_embed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(list_filter([CASE WHEN l_returnflag = 'R' THEN 'goal' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'assist' END, CASE WHEN l_quantity > 45 THEN 'card' END, CASE WHEN l_linenumber >= 6 THEN 'sub_in' END, CASE WHEN l_linenumber >= 6 THEN 'sub_out' END, CASE WHEN l_linenumber <= 2 THEN 'start' ELSE 'bench' END], lambda x: x IS NOT NULL)) AS activity FROM lineitem""")
def match_activities(t: Tables):
    """A row for each activity that a line of a match tells of: goals with their assists, cards, changes, and who began."""
    yes = lambda c, name: F.when(F.expr(c), name)
    kinds = F.array(yes("l_returnflag = 'R'", "goal"), yes("l_returnflag = 'R' and l_linestatus = 'F'", "assist"), yes("l_quantity > 45", "card"), yes("l_linenumber >= 6", "sub_in"), yes("l_linenumber >= 6", "sub_out"), F.when(F.col("l_linenumber") <= 2, "start").otherwise("bench"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(F.array_compact(kinds)).alias("activity"))


@query("""WITH e AS (SELECT o_custkey, o_orderkey, o_orderpriority || '/' || o_orderstatus AS trace, CASE WHEN o_orderpriority < '3' THEN o_orderpriority ELSE o_orderpriority || '/' || o_orderstatus END AS grp FROM orders), g AS (SELECT o_custkey, grp, min(o_orderkey) AS place, arg_max(trace, o_orderkey) AS trace FROM e GROUP BY ALL)
SELECT o_custkey, string_agg(trace, ',' ORDER BY place) AS traces FROM g GROUP BY o_custkey""")
def trace_merge(t: Tables):
    """A trace of a known group takes the place of the group's last one; others are added once."""
    trace = F.concat("o_orderpriority", F.lit("/"), "o_orderstatus")
    e = t.orders.select("o_custkey", "o_orderkey", trace.alias("trace"), F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")).otherwise(trace).alias("grp"))
    g = e.groupBy("o_custkey", "grp").agg(F.min("o_orderkey").alias("place"), F.max(F.struct("o_orderkey", "trace"))["trace"].alias("trace"))
    s = g.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("place", "trace"))).alias("s"))
    return s.select("o_custkey", F.array_join(F.transform("s", lambda x: x["trace"]), ",").alias("traces"))


@query("""SELECT user_id, array_to_string(list_filter([CASE WHEN count(*) < 50 THEN 'few_points' END, CASE WHEN count(DISTINCT event_type) < 5 THEN 'missing_kinds' END, CASE WHEN count(*) FILTER (event_type = 'error') * 5 > count(*) THEN 'many_errors' END, CASE WHEN max(value) > 200 THEN 'outliers' END, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'no_purchase' END], lambda x: x IS NOT NULL), ',') AS flags FROM events GROUP BY user_id""")
def quality_flags(t: Tables):
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("most"), F.count_if(F.col("event_type") == "purchase").alias("buys"))
    flag = lambda c, name: F.when(F.expr(c), name)
    flags = F.array(flag("n < 50", "few_points"), flag("kinds < 5", "missing_kinds"), flag("errors * 5 > n", "many_errors"), flag("most > 200", "outliers"), flag("buys = 0", "no_purchase"))
    return g.select("user_id", F.array_join(F.array_compact(flags), ",").alias("flags"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 50")
def stream_filtered(t: Tables):
    """A subscriber's part of a stream: the kinds and values that it asks for."""
    return jobs.run(jobs.events(t.spark, t.sf_dir).filter("event_type = 'click' and value > 50").select("event_id", "user_id"), "append")


SQL_BALLS = "(SELECT event_id, user_id, epoch_us(ts) AS t_at, hour(ts) / 24 AS x, minute(ts) / 60 AS y FROM events)"


@query(f"""WITH p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM {SQL_BALLS} WINDOW w AS (PARTITION BY user_id ORDER BY t_at, event_id)), d AS (SELECT *, sqrt(power(x - px, 2) + power(y - py, 2)) AS d FROM p),
n AS (SELECT *, sum(CASE WHEN d <= 0.28 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t_at, event_id ROWS UNBOUNDED PRECEDING) AS track FROM d)
SELECT event_id, user_id, track, round(d, 4) AS moved, round(least(1, 0.25 + 0.12 * (row_number() OVER (PARTITION BY user_id, track ORDER BY t_at, event_id) - 1)), 2) AS continuity FROM n""", track="BIGINT", continuity="DOUBLE")
def ball_tracks(t: Tables):
    """A point near the one before goes on with its track, which grows surer by a step each time; else a new track begins."""
    e = t.events.select("event_id", "user_id", I.micros(F.col("ts")).alias("at"), (F.hour("ts") / 24).alias("x"), (F.minute("ts") / 60).alias("y")).withColumn("day", F.floor(F.col("at") / (24 * HOUR)))
    p = O.neighbours(e, ["user_id"], "day", ORDER, px=("x", -1), py=("y", -1)).withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)))
    p = p.withColumns({"new": F.when(F.col("d") <= 0.28, 0).otherwise(1), "one": F.lit(1)})
    p = O.running(O.running(p, ["user_id"], "day", ORDER, "track", "new", "sum"), ["user_id"], "day", ORDER, "place", "one", "sum")
    p = O.running(p.withColumn("begin", F.when(F.col("new") == 1, F.col("place"))), ["user_id"], "day", ORDER, "since", "begin")
    return p.select("event_id", "user_id", "track", F.round("d", 4).alias("moved"), F.round(F.least(F.lit(1.0), 0.25 + 0.12 * (F.col("place") - F.col("since"))), 2).alias("continuity"))


@query(f"SELECT asset, vec_id, cluster, row_number() OVER (PARTITION BY asset, cluster ORDER BY similarity DESC, vec_id) AS rank FROM ({ORACLE_SQL['leader_clustering']})")
def cluster_ranks(t: Tables):
    """Members of a cluster by how near they are to its centre."""
    c = QUERIES["leader_clustering"](t.spark, t.sf_dir)
    rank = F.row_number().over(W.partitionBy("asset", "cluster").orderBy(F.col("similarity").desc(), "vec_id"))
    return c.select("asset", "vec_id", "cluster", rank.cast("long").alias("rank"))


@query(f"""WITH s AS (SELECT event_id AS segment, user_id, epoch_us(ts) AS start, epoch_us(ts) + {HOUR} AS "end" FROM events WHERE event_type = 'purchase'), f AS (SELECT event_id, user_id, epoch_us(ts) AS t_at FROM events WHERE event_type = 'error')
SELECT event_id, arg_min(segment, (start, segment)) AS segment FROM f LEFT JOIN s ON s.user_id = f.user_id AND t_at >= start AND t_at < "end" GROUP BY event_id""")
def frame_segment(t: Tables):
    """The first segment that holds a frame; null if none does."""
    f = ev(t).filter("event_type = 'error'").select("event_id", "user_id", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    s = ev(t).filter("event_type = 'purchase'").select(F.col("event_id").alias("segment"), "user_id", F.col("at").alias("r_start"), (F.col("at") + HOUR).alias("r_end"))
    o = I.overlap_join(f, s, ["user_id"], HOUR, "left")
    return o.groupBy("event_id").agg(F.min(F.when(F.col("segment").isNotNull(), F.struct("r_start", "segment")))["segment"].alias("segment"))


@query("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, event_type IN ('purchase', 'error', 'view') AS done FROM events), r AS (SELECT *, CASE WHEN done THEN row_number() OVER (PARTITION BY user_id, done ORDER BY ts, event_id) END AS r FROM n)
SELECT event_id, user_id FROM r WHERE n < 80 OR NOT done OR r > n - 60""")
def operation_log(t: Tables):
    """Of a user with 80 operations or more, the oldest finished ones go until 60 are left or none is finished."""
    e = ev(t).withColumns({"done": F.col("event_type").isin("purchase", "error", "view").cast("int"), "day": F.floor(F.col("at") / (24 * HOUR))})
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    r = O.running(e, ["user_id"], "day", ORDER, "r", "done", "sum").join(n, "user_id")
    return r.filter((F.col("n") < 80) | (F.col("done") == 0) | (F.col("r") > F.col("n") - 60)).select("event_id", "user_id")


@query("""WITH g AS (SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 3600 AS length, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, CAST(floor(length * 30 / 250) AS BIGINT) AS expected, round(least(1, n / greatest(1, floor(length * 30 / 250))), 4) AS coverage FROM g""", coverage="DOUBLE")
def frame_coverage(t: Tables):
    """Frames that a length should have at 30 a unit and one of 250 taken, and the share that is there."""
    g = ev(t).groupBy("user_id").agg(((F.max("at") - F.min("at")) / 1e6 / 3600).alias("length"), F.count("*").alias("n"))
    expected = F.floor(F.col("length") * 30 / 250)
    return g.select("user_id", expected.alias("expected"), F.round(F.least(F.lit(1.0), F.col("n") / F.greatest(F.lit(1), expected)), 4).alias("coverage"))


@query("""WITH l AS (SELECT l_orderkey, list_distinct(list(tag ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, k)) AS d, list(tag ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, k) AS a FROM (SELECT *, unnest([l_returnflag, l_linestatus, 'part-' || CAST(l_partkey % 50 AS VARCHAR)]) AS tag, unnest([0, 1, 2]) AS k FROM lineitem) GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL)[1:32], ',') AS tags FROM l""")
def ordered_tags(t: Tables):
    """Distinct tags in order of appearance, 32 at most, which is the rule for an asset's tags."""
    tags = F.array("l_returnflag", "l_linestatus", F.concat(F.lit("part-"), (F.col("l_partkey") % 50).cast("string")))
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", tags.alias("tags")))).alias("s"))
    return g.select("l_orderkey", F.array_join(F.slice(F.array_distinct(F.flatten(F.transform("s", lambda x: x["tags"]))), 1, 32), ",").alias("tags"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE 'none' END AS title, event_id % 3 = 0 AND event_type <> 'error' AS searchable FROM events""")
def json_path_fallback(t: Tables):
    """The first of several dotted paths that a payload has, and a gate on another."""
    payload = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.struct(F.struct(F.col("event_type").alias("title")).alias("fields")).alias("raw"), F.struct((F.col("event_type") != "error").alias("eligible")).alias("compliance")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.struct(F.col("user_id").cast("string").alias("name")).alias("meta")))).otherwise("{}")
    path = lambda p: F.get_json_object("payload", f"$.{p}")
    e = t.events.select("event_id", payload.alias("payload"))
    return e.select("event_id", F.coalesce(path("raw.fields.title"), path("meta.name"), F.lit("none")).alias("title"), F.coalesce(path("compliance.eligible") == "true", F.lit(False)).alias("searchable"))


@query("""WITH e AS (SELECT o_custkey AS segment, bool_or(l_returnflag = 'R' AND l_linenumber > 2) AS hit, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN hit THEN 'trusted' WHEN n > 3 THEN 'failed' WHEN c_mktsegment = 'BUILDING' THEN 'weak' ELSE 'failed' END AS event_filter FROM customer LEFT JOIN e ON segment = c_custkey""")
def event_filter_status(t: Tables):
    """Trusted where an event meets all conditions; failed where there are events and none does; else the text may speak for it."""
    e = t.lineitem.select("l_orderkey", "l_returnflag", "l_linenumber").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.groupBy(F.col("o_custkey").alias("segment")).agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 2)).alias("hit"), F.count("*").alias("n"))
    c = t.customer.join(e, F.col("c_custkey") == F.col("segment"), "left")
    return c.select("c_custkey", F.when(F.col("hit"), "trusted").when(F.col("n") > 3, "failed").when(F.col("c_mktsegment") == "BUILDING", "weak").otherwise("failed").alias("event_filter"))


@query(f"""WITH s AS ({ORACLE_SQL['dice_bigram_compare']}), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY similarity, turn) AS place FROM s) SELECT conv_id, turn, similarity, status, place FROM r WHERE place <= 3""")
def text_comparisons(t: Tables):
    """The three comparisons of a conversation that differ most."""
    return O.top_per_group(QUERIES["dice_bigram_compare"](t.spark, t.sf_dir), ["conv_id"], 3, [F.col("similarity"), F.col("turn")], "turn", "place").select("conv_id", "turn", "similarity", "status", "place")

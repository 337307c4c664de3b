"""Evidence scores, identity votes, tracking geometry and job state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, intervals as I, merging as M, summaries, vector_search as R
from .base import Tables, query
from .intervals import HOUR, ev
from .search import SQL_LEDGER, _all, checks, vectors

DAY = 24 * HOUR


@query("""WITH k AS (SELECT label AS identity, embedding FROM embeddings),
s AS (SELECT vec_id, identity, max(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(k.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[]))))) AS s FROM embeddings e, k GROUP BY ALL)
SELECT vec_id, arg_max(identity, (s, -identity)) AS identity, round(max(s), 6) AS similarity FROM s GROUP BY vec_id HAVING max(s) >= 0.5""")
def gallery_match(t: Tables):
    """All vectors against all vectors of each identity, in blocks; of equal ones the smaller identity."""
    every = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = R.top_per_query(every, vectors(t), 1, ["label"], tie="label", block=16_384).filter("cosine >= 0.5")
    return s.select(F.col("query_id").alias("vec_id"), F.col("label").alias("identity"), F.round("cosine", 6).alias("similarity"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 3600000000 AS cell, minute(ts) / 60 AS m FROM events)
SELECT b.event_id, arg_min(p.event_id, (sqrt(power((b.value - p.value) / 100, 2) + power(b.m - p.m, 2)), p.event_id)) AS nearest, round(min(sqrt(power((b.value - p.value) / 100, 2) + power(b.m - p.m, 2))), 6) AS distance
FROM e b JOIN e p ON b.user_id = p.user_id AND b.cell = p.cell AND b.event_type = 'purchase' AND p.event_type <> 'purchase' GROUP BY b.event_id""")
def spatial_nearest(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", "value", F.floor(I.micros(F.col("ts")) / HOUR).alias("cell"), (F.minute("ts") / 60).alias("m"))
    b = e.filter("event_type = 'purchase'")
    p = e.filter("event_type <> 'purchase'").select("user_id", "cell", F.col("event_id").alias("p_id"), F.col("value").alias("p_value"), F.col("m").alias("p_m"))
    d = F.sqrt(F.pow((F.col("value") - F.col("p_value")) / 100, 2) + F.pow(F.col("m") - F.col("p_m"), 2))
    g = b.join(p, ["user_id", "cell"]).groupBy("event_id").agg(F.min(F.struct(d.alias("d"), "p_id")).alias("b"))
    return g.select("event_id", F.col("b.p_id").alias("nearest"), F.round("b.d", 6).alias("distance"))


@query("""SELECT event_id, CASE WHEN cy < 0.24 THEN 'top' WHEN cy > 0.76 THEN 'bottom' WHEN cx < 0.2 THEN 'left' WHEN cx > 0.8 THEN 'right' ELSE 'middle' END AS region, CASE WHEN cy > 0.76 AND value > 40 THEN 'subtitle' WHEN cy < 0.24 AND value < 20 THEN 'watermark' WHEN cx < 0.2 OR cx > 0.8 THEN 'overlay' ELSE 'screen_text' END AS role
FROM (SELECT event_id, value, hour(ts) / 24 AS cx, minute(ts) / 60 AS cy FROM events)""")
def region_and_role(t: Tables):
    e = t.events.select("event_id", "value", (F.hour("ts") / 24).alias("cx"), (F.minute("ts") / 60).alias("cy"))
    region = F.when(F.col("cy") < 0.24, "top").when(F.col("cy") > 0.76, "bottom").when(F.col("cx") < 0.2, "left").when(F.col("cx") > 0.8, "right").otherwise("middle")
    role = F.when((F.col("cy") > 0.76) & (F.col("value") > 40), "subtitle").when((F.col("cy") < 0.24) & (F.col("value") < 20), "watermark").when((F.col("cx") < 0.2) | (F.col("cx") > 0.8), "overlay").otherwise("screen_text")
    return e.select("event_id", region.alias("region"), role.alias("role"))


@query("""WITH p AS (SELECT event_id, hour(ts) / 24 AS x, minute(ts) / 60 AS y FROM events), q AS (SELECT event_id, 0.1 * x + 0.02 * y + 1.0 AS w, 0.9 * x + 0.05 * y + 0.02 AS a, 0.03 * x + 0.88 * y + 0.04 AS b FROM p)
SELECT event_id, round(least(1, greatest(0, a / w)), 6) AS field_x, round(least(1, greatest(0, b / w)), 6) AS field_y FROM q""", field_x="DOUBLE", field_y="DOUBLE")
def homography_projection(t: Tables):
    x, y = F.hour("ts") / 24, F.minute("ts") / 60
    w = 0.1 * x + 0.02 * y + 1.0
    unit = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 6)
    return t.events.select("event_id", unit((0.9 * x + 0.05 * y + 0.02) / w).alias("field_x"), unit((0.03 * x + 0.88 * y + 0.04) / w).alias("field_y"))


@query(f"""SELECT doc_id, CASE WHEN hard + soft < 3 THEN least(44, s) WHEN soft > 0 AND c_safe = 'weak' THEN least(60, s) WHEN soft > 0 THEN least(74, s) ELSE least(100, s) END AS score,
CASE WHEN hard = 3 AND s >= 75 THEN 'verified' WHEN hard >= 2 THEN 'strong' WHEN hard + soft = 3 THEN 'tentative' ELSE 'rejected' END AS tier FROM (SELECT *, 35 + 14 * hard + 9 * soft - 28 * (3 - hard - soft) AS s FROM {SQL_LEDGER})""")
def analysis_moment_tiers(t: Tables):
    c = checks(t).select("doc_id", "c_safe", _all("trusted").alias("hard"), _all("weak").alias("soft"))
    c = c.withColumn("s", (35 + 14 * F.col("hard") + 9 * F.col("soft") - 28 * (3 - F.col("hard") - F.col("soft"))))
    most = lambda n: F.least(F.lit(n), F.col("s"))
    score = F.when(F.col("hard") + F.col("soft") < 3, most(44)).when((F.col("soft") > 0) & (F.col("c_safe") == "weak"), most(60)).when(F.col("soft") > 0, most(74)).otherwise(most(100))
    tier = F.when((F.col("hard") == 3) & (F.col("s") >= 75), "verified").when(F.col("hard") >= 2, "strong").when(F.col("hard") + F.col("soft") == 3, "tentative").otherwise("rejected")
    return c.select("doc_id", score.alias("score"), tier.alias("tier"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, round(20 * count(DISTINCT event_type) + 0.5 * count(*) + sum(CASE event_type WHEN 'purchase' THEN 0.75 WHEN 'click' THEN 0.65 ELSE 0.1 END) + avg(value) / 100
+ greatest(0, 0.6 - 0.03 * date_diff('day', CAST(max(ts) AS DATE), CAST(max(now) AS DATE))), 4) AS score FROM events, n GROUP BY user_id""", score="DOUBLE")
def asset_inventory_score(t: Tables):
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    w = F.when(F.col("event_type") == "purchase", 0.75).when(F.col("event_type") == "click", 0.65).otherwise(0.1)
    recent = F.greatest(F.lit(0.0), 0.6 - 0.03 * F.date_diff(F.max("now").cast("date"), F.max("ts").cast("date")))
    g = t.events.crossJoin(F.broadcast(now)).groupBy("user_id")
    return g.agg(F.round(20 * F.count_distinct("event_type") + 0.5 * F.count("*") + F.sum(w) + F.avg("value") / 100 + recent, 4).alias("score"))


@query("""SELECT o_orderkey, CAST(o_custkey IS NOT NULL AS INT) + CAST(o_orderstatus <> 'O' AS INT) + CAST(o_totalprice > 50000 AS INT) + CAST(o_orderpriority NOT LIKE '5%' AS INT) AS present, 100 * CAST(o_totalprice > 50000 AS INT) + 4 * (o_custkey % 3) AS group_score FROM orders""")
def provider_completeness(t: Tables):
    yes = lambda c: F.expr(c).cast("int")
    present = yes("o_custkey is not null") + yes("o_orderstatus <> 'O'") + yes("o_totalprice > 50000") + yes("o_orderpriority not like '5%'")
    return t.orders.select("o_orderkey", present.alias("present"), (100 * yes("o_totalprice > 50000") + 4 * (F.col("o_custkey") % 3)).alias("group_score"))


@query("""WITH d AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, count(*) AS days, least(1, count(*) / 30) AS coverage, CASE WHEN count(*) >= 20 THEN 'ready' WHEN count(*) >= 5 THEN 'partial' ELSE 'missing' END AS status, max(n) AS busiest FROM d GROUP BY user_id""", coverage="DOUBLE")
def readiness_profile(t: Tables):
    d = t.events.groupBy("user_id", F.floor(I.micros(F.col("ts")) / DAY).alias("day")).agg(F.count("*").alias("n"))
    g = d.groupBy("user_id").agg(F.count("*").alias("days"), F.max("n").alias("busiest"))
    return g.select("user_id", "days", F.least(F.lit(1.0), F.col("days") / 30).alias("coverage"), F.when(F.col("days") >= 20, "ready").when(F.col("days") >= 5, "partial").otherwise("missing").alias("status"), "busiest")


@query("""WITH e AS (SELECT user_id % 10 AS cluster, user_id, (value * 7.31) % 1 AS hue, count(*) OVER (PARTITION BY user_id) AS frames, event_id FROM events), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e) WHERE r = 1),
s AS (SELECT cluster, arg_max(hue, (frames, -user_id)) AS seed FROM f GROUP BY cluster), d AS (SELECT f.*, seed, least(abs(hue - seed), 1 - abs(hue - seed)) AS d FROM f JOIN s USING (cluster)), o AS (SELECT cluster, arg_max(hue, (d, -user_id)) AS other, max(d) AS far FROM d GROUP BY cluster)
SELECT user_id, CASE WHEN far < 0.1 THEN 'one' WHEN abs(d - least(abs(hue - other), 1 - abs(hue - other))) < 0.06 THEN 'unknown' WHEN d < least(abs(hue - other), 1 - abs(hue - other)) THEN 'first' ELSE 'second' END AS kit FROM d JOIN o USING (cluster)""")
def hue_two_means(t: Tables):
    away = lambda a, b: F.least(F.abs(F.col(a) - F.col(b)), 1 - F.abs(F.col(a) - F.col(b)))
    f = t.events.groupBy("user_id").agg(F.min(F.struct("event_id", "value"))["value"].alias("v"), F.count("*").alias("frames")).select((F.col("user_id") % 10).alias("cluster"), "user_id", ((F.col("v") * 7.31) % 1).alias("hue"), "frames")
    s = f.groupBy("cluster").agg(F.max(F.struct("frames", (-F.col("user_id")).alias("u"), "hue"))["hue"].alias("seed"))
    d = f.join(s, "cluster").withColumn("d", away("hue", "seed"))
    o = d.groupBy("cluster").agg(F.max(F.struct("d", (-F.col("user_id")).alias("u"), "hue"))["hue"].alias("other"), F.max("d").alias("far"))
    x = d.join(o, "cluster").withColumn("e", away("hue", "other"))
    return x.select("user_id", F.when(F.col("far") < 0.1, "one").when(F.abs(F.col("d") - F.col("e")) < 0.06, "unknown").when(F.col("d") < F.col("e"), "first").otherwise("second").alias("kit"))


@query("""WITH s AS (SELECT user_id % 40 AS job, event_type AS stage, min(epoch_us(ts)) AS started, max(epoch_us(ts)) AS ended, count(*) AS attempts FROM events GROUP BY ALL), o(stage, ord) AS (VALUES ('signup', 0), ('view', 1), ('click', 2), ('purchase', 3), ('error', 4)),
f AS (SELECT s.job, min(ord) AS redo FROM s JOIN o USING (stage) WHERE attempts % 3 = 0 GROUP BY s.job) SELECT s.job, s.stage, attempts, CASE WHEN redo IS NOT NULL AND ord >= redo THEN 'run' ELSE 'skip' END AS decision, ended - started AS took FROM s JOIN o USING (stage) LEFT JOIN f ON f.job = s.job""")
def stage_run_decision(t: Tables):
    """A failed stage and all that depend on it run again; the rest are skipped."""
    names = F.array(*[F.lit(x) for x in ("signup", "view", "click", "purchase", "error")])
    s = ev(t).groupBy((F.col("user_id") % 40).alias("job"), F.col("event_type").alias("stage")).agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("attempts"))
    s = s.withColumn("ord", F.array_position(names, F.col("stage")))
    f = s.filter("attempts % 3 = 0").groupBy("job").agg(F.min("ord").alias("redo"))
    return s.join(f, "job", "left").select("job", "stage", "attempts", F.when(F.col("ord") >= F.col("redo"), "run").otherwise("skip").alias("decision"), (F.col("ended") - F.col("started")).alias("took"))


@query("""SELECT event_id, CASE WHEN attempts >= 5 THEN 'dead' WHEN ok THEN 'published' ELSE 'pending' END AS status, CASE WHEN NOT ok AND attempts < 5 THEN least(60000, 5000 * CAST(power(2, attempts - 1) AS BIGINT)) END AS wait_ms FROM (SELECT event_id, 1 + event_id % 6 AS attempts, value >= 30 AS ok FROM events WHERE event_type IN ('error', 'purchase'))""")
def delivery_retry(t: Tables):
    e = t.events.filter("event_type in ('error', 'purchase')").select("event_id", (1 + F.col("event_id") % 6).alias("attempts"), (F.col("value") >= 30).alias("ok"))
    wait = F.least(F.lit(60_000), 5000 * F.pow(F.lit(2), F.col("attempts") - 1).cast("long"))
    return e.select("event_id", F.when(F.col("attempts") >= 5, "dead").when(F.col("ok"), "published").otherwise("pending").alias("status"), F.when(~F.col("ok") & (F.col("attempts") < 5), wait).alias("wait_ms"))


@query("""WITH c AS (SELECT o_custkey % 100 AS context, o_orderpriority AS status, o_totalprice AS conf, o_orderkey FROM orders) SELECT context, arg_max(o_orderkey, (conf, -o_orderkey)) AS best, round(max(conf), 2) AS confidence, min(status) AS status, array_to_string(list_sort(list(DISTINCT status))[1:12], '|') AS evidence FROM c GROUP BY context""")
def context_merge(t: Tables):
    c = t.orders.select((F.col("o_custkey") % 100).alias("context"), "o_orderpriority", "o_totalprice", "o_orderkey")
    g = c.groupBy("context").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"), F.min("o_orderpriority").alias("status"), F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 12).alias("e"))
    return g.select("context", (-F.col("b.k")).alias("best"), F.round("b.o_totalprice", 2).alias("confidence"), "status", F.array_join("e", "|").alias("evidence"))


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 6 AND l_returnflag = 'A') UNION ALL SELECT -1 - p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def unreferenced_rows(t: Tables):
    s = M.without(t.supplier.select("s_suppkey"), t.lineitem.filter("l_quantity > 49 and l_linenumber = 6 and l_returnflag = 'A'").select(F.col("l_suppkey").alias("s_suppkey")), ["s_suppkey"])
    p = M.without(t.part.select("p_partkey"), t.lineitem.select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])
    return s.union(p.select(-1 - F.col("p_partkey")))


@query("""WITH m AS (SELECT o_custkey AS player, o_orderkey AS segment, o_totalprice AS score FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY score DESC, segment) AS r FROM m) SELECT player, segment, r = 1 AS covers FROM b ORDER BY r > 1, score DESC, segment""")
def player_cover_selection(t: Tables):
    m = t.orders.select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("segment"), F.col("o_totalprice").alias("score"))
    best = m.groupBy("player").agg(F.max(F.struct("score", (-F.col("segment")).alias("s")))["s"].alias("s")).select((-F.col("s")).alias("segment"), F.lit(True).alias("best"))
    b = m.join(best, "segment", "left").withColumn("covers", F.coalesce("best", F.lit(False)))
    return b.orderBy(F.col("covers").desc(), F.col("score").desc(), "segment").select("player", "segment", "covers")


@query(r"""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS h, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
k AS (SELECT source, r, [struct_pack(i := doc_id, n := n_chars, h := h)] AS kept FROM d WHERE r = 1
  UNION ALL SELECT d.source, d.r, CASE WHEN list_sum(list_transform(kept, lambda y: y.n)) + d.n_chars > 30000 OR len(list_filter(kept, lambda y: y.h <> '' AND d.h <> '' AND (contains(y.h, d.h) OR contains(d.h, y.h)))) > 0 THEN kept ELSE list_append(kept, struct_pack(i := d.doc_id, n := d.n_chars, h := d.h)) END
  FROM k JOIN d ON d.source IS NOT DISTINCT FROM k.source AND d.r = k.r + 1),
e AS (SELECT source, arg_max(kept, r) AS kept FROM k GROUP BY source)
SELECT source, len(kept) AS picked, list_sum(list_transform(kept, lambda y: y.n)) AS chars, array_to_string(list_transform(kept, lambda y: CAST(y.i AS VARCHAR)), ',') AS ids FROM e""", chars="BIGINT")
def extractive_summary_greedy(t: Tables):
    """Of a source's texts, the longest first, those that don't hold and aren't held in one already picked and still fit in 30 000 characters."""
    k = summaries.distinct_texts(t.documents, "source", "doc_id", "n_chars", "text", 30_000)
    return k.select("source", F.size("kept").cast("long").alias("picked"), F.col("total").alias("chars"), F.array_join(F.transform("kept", lambda y: y["i"].cast("string")), ",").alias("ids"))


NORM_OF = "CASE WHEN list_dot_product({0}, {0}) = 0 THEN 1 ELSE sqrt(list_dot_product({0}, {0})) END"


@query(f"""WITH RECURSIVE a AS (SELECT coalesce(source, '') AS asset, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
u AS (SELECT asset, vec_id, list_transform(v, lambda x: x / {NORM_OF.format("v")}) AS v, row_number() OVER (PARTITION BY asset ORDER BY vec_id) AS r FROM a),
k AS (SELECT asset, r, [v] AS sums, [1] AS of FROM u WHERE r = 1 UNION ALL
  SELECT asset, r, CASE WHEN s >= 0.5 THEN list_concat(sums[1:b - 1], [list_transform(range(1, len(v) + 1), lambda i: sums[b][i] + v[i])], sums[b + 1:]) ELSE list_append(sums, v) END, list_append(of, CASE WHEN s >= 0.5 THEN b ELSE len(sums) + 1 END)
  FROM (SELECT *, list_max(sims) AS s, list_position(sims, list_max(sims)) AS b FROM (SELECT u.asset, u.r, u.v, sums, of, list_transform(sums, lambda x: list_dot_product(u.v, x) / {NORM_OF.format("x")}) AS sims FROM k JOIN u ON u.asset = k.asset AND u.r = k.r + 1))),
e AS (SELECT asset, arg_max(sums, r) AS sums, arg_max(of, r) AS of FROM k GROUP BY asset)
SELECT u.asset, vec_id, CAST(of[r] - 1 AS BIGINT) AS cluster, round(list_dot_product(v, sums[of[r]]) / {NORM_OF.format("sums[of[r]]")}, 6) AS similarity FROM u JOIN e ON e.asset = u.asset""")
def leader_clustering(t: Tables):
    """Assets are the documents' sources; vectors without a document are one more, with an empty name."""
    source = t.documents.select(F.col("doc_id").alias("vec_id"), "source")
    e = t.embeddings.join(source, "vec_id", "left").select(F.coalesce("source", F.lit("")).alias("asset"), "vec_id", "embedding")
    return clusters.leader_clusters(e, "asset", "vec_id", "embedding", 0.5).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // {HOUR} AS hour, value AS p, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // {HOUR}, value, event_id) AS r FROM events),
k AS (SELECT user_id, event_id, r, hour, [p] AS last, [1] AS used, 1 AS i FROM e WHERE r = 1 UNION ALL
  SELECT user_id, event_id, r, hour, list_concat(last[1:j - 1], [p], last[j + 1:]), list_append(used, j), j FROM (SELECT *, coalesce(free.i, len(last) + 1) AS j FROM (
    SELECT *, list_min(list_transform(list_filter(range(1, len(last) + 1), lambda i: NOT list_contains(used, i) AND abs(p - last[i]) <= 18), lambda i: struct_pack(d := abs(p - last[i]), i := i))) AS free FROM (
      SELECT e.*, last, CASE WHEN e.hour = k.hour THEN used ELSE [] END AS used FROM k JOIN e ON e.user_id = k.user_id AND e.r = k.r + 1))))
SELECT user_id, event_id, CAST(i - 1 AS BIGINT) AS track FROM k""")
def greedy_track_assignment(t: Tables):
    """A user is a group, an hour a frame."""
    e = ev(t).select("user_id", "event_id", F.floor(F.col("at") / HOUR).alias("hour"), "value")
    return clusters.greedy_tracks(e, "user_id", "event_id", "hour", "value", 18.0)

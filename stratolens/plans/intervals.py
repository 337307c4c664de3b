"""Timelines: windows, overlaps, nearest rows, sessions, tracks and jobs. `events` are points of a user's timeline."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import intervals as I, ordered as O
from .base import Tables, query

S, MIN, HOUR = 1_000_000, 60_000_000, 3_600_000_000
EV = "(SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS t_at FROM events)"


ORDER = ["at", "event_id"]


def ev(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", "value", "props", I.micros(F.col("ts")).alias("at"))


def beside(t: Tables, **columns):
    """Events with columns of the user's event before or after."""
    return O.neighbours(ev(t).withColumn("day", F.floor(F.col("at") / (24 * HOUR))), ["user_id"], "day", ORDER, **columns)


SQL_LEAD = f"(SELECT event_id, user_id, event_type, t_at AS start, lead(t_at) OVER (PARTITION BY user_id ORDER BY t_at, event_id) AS \"end\" FROM {EV})"


def leads(t: Tables):
    return beside(t, end=("at", 1)).select("event_id", "user_id", "event_type", F.col("at").alias("start"), "end")


@query(f'SELECT event_id, user_id, start, "end", "end" - start AS length FROM {SQL_LEAD} WHERE "end" IS NOT NULL')
def shot_windows(t: Tables):
    return leads(t).filter("end is not null").select("event_id", "user_id", "start", "end", (F.col("end") - F.col("start")).alias("length"))


SQL_ISLANDS = f"""(WITH p AS (SELECT user_id, t_at - {15 * MIN} AS start, t_at + {15 * MIN} AS "end" FROM {EV}),
r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + {5 * MIN} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM n GROUP BY user_id, island)"""


def islands(t: Tables):
    padded = ev(t).select("user_id", (F.col("at") - 15 * MIN).alias("start"), (F.col("at") + 15 * MIN).alias("end"))
    return I.coalesced(padded, ["user_id"], 5 * MIN)


@query(f"SELECT * FROM {SQL_ISLANDS}")
def gap_coalesce_sessions(t: Tables):
    return islands(t)


@query(f"""SELECT user_id, before AS start, start AS "end" FROM (SELECT user_id, start, lag("end") OVER (PARTITION BY user_id ORDER BY start) AS before FROM {SQL_ISLANDS}) WHERE start - before >= {HOUR}""")
def interval_complement(t: Tables):
    gaps = O.neighbours(islands(t).withColumn("day", F.floor(F.col("start") / (24 * HOUR))), ["user_id"], "day", ["start"], before=("end", -1))
    return gaps.filter(F.col("start") - F.col("before") >= HOUR).select("user_id", F.col("before").alias("start"), F.col("start").alias("end"))


@query(f"""WITH l AS (SELECT *, greatest(1, CAST(ceil(("end" - start) / {6 * HOUR}) AS BIGINT)) AS parts FROM {SQL_LEAD} WHERE "end" IS NOT NULL), x AS (SELECT *, unnest(range(parts)) AS part FROM l)
SELECT event_id, user_id, event_type, part, start + CAST(floor(part * (("end" - start) / parts)) AS BIGINT) AS start, start + CAST(floor((part + 1) * (("end" - start) / parts)) AS BIGINT) AS "end" FROM x""")
def split_long_windows(t: Tables):
    return I.split(leads(t).filter("end is not null"), 6 * HOUR)


SQL_LEFT = f"(SELECT event_id, user_id, t_at AS start, t_at + {HOUR} AS \"end\" FROM {EV} WHERE event_type = 'purchase')"
SQL_RIGHT = f"(SELECT event_id AS r_id, event_type, user_id, t_at AS r_start, t_at + {HOUR // 2} AS r_end FROM {EV} WHERE event_type IN ('view', 'click'))"
SQL_OVER = f'(SELECT l.*, r_id, event_type, r_start, least("end", r_end) - greatest(start, r_start) AS overlap FROM {SQL_LEFT} l JOIN {SQL_RIGHT} r ON l.user_id = r.user_id AND r_end > start AND r_start < "end")'


def purchases(t: Tables):
    return ev(t).filter("event_type = 'purchase'").select("event_id", "user_id", F.col("at").alias("start"), (F.col("at") + HOUR).alias("end"))


def overlaps(t: Tables):
    seen = ev(t).filter("event_type in ('view', 'click')").select(F.col("event_id").alias("r_id"), "event_type", "user_id", F.col("at").alias("r_start"), (F.col("at") + HOUR // 2).alias("r_end"))
    return I.overlap_join(purchases(t), seen, ["user_id"], HOUR)


@query(f"SELECT event_id, count(*) AS n, sum(overlap) AS overlap, string_agg(CAST(r_id AS VARCHAR), ',' ORDER BY r_start, r_id) AS ids FROM {SQL_OVER} GROUP BY event_id", overlap="BIGINT")
def interval_overlap_agg(t: Tables):
    g = overlaps(t).groupBy("event_id").agg(F.count("*").alias("n"), F.sum("overlap").alias("overlap"), F.array_sort(F.collect_list(F.struct("r_start", "r_id"))).alias("r"))
    return g.select("event_id", "n", "overlap", F.array_join(F.transform("r", lambda x: x["r_id"].cast("string")), ",").alias("ids"))


@query(f"""SELECT l.event_id, coalesce(b.event_type, 'unknown') AS best_type, coalesce(b.overlap, 0) AS overlap FROM {SQL_LEFT} l LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap DESC, r_start, r_id) AS r FROM {SQL_OVER}) b ON b.event_id = l.event_id AND r = 1""")
def best_overlap_join(t: Tables):
    best = overlaps(t).groupBy("event_id").agg(F.max(F.struct("overlap", (-F.col("r_start")).alias("s"), (-F.col("r_id")).alias("i"), "event_type")).alias("b"))
    return purchases(t).select("event_id").join(best, "event_id", "left").select("event_id", F.coalesce("b.event_type", F.lit("unknown")).alias("best_type"), F.coalesce("b.overlap", F.lit(0)).alias("overlap"))


SQL_CLICKS = f"(SELECT event_id AS r_id, user_id, t_at AS r_at FROM {EV} WHERE event_type = 'click')"
SQL_BUYS = f"(SELECT event_id, user_id, t_at FROM {EV} WHERE event_type = 'purchase')"


@query(f"""SELECT p.event_id, b.r_id AS click_id, abs(p.t_at - b.r_at) AS gap FROM {SQL_BUYS} p LEFT JOIN (SELECT p.event_id, r_id, r_at, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(t_at - r_at), r_at, r_id) AS r
FROM {SQL_BUYS} p JOIN {SQL_CLICKS} c ON p.user_id = c.user_id AND abs(t_at - r_at) <= {2 * HOUR}) b ON b.event_id = p.event_id AND r = 1""")
def asof_nearest_tolerance(t: Tables):
    buys = ev(t).filter("event_type = 'purchase'").select("event_id", "user_id", "at")
    clicks = ev(t).filter("event_type = 'click'").select(F.col("event_id").alias("r_id"), "user_id", F.col("at").alias("r_at"))
    return I.nearest(buys, clicks, ["user_id"], 2 * HOUR, "r_id").select("event_id", F.col("r_id").alias("click_id"), "gap")


@query(f"""WITH w AS (SELECT event_id, user_id, start - {3 * MIN} AS a, "end" + {3 * MIN} AS z FROM {SQL_LEFT}), c AS (SELECT w.event_id, e.event_id AS spot_id, round(e.value, 6) AS value,
row_number() OVER (PARTITION BY w.event_id ORDER BY e.value DESC, e.event_id) AS rank FROM w JOIN {EV} e ON e.user_id = w.user_id AND e.t_at BETWEEN a AND z AND e.event_type <> 'purchase') SELECT * FROM c WHERE rank <= 3""")
def point_in_interval_top3(t: Tables):
    wide = purchases(t).select("event_id", "user_id", (F.col("start") - 3 * MIN).alias("start"), (F.col("end") + 3 * MIN + 1).alias("end"))
    spots = ev(t).filter("event_type <> 'purchase'").select(F.col("event_id").alias("spot_id"), "user_id", "value", F.col("at").alias("r_start"), (F.col("at") + 1).alias("r_end"))
    rank = F.row_number().over(W.partitionBy("event_id").orderBy(F.col("value").desc(), "spot_id"))
    c = I.overlap_join(wide, spots, ["user_id"], HOUR).withColumn("rank", rank).filter("rank <= 3")
    return c.select("event_id", "spot_id", F.round("value", 6).alias("value"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH m AS (SELECT user_id, event_id, event_type, t_at, lag(t_at) OVER w AS before, lead(t_at) OVER w AS after FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY t_at, event_id))
SELECT event_id, t_at - before <= {10 * MIN} OR after - t_at <= {10 * MIN} AS near_boundary FROM m WHERE event_type = 'error'""")
def shot_boundary_proximity(t: Tables):
    m = beside(t, before=("at", -1), after=("at", 1)).filter("event_type = 'error'")
    return m.select("event_id", ((F.col("at") - F.col("before") <= 10 * MIN) | (F.col("after") - F.col("at") <= 10 * MIN)).alias("near_boundary"))


SQL_ROSTER = f"""(SELECT user_id, min(CASE WHEN event_type = 'signup' THEN t_at END) AS start_at, max(CASE WHEN event_type = 'error' THEN t_at END) AS end_at, count(*) AS n FROM {EV} GROUP BY user_id)"""


def rosters(t: Tables):
    """From each user's first signup to their last error; either may be missing."""
    t_at = lambda kind: F.when(F.col("event_type") == kind, F.col("at"))
    return ev(t).groupBy("user_id").agg(F.min(t_at("signup")).alias("start_at"), F.max(t_at("error")).alias("end_at"), F.count("*").alias("n"))


@query(f"SELECT *, CASE WHEN start_at IS NULL THEN 'assumed' WHEN end_at IS NULL THEN 'open' ELSE 'observed' END AS reason FROM {SQL_ROSTER}")
def roster_window_fold(t: Tables):
    return rosters(t).withColumn("reason", F.when(F.col("start_at").isNull(), "assumed").when(F.col("end_at").isNull(), "open").otherwise("observed"))


@query(f"SELECT e.event_type, count(*) AS events, count(*) FILTER (t_at BETWEEN coalesce(start_at, 0) AND coalesce(end_at, {10**17})) AS valid FROM {EV} e JOIN {SQL_ROSTER} r USING (user_id) GROUP BY e.event_type")
def temporal_validity_join(t: Tables):
    j = ev(t).join(rosters(t).drop("n"), "user_id")
    inside = F.col("at").between(F.coalesce("start_at", F.lit(0)), F.coalesce("end_at", F.lit(10**17)))
    return j.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(inside).alias("valid"))


@query(f"""SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, coalesce(lag(event_type) OVER w = event_type, FALSE) AS repeats FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY t_at, event_id)""")
def neighbour_context(t: Tables):
    e = beside(t, before=("event_type", -1), after=("event_type", 1))
    return e.select("event_id", "before", "after", F.coalesce(F.col("before") == F.col("event_type"), F.lit(False)).alias("repeats"))


@query(f"""WITH m AS (SELECT user_id, arg_min(value, (t_at, event_id)) AS a, arg_max(value, (t_at, event_id)) AS z, max(t_at) - min(t_at) AS took, count(*) AS n, avg(value) AS mean FROM {EV} GROUP BY user_id)
SELECT user_id, n, round(z - a, 6) AS moved, round((z - a) / greatest(1, took / {HOUR}), 6) AS speed, CASE WHEN abs(z - a) < 0.025 THEN 'still' WHEN z > a THEN 'up' ELSE 'down' END AS direction, round(mean, 6) AS mean FROM m""")
def first_last_displacement(t: Tables):
    m = ev(t).groupBy("user_id").agg(
        F.min(F.struct("at", "event_id", "value"))["value"].alias("a"), F.max(F.struct("at", "event_id", "value"))["value"].alias("z"), (F.max("at") - F.min("at")).alias("took"), F.count("*").alias("n"), F.avg("value").alias("mean")
    )
    moved = F.col("z") - F.col("a")
    way = F.when(F.abs(moved) < 0.025, "still").when(moved > 0, "up").otherwise("down")
    return m.select("user_id", "n", F.round(moved, 6).alias("moved"), F.round(moved / F.greatest(F.lit(1.0), F.col("took") / HOUR), 6).alias("speed"), way.alias("direction"), F.round("mean", 6).alias("mean"))


SQL_ZONE = "CASE WHEN hour(ts) < 8 THEN 'defensive' WHEN hour(ts) < 16 THEN 'middle' ELSE 'attacking' END"


def zones(t: Tables):
    return t.events.select("user_id", F.when(F.hour("ts") < 8, "defensive").when(F.hour("ts") < 16, "middle").otherwise("attacking").alias("zone"))


@query(f"SELECT user_id, zone, n, round(n / sum(n) OVER (PARTITION BY user_id), 3) AS share FROM (SELECT user_id, {SQL_ZONE} AS zone, count(*) AS n FROM events GROUP BY ALL)")
def occupancy_histogram(t: Tables):
    n = zones(t).groupBy("user_id", "zone").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("user_id")), 3))


@query(f"SELECT user_id, arg_min(zone, (-n, zone)) AS mode_zone, max(n) AS n FROM (SELECT user_id, {SQL_ZONE} AS zone, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def mode_value(t: Tables):
    n = zones(t).groupBy("user_id", "zone").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "zone"))["zone"].alias("mode_zone"), F.max("n").alias("n"))


@query(f"""WITH m AS (SELECT user_id, median(value) / 200 AS m FROM events GROUP BY user_id) SELECT user_id, round(m, 6) AS median, m <= 0.22 AS near, round(least(0.86, greatest(0, 0.82 - m)), 6) AS confidence FROM m""")
def median_proximity(t: Tables):
    m = t.events.groupBy("user_id").agg((F.median("value") / 200).alias("m"))
    return m.select("user_id", F.round("m", 6).alias("median"), (F.col("m") <= 0.22).alias("near"), F.round(F.least(F.lit(0.86), F.greatest(F.lit(0.0), 0.82 - F.col("m"))), 6).alias("confidence"))


@query("SELECT event_type, count(value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY event_type")
def numeric_summary(t: Tables):
    r = lambda f: F.round(f("value"), 6)
    return t.events.groupBy("event_type").agg(F.count("value").alias("n"), r(F.min).alias("low"), r(F.max).alias("high"), r(F.avg).alias("mean"), r(F.median).alias("median"))


@query("""WITH a AS (SELECT event_type, value AS w, 2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440 AS x FROM events), s AS (SELECT event_type, sum(w * sin(x)) AS s, sum(w * cos(x)) AS c, sum(w) AS w FROM a GROUP BY event_type)
SELECT event_type, round(((atan2(s, c) / (2 * pi()) + 1) - floor(atan2(s, c) / (2 * pi()) + 1)) * 24, 4) AS mean_hour, round(sqrt(s * s + c * c) / w, 6) AS strength FROM s""")
def circular_mean(t: Tables):
    x = 2 * F.pi() * (F.hour("ts") * 60 + F.minute("ts")) / 1440
    s = t.events.groupBy("event_type").agg(F.sum(F.col("value") * F.sin(x)).alias("s"), F.sum(F.col("value") * F.cos(x)).alias("c"), F.sum("value").alias("w"))
    turn = F.atan2("s", "c") / (2 * F.pi()) + 1
    return s.select("event_type", F.round((turn - F.floor(turn)) * 24, 4).alias("mean_hour"), F.round(F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) / F.col("w"), 6).alias("strength"))


SQL_LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t_at DESC, event_id DESC) AS back FROM {EV}) WHERE back <= 250)"


def last_250(t: Tables):
    return O.top_per_group(ev(t), ["event_type"], 250, [F.col("at").desc(), F.col("event_id").desc()], "event_id", "back")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM {SQL_LAST})
SELECT event_type, max(n) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(max(CASE WHEN r = CAST(ceil(0.95 * n) AS BIGINT) THEN value END), 6) AS p95, round(max(CASE WHEN back = 1 THEN value END), 6) AS last FROM r GROUP BY event_type""")
def latency_p95_last250(t: Tables):
    by = W.partitionBy("event_type")
    r = last_250(t).withColumn("r", F.row_number().over(by.orderBy("value", "event_id"))).withColumn("n", F.count("*").over(by))
    t_at = lambda c: F.round(F.max(F.when(c, F.col("value"))), 6)
    return r.groupBy("event_type").agg(F.max("n").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), t_at(F.col("r") == F.ceil(0.95 * F.col("n"))).alias("p95"), t_at(F.col("back") == 1).alias("last"))


@query(f"SELECT event_id, event_type, back FROM {SQL_LAST}")
def rolling_window_250(t: Tables):
    return last_250(t).select("event_id", "event_type", F.col("back").cast("long").alias("back"))


@query(f"SELECT event_id, event_type FROM {EV} ORDER BY t_at DESC, event_id DESC LIMIT 80")
def latest_events(t: Tables):
    return ev(t).orderBy(F.col("at").desc(), F.col("event_id").desc()).limit(80).select("event_id", "event_type")


@query(f"""SELECT event_id, user_id, round(max(value) OVER (PARTITION BY user_id ORDER BY t_at, event_id ROWS UNBOUNDED PRECEDING), 6) AS progress FROM {EV}""")
def running_max_progress(t: Tables):
    e = O.running(ev(t).withColumn("day", F.floor(F.col("at") / (24 * HOUR))), ["user_id"], "day", ORDER, "best", "value")
    return e.select("event_id", "user_id", F.round("best", 6).alias("progress"))


@query(f"""WITH s AS (SELECT user_id, arg_max(event_type, (t_at, event_id)) AS status, max(t_at) AS t_at, user_id % 7 AS stage FROM {EV} GROUP BY user_id)
SELECT stage, arg_min(user_id, (CASE status WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, user_id)) AS resume_user, min(CASE status WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END) AS precedence FROM s GROUP BY stage""")
def resume_stage(t: Tables):
    last = ev(t).groupBy("user_id").agg(F.max(F.struct("at", "event_id", "event_type"))["event_type"].alias("status"))
    order = F.when(F.col("status") == "click", 0).when(F.col("status") == "error", 1).otherwise(2)
    best = last.groupBy((F.col("user_id") % 7).alias("stage")).agg(F.min(F.struct(order.alias("o"), "user_id")).alias("b"))
    return best.select("stage", F.col("b.user_id").alias("resume_user"), F.col("b.o").alias("precedence"))


SQL_OUTBOX = f"(SELECT event_id, t_at, 1 + event_id % 5 AS attempts, t_at + least(60000, 1000 * CAST(power(2, event_id % 5) AS BIGINT)) * 1000 AS due_at FROM {EV} WHERE event_type = 'error')"


@query(f"SELECT event_id, attempts, due_at FROM {SQL_OUTBOX} WHERE due_at <= (SELECT max(t_at) FROM {EV}) ORDER BY due_at, event_id LIMIT 100")
def outbox_due_poll(t: Tables):
    now = ev(t).agg(F.max("at").alias("now"))  # one row
    wait = F.least(F.lit(60_000), 1000 * F.pow(F.lit(2), F.col("event_id") % 5).cast("long"))
    due = ev(t).filter("event_type = 'error'").select("event_id", (1 + F.col("event_id") % 5).alias("attempts"), (F.col("at") + wait * 1000).alias("due_at"))
    return due.crossJoin(F.broadcast(now)).filter("due_at <= now").orderBy("due_at", "event_id").limit(100).drop("now")


SQL_POINTS = f"(SELECT user_id, list_sort(list(t_at)) AS points FROM {EV} GROUP BY ALL)"


@query(f"""WITH k AS (SELECT user_id, list_reduce(list_transform(points, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= {2 * HOUR} THEN list_concat(a, x) ELSE a END) AS kept FROM {SQL_POINTS})
SELECT user_id, len(kept) AS n, kept[len(kept)] AS last FROM k""")
def min_gap_thinning(t: Tables):
    """The state is the number of points kept and the last of them."""
    gap = 2 * HOUR
    return I.carried(ev(t), "user_id", "at", lambda x: (1, x), lambda s, x: (s[0] + 1, x) if x - s[1] >= gap else s, lambda s: s, "n last")


@query(f"""WITH r AS (SELECT user_id, list_reduce(list_transform(points, lambda x: [[x, 1]]), lambda a, x: CASE WHEN x[1][1] - a[len(a)][1] >= {HOUR} THEN list_concat(a, x) ELSE list_concat(a[1:len(a) - 1], [[a[len(a)][1], a[len(a)][2] + 1]]) END) AS w FROM {SQL_POINTS})
SELECT user_id, len(w) AS windows, list_sum(list_transform(w, lambda x: greatest(0, x[2] - 2))) AS rejected FROM r""", rejected="BIGINT")
def fixed_window_counter(t: Tables):
    """The state is the windows so far, the points rejected, and the open window's begin and count."""
    long = HOUR
    step = lambda s, x: (s[0] + 1, s[1], x, 1) if x - s[2] >= long else (s[0], s[1] + (s[3] >= 2), s[2], s[3] + 1)
    return I.carried(ev(t), "user_id", "at", lambda x: (1, 0, x, 1), step, lambda s: s[:2], "windows rejected")


@query(f"SELECT user_id, round(avg(d), 6) AS mean_change, round(max(d), 6) AS most FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t_at, event_id)) AS d FROM {EV}) GROUP BY user_id")
def frame_motion_avg_diff(t: Tables):
    d = beside(t, before=("value", -1)).select("user_id", F.abs(F.col("value") - F.col("before")).alias("d"))
    return d.groupBy("user_id").agg(F.round(F.avg("d"), 6).alias("mean_change"), F.round(F.max("d"), 6).alias("most"))


SQL_PATTERN = f"""(SELECT unnest([struct_pack(feature := 'type', value := event_type), struct_pack(feature := 'zone', value := {SQL_ZONE}), struct_pack(feature := 'k', value := json_extract_string(props, '$.k'))]) AS f, value AS v FROM events)"""


@query(f"SELECT f.feature AS feature, f.value AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share, round(avg(v), 6) AS mean FROM {SQL_PATTERN} GROUP BY ALL ORDER BY n DESC, feature, value LIMIT 8")
def pattern_groups_share(t: Tables):
    zone = F.when(F.hour("ts") < 8, "defensive").when(F.hour("ts") < 16, "middle").otherwise("attacking")
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in (("type", F.col("event_type")), ("zone", zone), ("k", F.get_json_object("props", "$.k")))])
    g = t.events.select(F.explode(pairs).alias("f"), F.col("value").alias("v")).groupBy("f.feature", "f.value").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    total = t.events.agg(F.count("*").alias("total"))  # one row
    g = g.crossJoin(F.broadcast(total)).orderBy(F.col("n").desc(), "feature", "value").limit(8)
    return g.select("feature", "value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round("m", 6).alias("mean"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_path_scan(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k"), (k % 2 == 0).alias("even")).filter("k >= 50")

"""Texts that name clocks, seasons, jersey numbers and labels, read back. Orders, lines and parts write the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P, text as X
from .base import Tables, query

#: How an order writes a clock, by its key; a, b and q are numbers of the key.
CLOCKS = """CASE o_orderkey % 8 WHEN 0 THEN 'added 45+' || CAST(b % 9 + 1 AS STRING) || ' and 90 + 3 here' WHEN 1 THEN 'in the ' || CAST(a AS STRING) || 'th minute and later ' || CAST(b + 1 AS STRING) || ' min of it'
WHEN 2 THEN 'clock ' || CAST(a AS STRING) || ':' || lpad(CAST(b AS STRING), 2, '0') || ' shown' WHEN 3 THEN 'Q' || CAST(q AS STRING) || ' ' || CAST(a % 15 AS STRING) || ':' || lpad(CAST(b AS STRING), 2, '0') || ' then 3rd and ' || CAST(a AS STRING) || ' to go'
WHEN 4 THEN CAST(q AS STRING) || 'th quarter with 0' || CAST(a % 10 AS STRING) || ':' || lpad(CAST(b AS STRING), 2, '0') || ' left' WHEN 5 THEN CAST(q % 2 + 1 AS STRING) || ' - ' || CAST(a AS STRING) || ':' || lpad(CAST(b AS STRING), 2, '0')
WHEN 6 THEN '01:' || lpad(CAST(b AS STRING), 2, '0') || ':' || lpad(CAST(a AS STRING), 2, '0') || ',25' ELSE 'nothing to see 4 & 5' END"""
SQL_CLOCKS = f"(SELECT o_orderkey, {CLOCKS.replace('STRING', 'VARCHAR')} AS t FROM (SELECT o_orderkey, o_orderkey % 50 + 1 AS a, (o_orderkey * 7) % 60 AS b, o_orderkey % 4 + 1 AS q FROM orders))"


def clocks(t: Tables):
    return t.orders.selectExpr("o_orderkey", "o_orderkey % 50 + 1 AS a", "(o_orderkey * 7) % 60 AS b", "o_orderkey % 4 + 1 AS q").selectExpr("o_orderkey", f"{CLOCKS} AS t")


def sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"""WITH m AS (SELECT o_orderkey, list_filter(list_concat(list_concat(list_transform(range(1, len(regexp_extract_all(t, '{sql(P.ADDED)}', 1)) + 1), lambda i: CAST(regexp_extract_all(t, '{sql(P.ADDED)}', 1)[i] AS INT) + CAST(regexp_extract_all(t, '{sql(P.ADDED)}', 2)[i] AS INT)),
list_transform(regexp_extract_all(t, '{sql(P.MINUTE)}', 1), lambda x: CAST(x AS INT))), list_concat(list_transform(regexp_extract_all(t, '{sql(P.NTH_MINUTE)}', 1), lambda x: CAST(x AS INT)), list_filter(list_transform(regexp_extract_all(t, '{sql(P.CLOCK)}', 1), lambda x: CAST(x AS INT)), lambda x: x <= 59))), lambda x: x <= 130) AS m FROM {SQL_CLOCKS})
SELECT o_orderkey, array_to_string(list_transform(m, lambda x: CAST(x AS VARCHAR)), ',') AS minutes, CASE WHEN m[1] <= 45 THEN '1H' WHEN m[1] <= 90 THEN '2H' WHEN m[1] <= 105 THEN 'ET1' WHEN m[1] <= 120 THEN 'ET2' ELSE 'unknown' END AS period, round(least(130, m[1] + 4 / 60), 2) AS minute_end FROM m WHERE len(m) > 0""", minute_end="DOUBLE")
def football_clock_mapping(t: Tables):
    m = clocks(t).select("o_orderkey", P.football_minutes(F.col("t")).alias("m")).filter(F.size("m") > 0)
    first = F.element_at("m", 1)
    return m.select("o_orderkey", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("minutes"), P.football_period(first).alias("period"), F.round(F.least(F.lit(130.0), first + F.lit(4) / 60), 2).alias("minute_end"))


@query(f"""WITH c AS (SELECT o_orderkey, t, CASE WHEN o_orderkey % 8 = 3 THEN regexp_extract(t, '{sql(P.QUARTERS[0])}', 1) ELSE regexp_extract(t, '{sql(P.QUARTERS[1])}', 1) END AS q, CASE WHEN o_orderkey % 8 = 3 THEN regexp_extract(t, '{sql(P.QUARTERS[0])}', 2) ELSE regexp_extract(t, '{sql(P.QUARTERS[1])}', 2) END AS c FROM {SQL_CLOCKS}),
x AS (SELECT o_orderkey, CAST(q AS INT) AS quarter, CAST(split_part(c, ':', 1) AS INT) AS m, split_part(c, ':', 2) AS s FROM c WHERE q <> '')
SELECT o_orderkey, quarter, CAST(m AS VARCHAR) || ':' || s AS clock, round((quarter - 1) * 15 + greatest(0, 15 - m - CAST(s AS INT) / 60), 2) AS elapsed FROM x""", elapsed="DOUBLE")
def american_clock_mapping(t: Tables):
    c = clocks(t).select("o_orderkey", F.explode(P.american_clocks(F.col("t"))).alias("c")).select("o_orderkey", F.split("c", ":").alias("p"))
    n = lambda i: F.get("p", F.lit(i)).cast("int")
    return c.select("o_orderkey", n(0).alias("quarter"), F.concat(F.get("p", F.lit(1)), F.lit(":"), F.get("p", F.lit(2))).alias("clock"), P.elapsed_minute(n(0), n(1), n(2)).alias("elapsed"))


@query(f"""SELECT o_orderkey, CAST(regexp_extract(t, '{sql(P.DOWN)}', 1) AS INT) AS down, CAST(regexp_extract(t, '{sql(P.DOWN)}', 2) AS INT) AS distance FROM {SQL_CLOCKS} WHERE regexp_extract(t, '{sql(P.DOWN)}', 1) <> ''""")
def down_distance(t: Tables):
    down, distance = P.down_and_distance(F.col("t"))
    return clocks(t).select("o_orderkey", down.alias("down"), distance.alias("distance")).filter("down is not null")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 5 THEN CAST(split_part(split_part(t, ' - ', 2), ':', 1) AS DOUBLE) * 60 + CAST(split_part(t, ':', 2) AS DOUBLE) END AS game_s, CASE WHEN o_orderkey % 8 = 6 THEN 3600 + CAST(split_part(t, ':', 2) AS INT) * 60 + CAST(t[7:8] AS INT) + 0.25 END AS stamp_s FROM {SQL_CLOCKS} WHERE o_orderkey % 8 IN (5, 6)""", game_s="DOUBLE", stamp_s="DOUBLE")
def time_parsing(t: Tables):
    c = clocks(t).select("o_orderkey", F.when(F.col("t").contains(" - "), P.game_seconds(F.col("t"))).alias("game_s"), P.timestamp_seconds(F.col("t")).alias("stamp_s"))
    return c.filter("game_s is not null or stamp_s is not null")


SEASON = "CASE o_orderkey % 4 WHEN 0 THEN 'season ' || CAST(y + 20 AS STRING) || '/' || CAST(y + 21 AS STRING) || ' final' WHEN 1 THEN 'in ' || CAST(y + 20 AS STRING) || ' they' WHEN 2 THEN CAST(y + 20 AS STRING) || ' - ' || right(CAST(y + 21 AS STRING), 2) ELSE 'long ago' END"


@query(f"""WITH s AS (SELECT o_orderkey, y, {SEASON.replace('STRING', 'VARCHAR')} AS t FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders))
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(y + 20 AS VARCHAR) || '-' || CAST(y + 21 AS VARCHAR) WHEN 1 THEN CAST(y + 20 AS VARCHAR) WHEN 2 THEN CAST(y + 20 AS VARCHAR) || '-' || right(CAST(y + 21 AS VARCHAR), 2) END AS season,
CASE o_orderkey % 4 WHEN 1 THEN 0.64 WHEN 3 THEN NULL ELSE 0.8 END AS confidence, CAST(y AS VARCHAR) || '-' || right(CAST(y + 1 AS VARCHAR), 2) AS from_code, CAST(y AS VARCHAR) || '-' || right(CAST(y + 1 AS VARCHAR), 2) AS from_slash FROM s""", confidence="DOUBLE")
def season_parsing(t: Tables):
    s = t.orders.selectExpr("o_orderkey", "year(o_orderdate) AS y").selectExpr("o_orderkey", "y", f"{SEASON} AS t")
    value, is_range = P.season_of(F.col("t"))
    two = lambda d: F.expr(f"right(cast(y + {d} as string), 2)")
    slash = F.concat(F.col("y").cast("string"), F.lit("/"), (F.col("y") + 1).cast("string"))
    return s.select("o_orderkey", value.alias("season"), F.when(is_range, 0.8).when(value.isNotNull(), F.greatest(F.lit(0.35), F.lit(0.8) - 0.16)).alias("confidence"), P.season_from_code(F.concat(two(0), two(1))).alias("from_code"), P.season_from_slash(slash).alias("from_slash"))


JERSEY = "'A' || CAST(l_partkey AS STRING) || ' #' || CAST(l_suppkey % 120 AS STRING) || ' shirt ' || CAST(l_linenumber AS STRING) || ', no. ' || CAST(l_partkey % 100 AS STRING) || 'x and ' || CAST(l_suppkey % 99 AS STRING)"


@query(f"""WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {JERSEY.replace('STRING', 'VARCHAR')} AS t FROM lineitem),
n AS (SELECT *, list_filter(list_transform(list_filter(regexp_split_to_array(t, '[^A-Z0-9]+'), lambda x: regexp_full_match(x, '[0-9]{{1,2}}')), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 1 AND 99) AS jersey, list_filter(list_transform(regexp_extract_all(t, '{sql(P.SHIRT)}', 1), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 1 AND 99) AS shirt FROM j)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_transform(jersey, lambda x: CAST(x AS VARCHAR)), ',') AS jersey, array_to_string(list_transform(list_filter(list_transform(range(1, len(shirt) + 1), lambda i: CASE WHEN list_position(shirt, shirt[i]) = i THEN shirt[i] END), lambda x: x IS NOT NULL), lambda x: CAST(x AS VARCHAR)), ',') AS shirt FROM n""")
def jersey_parsing(t: Tables):
    j = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{JERSEY} AS t")
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", joined(P.jersey_numbers(F.col("t"))).alias("jersey"), joined(P.shirt_numbers(F.col("t"))).alias("shirt"))


@query("""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda x: upper(x[1]) || x[2:]), '') AS title, replace(lower(p_type), '_', ' ') AS label, p_size % 3 = 0 AS flag, CASE WHEN p_size % 2 = 0 THEN 'penalty_area' ELSE 'own_third' END AS relative_zone FROM part""")
def label_scalars(t: Tables):
    """Titles, readable labels, flags written in four ways, and thirds of the field turned round for sides that attack to the left."""
    flag = F.element_at(F.array(F.lit(" Yes"), F.lit("no"), F.lit("2")), (F.col("p_size") % 3 + 1).cast("int"))
    zone = F.when(F.col("p_size") % 4 < 2, "final_third").otherwise("own_third")
    even = F.col("p_size") % 2 == 0
    flipped = F.when(zone == "final_third", "own_third").otherwise("own_third")
    return t.part.select("p_partkey", X.title_case(F.col("p_name")).alias("title"), X.readable(F.concat(F.lit("football."), F.lower("p_type"))).alias("label"), X.boolean(flag).alias("flag"), F.when(even, "penalty_area").otherwise(flipped).alias("relative_zone"))


@query("""WITH v AS (SELECT o_orderkey, [o_orderpriority, ' ' || lower(o_orderpriority), o_orderstatus, o_orderstatus || ' ', ''] AS v FROM orders) SELECT o_orderkey, v[1] || '|' || v[3] AS spellings FROM v""")
def distinct_spelling(t: Tables):
    v = F.array("o_orderpriority", F.concat(F.lit(" "), F.lower("o_orderpriority")), "o_orderstatus", F.concat("o_orderstatus", F.lit(" ")), F.lit(""))
    return t.orders.select("o_orderkey", F.array_join(X.distinct_spellings(v), "|").alias("spellings"))


@query("""WITH o AS (SELECT o_custkey, year(o_orderdate) AS season, o_orderstatus = 'F' AS newer, arg_max(o_orderpriority, o_orderkey) AS team FROM orders GROUP BY ALL), m AS (SELECT o_custkey, season, arg_max(team, newer) AS team FROM o GROUP BY ALL)
SELECT o_custkey, string_agg(CAST(season AS VARCHAR) || '=' || team, ',' ORDER BY season) AS teams FROM m GROUP BY o_custkey""")
def season_map_merge(t: Tables):
    """Two maps of season and team a player; where both have a season, the newer one's team stays."""
    o = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("season"), (F.col("o_orderstatus") == "F").alias("newer")).agg(F.max(F.struct("o_orderkey", "o_orderpriority"))["o_orderpriority"].alias("team"))
    pair = lambda newer: F.map_from_entries(F.collect_list(F.when(F.col("newer") == newer, F.struct("season", "team"))))
    m = o.groupBy("o_custkey").agg(pair(True).alias("new"), pair(False).alias("old"))
    kept = F.map_filter("old", lambda k, v: ~F.map_contains_key("new", k))
    entries = F.array_sort(F.map_entries(F.map_concat(kept, "new")))
    return m.select("o_custkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias("teams"))


@query("""WITH n AS (SELECT split_part(p_name, ' ', -1) AS last, left(p_name, 1) AS initial, p_name, p_partkey FROM part) SELECT last, initial, min(p_name) AS kept, count(DISTINCT p_name) AS spellings, count(*) AS parts FROM n GROUP BY last, initial""")
def fuzzy_same_name(t: Tables):
    """Names with one last name and one initial are one person; both make the key, so nothing is held against everything."""
    low = F.lower("p_name")
    n = t.part.select(F.element_at(F.split(low, " "), -1).alias("last"), F.substring(low, 1, 1).alias("initial"), "p_name")
    return n.groupBy("last", "initial").agg(F.min("p_name").alias("kept"), F.count_distinct("p_name").alias("spellings"), F.count("*").alias("parts"))


RULES = (("license", ("licensed under", "license", "released under")), ("contact", ("@mail", "@")), ("secret", ("token =", "token")), ("table", (" | ", "|")))


@query(f"""WITH r AS (SELECT doc_id, [{", ".join(f"struct_pack(n := {' + '.join(f"CAST(contains(lower(text), '{x}') AS INT)" for x in terms)}, len := {len(terms[0])}, i := {-i}, rule := '{name}')" for i, (name, terms) in enumerate(RULES))}] AS r FROM documents) SELECT doc_id, list_max(r).rule AS rule, list_max(r).n AS terms FROM r WHERE list_max(r).n > 0""")
def best_ontology_rule(t: Tables):
    low = F.lower("text")
    n = F.greatest(*[sum(low.contains(x).cast("int") for x in terms) for _, terms in RULES])
    return t.documents.select("doc_id", P.best_rule(low, RULES).alias("rule"), n.alias("terms")).filter("terms > 0")


@query("""WITH c AS (SELECT conv_id, turn, trim(unnest(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.!?|/]+'))) AS x, generate_subscripts(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.!?|/]+'), 1) AS i FROM conversations),
s AS (SELECT *, length(regexp_replace(x, '[^0-9A-Za-z]', '', 'g')) AS n FROM c), k AS (SELECT *, greatest(0, 32 - abs(n - 18)) + CASE WHEN contains(x, ' ') THEN 8 ELSE 0 END AS score FROM s WHERE n >= 4 AND NOT regexp_full_match(regexp_replace(x, '[^0-9A-Za-z]', '', 'g'), '[0-9]+'))
SELECT conv_id, turn, arg_min(x, (-score, i)) AS label FROM k GROUP BY conv_id, turn""")
def best_label_clause(t: Tables):
    return t.conversations.select("conv_id", "turn", P.label_clause(F.col("text")).alias("label")).filter("label is not null")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, FALSE AS broken FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL, TRUE FROM events WHERE event_id % 3 = 0""")
def json_extraction(t: Tables):
    """The first to the last brace of what a model says, if it is JSON at all."""
    said = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 2, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise("no {json at all")
    found = F.from_json(F.regexp_extract(said, r"(?s)\{.*\}", 0), "k long")["k"]
    return t.events.select("event_id", found.alias("k"), found.isNull().alias("broken"))


@query("""SELECT user_id, event_id, ['speech', 'text', 'visual'][1 + event_id % 3] || '+' || ['speech', 'text', 'visual'][1 + (event_id + 1) % 3] AS modalities, round((event_id % 500) * CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 2 END, 2) AS at_s FROM events""", at_s="DOUBLE")
def frame_times(t: Tables):
    """Two modalities in turn, and the time of a frame by the number in its name and the interval of its kind."""
    kinds = F.array(F.lit("speech"), F.lit("text"), F.lit("visual"))
    pick = lambda d: F.element_at(kinds, (F.pmod(F.col("event_id") + d, F.lit(3)) + 1).cast("int"))
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "subtitle-top-frame-").otherwise("full-frame-"), F.lpad((F.col("event_id") % 500 + 1).cast("string"), 5, "0"), F.lit(".jpg"))
    number = F.greatest(F.lit(1), F.regexp_extract(name, r"(?i)(?:subtitle-(?:top|bottom)-frame|full-frame|frame)-(\d+)", 1).cast("int"))
    at = F.round((number - 1) * F.when(name.rlike("^(full-|frame-)"), 2.0).otherwise(0.5), 2)
    return t.events.select("user_id", "event_id", F.concat(pick(0), F.lit("+"), pick(1)).alias("modalities"), at.alias("at_s"))


@query("""SELECT item_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 400) AS prepared FROM benchmark WHERE regexp_matches(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 400), '[A-Za-zÀ-ÿ]')""")
def lexical_query_prep(t: Tables):
    b = t.benchmark.select("item_id", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 400).alias("prepared"))
    return b.filter(F.col("prepared").rlike(r"\p{L}"))

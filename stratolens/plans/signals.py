"""Further scores, repairs and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import intervals as I, ordered as O
from .base import Tables, query
from .intervals import HOUR, SQL_POINTS, ev
from .search import SQL_HITS, SQL_TERMS, TERMS, hits


@query(f"""WITH k AS (SELECT user_id, points, list_reduce(list_transform(points, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= {3 * HOUR} THEN list_concat(a, x) ELSE a END) AS b FROM {SQL_POINTS} WHERE len(points) > 1),
e AS (SELECT user_id, CASE WHEN len(b) = 1 THEN [b[1], points[len(points)]] ELSE list_concat(b[1:len(b) - 1], [points[len(points)]]) END AS b FROM k)
SELECT user_id, len(b) - 1 AS windows, b[1] AS start, b[len(b)] AS "end", b[len(b)] - b[len(b) - 1] AS last_length FROM e""")
def merge_short_windows(t: Tables):
    """Windows between a user's points, joined until they last three hours; what is left over at the end extends the last one. The state is the number of points and bounds, the first bound, the last two, and the last point."""
    long = 3 * HOUR
    step = lambda s, x: (s[0] + 1, s[1] + 1, s[2], s[4], x, x) if x - s[4] >= long else (s[0] + 1, *s[1:5], x)
    result = lambda s: (max(1, s[1] - 1), s[2], s[5], s[5] - s[3]) if s[0] > 1 else None
    return I.carried(ev(t), "user_id", "at", lambda x: (1, 1, x, x, x, x), step, result, "windows start end last_length")


@query("""WITH c AS (SELECT doc_id, lang, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS ascii, length(regexp_replace(text, '[^à-öø-ÿÀ-ÖØ-ÞßŒœ]+', '', 'g')) AS marked, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits, greatest(1, length(text)) AS n FROM documents)
SELECT doc_id, ascii, marked, digits, round(marked / n, 6) AS marked_share, round(0.6 * ascii / n + 0.3 * least(1, marked * 10 / n) - 0.2 * digits / n, 6) AS score FROM c""", marked_share="DOUBLE", score="DOUBLE")
def script_statistics(t: Tables):
    only = lambda p: F.length(F.regexp_replace("text", p, "")).cast("long")
    c = t.documents.select("doc_id", only("[^A-Za-z]+").alias("ascii"), only("[^à-öø-ÿÀ-ÖØ-ÞßŒœ]+").alias("marked"), only("[^0-9]+").alias("digits"), F.greatest(F.lit(1), F.length("text")).alias("n"))
    score = 0.6 * F.col("ascii") / F.col("n") + 0.3 * F.least(F.lit(1.0), F.col("marked") * 10 / F.col("n")) - 0.2 * F.col("digits") / F.col("n")
    return c.select("doc_id", "ascii", "marked", "digits", F.round(F.col("marked") / F.col("n"), 6).alias("marked_share"), F.round(score, 6).alias("score"))


@query("""WITH c AS (SELECT conv_id, bool_or(role = 'system') AS s, bool_or(role = 'user' AND contains(text, '?')) AS q, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY conv_id)
SELECT conv_id, round(least(0.86, 0.18 + CASE WHEN s THEN 0.22 ELSE 0 END + CASE WHEN q THEN 0.18 ELSE 0 END + CASE WHEN n > 4 THEN 0.14 ELSE 0 END + CASE WHEN chars > 800 THEN 0.2 ELSE 0 END), 4) AS confidence FROM c""", confidence="DOUBLE")
def source_confidence(t: Tables):
    c = t.conversations.groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("s"), F.bool_or((F.col("role") == "user") & F.col("text").contains("?")).alias("q"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    return c.select("conv_id", F.round(F.least(F.lit(0.86), 0.18 + add(F.col("s"), 0.22) + add(F.col("q"), 0.18) + add(F.col("n") > 4, 0.14) + add(F.col("chars") > 800, 0.2)), 4).alias("confidence"))


@query(f"""WITH d AS (SELECT doc_id, source, lang, unnest(list_intersect(list_distinct({SQL_TERMS}), {list(TERMS)!r})) AS term FROM documents) SELECT term, source, count(*) AS texts, count(DISTINCT lang) AS langs, min(doc_id) AS first_doc FROM d GROUP BY term, source""")
def lexical_provenance(t: Tables):
    d = t.documents.select("doc_id", "source", "lang", F.explode(F.array_intersect(X.terms(F.col("text")), F.array(*[F.lit(x) for x in TERMS]))).alias("term"))
    return d.groupBy("term", "source").agg(F.count("*").alias("texts"), F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, strlen(text) AS broken_chars, text AS repaired, TRUE AS left_alone FROM documents WHERE strlen(text) <> length(text)")
def encoding_repair(t: Tables):
    """Texts whose UTF-8 was read as Latin-1 are told by their looks and read again; the texts as they are stay. The broken ones are made here, from all texts that can break."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    d = t.documents.filter(F.octet_length("text") != F.length("text")).select("doc_id", "text", broken.alias("b"))
    return d.select("doc_id", F.length("b").cast("long").alias("broken_chars"), X.repaired(F.col("b")).alias("repaired"), (X.repaired(F.col("text")) == F.col("text")).alias("left_alone"))


SQL_RGB = """(WITH h AS (SELECT event_id, (value * 7.31) % 6 AS h FROM events), i AS (SELECT event_id, CAST(floor(h) AS INT) AS i, h - floor(h) AS f FROM h)
SELECT event_id, CAST(CASE i WHEN 0 THEN 230 WHEN 1 THEN round(230 - 184 * f) WHEN 2 THEN 46 WHEN 3 THEN 46 WHEN 4 THEN round(46 + 184 * f) ELSE 230 END AS BIGINT) AS r, CAST(CASE i WHEN 0 THEN round(46 + 184 * f) WHEN 1 THEN 230 WHEN 2 THEN 230 WHEN 3 THEN round(230 - 184 * f) ELSE 46 END AS BIGINT) AS g,
CAST(CASE i WHEN 0 THEN 46 WHEN 1 THEN 46 WHEN 2 THEN round(46 + 184 * f) WHEN 3 THEN 230 WHEN 4 THEN 230 ELSE round(230 - 184 * f) END AS BIGINT) AS b FROM i)"""


@query(f"SELECT event_id, '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') AS hex, round(g / (r + g + b), 6) AS green FROM {SQL_RGB}")
def hue_to_hex(t: Tables):
    h = t.events.select("event_id", ((F.col("value") * 7.31) % 6).alias("h")).select("event_id", F.floor("h").alias("i"), (F.col("h") - F.floor("h")).alias("f"))
    up, down = F.round(46 + 184 * F.col("f")), F.round(230 - 184 * F.col("f"))
    pick = lambda *v: F.element_at(F.array(*[x.cast("long") if not isinstance(x, int) else F.lit(x).cast("long") for x in v]), (F.col("i") + 1).cast("int"))
    c = h.select("event_id", pick(230, down, 46, 46, up, 230).alias("r"), pick(up, 230, 230, down, 46, 46).alias("g"), pick(46, 46, up, 230, 230, down).alias("b"))
    two = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    return c.select("event_id", F.concat(F.lit("#"), two("r"), two("g"), two("b")).alias("hex"), F.round(F.col("g") / (F.col("r") + F.col("g") + F.col("b")), 6).alias("green"))


@query("""SELECT l_orderkey, l_linenumber, least(0.86, round(0.3 + CASE WHEN l_returnflag = 'R' THEN 0.22 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 0.18 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 0.14 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 0.12 ELSE 0 END, 4)) AS confidence,
CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 25 THEN 'confirmed' WHEN l_returnflag = 'R' OR l_quantity > 25 THEN 'candidate' ELSE 'unknown' END AS status FROM lineitem""", confidence="DOUBLE")
def candidate_confidence(t: Tables):
    r, f, q = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_quantity") > 25
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    c = F.least(F.lit(0.86), F.round(0.3 + add(r, 0.22) + add(f, 0.18) + add(F.col("l_discount") > 0.05, 0.14) + add(q, 0.12), 4))
    return t.lineitem.select("l_orderkey", "l_linenumber", c.alias("confidence"), F.when(r & f & q, "confirmed").when(r | q, "candidate").otherwise("unknown").alias("status"))


@query("SELECT lower(trim(term)) AS term, count(*) AS parts, count(DISTINCT p_brand) AS brands FROM (SELECT p_brand, unnest(regexp_split_to_array(p_type, '[ ,]+')) AS term FROM part) WHERE trim(term) <> '' GROUP BY 1")
def filter_value_split(t: Tables):
    p = t.part.select("p_brand", F.explode(F.split("p_type", "[ ,]+")).alias("term")).filter(F.trim("term") != "")
    return p.groupBy(F.lower(F.trim("term")).alias("term")).agg(F.count("*").alias("parts"), F.count_distinct("p_brand").alias("brands"))


@query("SELECT event_type, event_id, r AS age FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'view') WHERE r <= 60")
def prune_operation_log(t: Tables):
    e = ev(t).filter("event_type <> 'view'")
    return O.top_per_group(e, ["event_type"], 60, [F.col("at").desc(), F.col("event_id").desc()], "event_id", "age").select("event_type", "event_id", "age")


@query("""WITH c AS (SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY ALL), s AS (SELECT source, sum(n) AS total, coalesce(max(CASE WHEN lang = 'en' THEN n END), 0) AS en FROM c GROUP BY source)
SELECT c.source, CASE WHEN any_value(en) * 2 >= any_value(total) THEN 'en' ELSE arg_max(lang, (chars, lang)) END AS best FROM c JOIN s USING (source) WHERE lang IS NOT NULL GROUP BY c.source""")
def best_language_result(t: Tables):
    """English if it has half the texts, else the language with the most characters."""
    c = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    s = c.groupBy("source").agg(F.sum("n").alias("total"), F.coalesce(F.max(F.when(F.col("lang") == "en", F.col("n"))), F.lit(0)).alias("en"), F.max(F.when(F.col("lang").isNotNull(), F.struct("chars", "lang")))["lang"].alias("most"))
    return s.filter("most is not null").select("source", F.when(F.col("en") * 2 >= F.col("total"), "en").otherwise(F.col("most")).alias("best"))


@query("""SELECT d.source, count(*) AS segments, count(DISTINCT lang) AS langs, count(l.doc_id) AS labelled, count(v.vec_id) AS vectors, round(count(l.doc_id) / count(*), 4) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = d.doc_id GROUP BY d.source""")
def evidence_coverage(t: Tables):
    l = t.labels.select("doc_id").distinct().withColumn("l", F.lit(1))
    v = t.embeddings.select(F.col("vec_id").alias("doc_id")).distinct().withColumn("v", F.lit(1))
    d = t.documents.select("doc_id", "source", "lang").join(l, "doc_id", "left").join(v, "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("segments"), F.count_distinct("lang").alias("langs"), F.count("l").alias("labelled"), F.count("v").alias("vectors"), F.round(F.count("l") / F.count("*"), 4).alias("coverage"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits DESC, n_chars DESC, doc_id) AS r FROM {SQL_HITS}) SELECT source, doc_id, r AS place, hits, CASE WHEN n_chars / 20000 < 0.36 THEN 'defensive' WHEN n_chars / 20000 > 0.64 THEN 'attacking' ELSE 'middle' END AS zone FROM r WHERE r <= 4""")
def event_candidates_top4(t: Tables):
    x = F.col("n_chars") / 20000
    top = O.top_per_group(hits(t), ["source"], 4, [F.col("hits").desc(), F.col("n_chars").desc(), F.col("doc_id")], "doc_id", "place")
    return top.select("source", "doc_id", "place", F.col("hits").cast("long").alias("hits"), F.when(x < 0.36, "defensive").when(x > 0.64, "attacking").otherwise("middle").alias("zone"))


@query("""WITH m AS (SELECT user_id, regr_slope(value, epoch_us(ts) / 3600000000.0) AS v, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 2) SELECT user_id, n, CASE WHEN v > 0 THEN 'left_to_right' ELSE 'right_to_left' END AS direction, round(least(0.56, 0.26 + 1.8 * abs(v)), 4) AS confidence FROM m""")
def attack_direction(t: Tables):
    m = ev(t).groupBy("user_id").agg(F.regr_slope("value", F.col("at") / 3600000000.0).alias("v"), F.count("*").alias("n")).filter("n > 2")
    return m.select("user_id", "n", F.when(F.col("v") > 0, "left_to_right").otherwise("right_to_left").alias("direction"), F.round(F.least(F.lit(0.56), 0.26 + 1.8 * F.abs("v")), 4).alias("confidence"))

"""Text and metadata of catalog rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .base import Tables, query
from .search import NORM


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang_key, TRY_CAST(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS BIGINT) AS media_no FROM pages")
def media_key_extraction(t: Tables):
    g = lambda k: F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", k)
    return t.pages.select("page_id", F.lower(F.regexp_extract("url", "^https?://([^/]+)", 1)).alias("host"), g(1).alias("lang_key"), g(2).try_cast("long").alias("media_no"))


@query(f"SELECT p_partkey, regexp_replace(regexp_replace({NORM.replace('text', 'p_name')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS header FROM part")
def slug_and_header(t: Tables):
    return t.part.select("p_partkey", X.slug(F.col("p_name")).alias("slug"), X.header_name(F.col("p_type")).alias("header"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 48 THEN text ELSE regexp_replace(substr(text, 1, 48), ' +[^ ]*$', '') || '...' END AS label,
array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> '')[1:3], lambda s: substr(trim(s), 1, 220)), '|') AS snippets FROM documents""")
def label_and_snippets(t: Tables):
    s = F.slice(F.filter(F.split("text", "[.!?]+"), lambda s: F.trim(s) != ""), 1, 3)
    return t.documents.select("doc_id", X.words_up_to(F.col("text"), 48).alias("label"), F.array_join(F.transform(s, lambda s: F.substring(F.trim(s), 1, 220)), "|").alias("snippets"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS season,
CAST(o_orderkey % 7 + 1 AS VARCHAR) || CASE o_orderkey % 7 + 1 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END AS place, CAST(CAST(round(o_totalprice / 100) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(round(o_totalprice / 100) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM orders""")
def season_and_clock(t: Tables):
    return t.orders.select("o_orderkey", X.season(F.col("o_orderdate")).alias("season"), X.ordinal(F.col("o_orderkey") % 7 + 1).alias("place"), X.minutes(F.col("o_totalprice") / 100).alias("clock"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '[0-9]{1,3}(\\.[0-9]{1,3}){3}')) AS addresses, TRY_CAST(replace(regexp_extract(text, '[0-9][0-9,]*'), ',', '') AS DOUBLE) AS first_number,
regexp_matches(lower(text), 'licen[sc]ed under') AS licensed FROM documents""")
def metric_extraction(t: Tables):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return t.documents.select(
        "doc_id", n("[0-9]+").alias("numbers"), n("[0-9]{1,3}(\\.[0-9]{1,3}){3}").alias("addresses"), X.number(F.regexp_extract("text", "[0-9][0-9,]*", 0)).alias("first_number"), F.lower("text").rlike("licen[sc]ed under").alias("licensed")
    )


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(idiot|clown|pathetic)\\b') THEN 'insult' WHEN regexp_matches(lower(text), 'licen[sc]ed|copyright') THEN 'license' WHEN regexp_matches(text, '@[a-z]') THEN 'contact' WHEN regexp_matches(text, '[|]') THEN 'table' ELSE 'prose' END AS kind,
CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS band FROM documents""")
def event_type_cascade(t: Tables):
    low = F.lower("text")
    kind = F.when(low.rlike(r"\b(idiot|clown|pathetic)\b"), "insult").when(low.rlike("licen[sc]ed|copyright"), "license").when(F.col("text").rlike("@[a-z]"), "contact").when(F.col("text").rlike("[|]"), "table").otherwise("prose")
    return t.documents.select("doc_id", kind.alias("kind"), F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long").alias("band"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, length(html) AS size FROM pages")
def page_projection(t: Tables):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), n("<a ").alias("links"), n("<p[ >]").alias("paragraphs"), F.length("html").cast("long").alias("size"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, sum(length(text)) AS chars, string_agg(role, '>' ORDER BY turn) AS flow, arg_min(role, turn) AS opens FROM conversations GROUP BY conv_id""", chars="BIGINT")
def asset_summary(t: Tables):
    g = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return g.select("conv_id", "turns", "user_turns", "chars", F.array_join(F.transform("r", lambda x: x["role"]), ">").alias("flow"), F.get("r", F.lit(0))["role"].alias("opens"))


@query("SELECT vec_id, len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) > 0 AS valid, '[' || array_to_string(list_transform(embedding[1:3], lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)), ',') || ']' AS literal FROM embeddings")
def vector_validity(t: Tables):
    from ..functions import vectors as V

    head = F.array_join(F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",")
    return t.embeddings.select("vec_id", V.is_valid(F.col("embedding"), 64).alias("valid"), F.concat(F.lit("["), head, F.lit("]")).alias("literal"))


@query("""WITH d AS (SELECT label, unnest(range(64)) AS dim, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS m FROM d GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
SELECT label, dim, round(m / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS value FROM m JOIN n USING (label)""")
def cluster_centroids(t: Tables):
    d = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    n = d.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return d.join(n, "label").select("label", F.col("dim").cast("long").alias("dim"), F.round(F.col("m") / F.when(F.col("n") == 0, 1.0).otherwise(F.col("n")), 6).alias("value"))

"""Retrieval, ranking, filters and trust."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as X, vectors as V
from ..operators import ordered as O, overlap, vector_search as R
from ..operators.staging import spread
from .base import Tables, query

TERMS = ("the", "with", "that", "was")
MARKS = f"translate(regexp_replace(lower(text), '[{X._MARKS}]+', '', 'g'), '{X.MARKED}', '{X.PLAIN}')"
NORM = f"trim(regexp_replace({MARKS}, '[ \\t\\n\\r]+', ' ', 'g'))"
SQL_TERMS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({NORM}, '[^{X.LETTERS} -]+', ' ', 'g'), ' +'), lambda t: regexp_replace(t, '^-+|-+$', '', 'g')), lambda t: t <> '')"
SQL_KEYWORDS = f"list_filter({SQL_TERMS}, lambda t: (length(t) > 2 OR length(t) = 2 AND regexp_matches(t, '[{X.EAST}]')) AND NOT list_contains({list(X.STOP_WORDS)!r}, t))"
#: Distinct in order of first appearance.
SQL_FIRST = "(list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN list_position({0}, {0}[i]) = i THEN {0}[i] END), lambda t: t IS NOT NULL))"
DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
COSINE = f"{DOT} / (sqrt({DOT.replace('{1}', '{0}')}) * sqrt({DOT.replace('{0}', '{1}')}))".format("e.embedding", "q.embedding")
SQL_QUERIES = "(SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0)"
SQL_COSINE = f"(SELECT q.query_id, e.vec_id, e.label, {COSINE} AS cosine FROM embeddings e, {SQL_QUERIES} q)"


def sql_best(rows: str, k: int, order: str, rank: str = "rank") -> str:
    """The first k rows of each query."""
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS {rank} FROM {rows}) WHERE {rank} <= {k})"



SQL_HITS = f"(SELECT doc_id, source, lang, n_chars, len(list_intersect(list_distinct({SQL_TERMS}), {list(TERMS)!r})) AS hits FROM documents)"


def hits(t: Tables):
    return t.documents.select("doc_id", "source", "lang", "n_chars", X.lexical_score(F.col("text"), TERMS).alias("hits"))


def queries(t: Tables):
    """The vectors that searches are made for."""
    return t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query(f"""
WITH c AS {SQL_COSINE}, h AS {SQL_HITS},
v AS (SELECT query_id, vec_id AS doc_id, cosine AS vec_score, vec_rank FROM {sql_best("c", 150, "cosine DESC, vec_id", "vec_rank")}),
l AS (SELECT *, row_number() OVER (ORDER BY lex_score DESC, doc_id) AS lex_rank FROM (SELECT doc_id, hits / 4 AS lex_score FROM h WHERE hits > 0 ORDER BY 2 DESC, 1 LIMIT 150)),
b AS (SELECT query_id, doc_id, vec_score, vec_rank, lex_score, lex_rank,
   round(0.86 * coalesce(vec_score, 0) + 0.14 * least(1, greatest(0, coalesce(lex_score, 0))) + coalesce(1 / (60 + vec_rank), 0) + coalesce(1 / (60 + lex_rank), 0), 6) AS score FROM v FULL JOIN (SELECT * FROM {SQL_QUERIES}, l) USING (query_id, doc_id))
SELECT query_id, doc_id, round(vec_score, 6) AS vec_score, vec_rank, lex_score, lex_rank, score FROM {sql_best("b", 25, "score DESC, doc_id")}""", vec_rank="INTEGER", lex_rank="INTEGER")
def hybrid_search_topk(t: Tables):
    vec = R.top_per_query(queries(t), vectors(t), 150, name="vec_rank").select("query_id", F.col("id").alias("doc_id"), F.col("cosine").alias("vec_score"), F.col("vec_rank").cast("int").alias("vec_rank"))
    lex = hits(t).filter("hits > 0").select("doc_id", (F.col("hits") / len(TERMS)).alias("lex_score"))
    lex = R.ranked(lex, 150, "lex_score", "doc_id", "lex_rank")  # the same 150 rows for every query
    out = R.fused(vec, queries(t).select("query_id").crossJoin(F.broadcast(lex)), "doc_id", 25, per=["query_id"])
    return out.select("query_id", "doc_id", F.round("vec_score", 6).alias("vec_score"), "vec_rank", "lex_score", "lex_rank", "score")


@query(f"SELECT query_id, vec_id, label, round(1 - cosine, 6) AS distance FROM {sql_best(SQL_COSINE, 25, 'cosine DESC, vec_id')}")
def cosine_topk(t: Tables):
    return R.top_per_query(queries(t), vectors(t), 25, ["label"]).select("query_id", F.col("id").alias("vec_id"), "label", F.round(1 - F.col("cosine"), 6).alias("distance"))


@query(f"""WITH f AS (SELECT query_id, c.vec_id, d.source, cosine FROM {SQL_COSINE} c JOIN documents d ON d.doc_id = c.vec_id
JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(toxic) = 0 AND max(quality) = 1) l ON l.doc_id = d.doc_id WHERE d.lang = 'en')
SELECT query_id, vec_id, source, round(greatest(0, cosine), 3) AS similarity FROM {sql_best("f", 40, "cosine DESC, vec_id")}""")
def visual_topk_filtered(t: Tables):
    clean = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("t"), F.max("quality").alias("q")).filter("t = 0 and q = 1").select("doc_id")
    docs = t.documents.filter("lang = 'en'").select("doc_id", "source").join(clean, "doc_id", "left_semi")
    found = vectors(t).join(docs, F.col("id") == F.col("doc_id"))
    return R.top_per_query(queries(t), found, 40, ["source"]).select("query_id", F.col("id").alias("vec_id"), "source", F.round(F.greatest(F.lit(0.0), "cosine"), 3).alias("similarity"))


@query(f"""WITH s AS (SELECT label, count(*) AS cluster_size FROM embeddings GROUP BY label),
h AS (SELECT c.*, s.cluster_size FROM {sql_best(SQL_COSINE, 150, "cosine DESC, vec_id")} c JOIN s USING (label)),
g AS (SELECT query_id, label, arg_min(vec_id, (-cosine, vec_id)) AS vec_id, max(cosine) AS best, count(*) AS support, max(cluster_size) AS size FROM h GROUP BY query_id, label)
SELECT query_id, label, vec_id, support, round(best + (least(0.04, log2(greatest(1, size) + 1) * 0.01) + least(0.02, (support - 1) * 0.004)), 6) AS score FROM g""")
def appearance_cluster_collapse(t: Tables):
    sizes = t.embeddings.groupBy("label").agg(F.count("*").alias("cluster_size"))
    best = R.top_per_query(queries(t), vectors(t), 150, ["label"]).withColumnRenamed("id", "vec_id")
    return R.collapsed(best.join(sizes, "label"), "label", "vec_id", "cosine", per=["query_id"])


@query(f"""WITH s AS (SELECT query_id, c.vec_id AS doc_id, h.source, 0.72 * cosine + 0.42 * (hits / 4) + CASE WHEN source = 'src3' THEN 0.25 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.08 ELSE 0 END AS s
  FROM {SQL_COSINE} c JOIN {SQL_HITS} h ON h.doc_id = c.vec_id)
SELECT query_id, doc_id, source, round(s, 6) AS score, round(least(0.96, greatest(0.5, 0.62 + 0.34 * s)), 6) AS confidence FROM {sql_best("s", 50, "s DESC, doc_id")} WHERE s > 0.12""")
def knowledge_vector_score(t: Tables):
    h = vectors(t).join(hits(t), F.col("id") == F.col("doc_id"))
    bonus = 0.42 * (F.col("hits") / len(TERMS)) + F.when(F.col("source") == "src3", 0.25).otherwise(0.0) + F.when(F.col("lang") == "en", 0.08).otherwise(0.0)
    best = R.top_per_query(queries(t), h, 50, ["source"], 0.72, bonus).filter("score > 0.12").select("query_id", F.col("id").alias("doc_id"), "source", F.col("score").alias("s"))
    return best.select("query_id", "doc_id", "source", F.round("s", 6).alias("score"), F.round(F.least(F.lit(0.96), F.greatest(F.lit(0.5), 0.62 + 0.34 * F.col("s"))), 6).alias("confidence"))


@query(f"WITH k AS (SELECT doc_id, {SQL_KEYWORDS} AS k FROM documents) SELECT doc_id, array_to_string({SQL_FIRST.format('k')}[1:24], ' ') AS keywords FROM k")
def keyword_extract(t: Tables):
    return t.documents.select("doc_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


@query(f"SELECT doc_id, hits FROM {SQL_HITS} WHERE hits >= 2")
def lexical_score(t: Tables):
    return hits(t).filter("hits >= 2").select("doc_id", F.col("hits").cast("long").alias("hits"))


@query(f"""WITH k AS (SELECT doc_id, {SQL_KEYWORDS} AS k FROM documents), w AS (SELECT doc_id, unnest({SQL_FIRST.format('k')}[1:24]) AS term FROM k),
b AS (SELECT doc_id, i, sum(CAST('0x' || substr(sha1(term), CAST(2 * i + 1 AS INT), 2) AS INT) - 128) / 128 AS x FROM w, range(16) r(i) GROUP BY doc_id, i),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM b GROUP BY doc_id)
SELECT b.doc_id, i AS dim, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 4) AS value FROM b JOIN n USING (doc_id)""")
def hash_embedding_16d(t: Tables):
    terms = t.documents.select("doc_id", F.explode(X.keywords(F.col("text"))).alias("term")).select("doc_id", F.sha1("term").alias("h"))
    sums = terms.groupBy("doc_id").agg(*[(F.sum(F.conv(F.substring("h", 2 * i + 1, 2), 16, 10).cast("int") - 128) / 128).alias(f"v{i}") for i in range(16)])
    vec = sums.select("doc_id", F.array(*[f"v{i}" for i in range(16)]).alias("v")).withColumn("n", V.length(F.col("v")))
    return vec.select("doc_id", "n", F.posexplode("v").alias("dim", "x")).select("doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x") / F.col("n"), 4).alias("value"))


SQL_SEGMENT = f"(SELECT doc_id, source, hits, 3 * hits + CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 1.25 ELSE 0 END + least(2, n_chars / 5000) AS score FROM {SQL_HITS})"


def segment_scores(t: Tables):
    score = 3 * F.col("hits") + F.when(F.col("lang") == "en", 5.0).when(F.col("lang") == "fr", 1.25).otherwise(0.0) + F.least(F.lit(2.0), F.col("n_chars") / 5000)
    return hits(t).withColumn("score", score)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM {SQL_SEGMENT} WHERE hits > 0), s AS (SELECT * FROM r WHERE rank <= 5),
a AS (SELECT source, round(sum(score), 6) AS asset_score FROM s GROUP BY source ORDER BY 2 DESC, 1 LIMIT 10)
SELECT s.source, asset_score, doc_id, rank, round(score, 6) AS score FROM s JOIN a USING (source)""")
def segment_score_nested_topk(t: Tables):
    five = O.top_per_group(segment_scores(t).filter("hits > 0"), ["source"], 5, [F.col("score").desc(), F.col("doc_id")], "doc_id")
    assets = R.top(five.groupBy("source").agg(F.round(F.sum("score"), 6).alias("asset_score")), 10, F.col("asset_score").desc(), F.col("source"))
    return five.join(assets, "source").select("source", "asset_score", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""SELECT source, count(*) AS segments, count(*) FILTER (hits > 0) AS matched, round(24 * max(hits) + sum(3 * hits) / count(*) + max(score), 6) AS score FROM {SQL_SEGMENT} GROUP BY source""")
def asset_rollup_score(t: Tables):
    return segment_scores(t).groupBy("source").agg(
        F.count("*").alias("segments"), F.count_if(F.col("hits") > 0).alias("matched"), F.round(24 * F.max("hits") + F.sum(3 * F.col("hits")) / F.count("*") + F.max("score"), 6).alias("score")
    )


SQL_CHECKS = f"""(SELECT h.doc_id, h.source, CASE WHEN lang = 'en' THEN 'trusted' WHEN lang IN ('fr', 'de') THEN 'weak' ELSE 'failed' END AS c_lang,
  CASE WHEN hits >= 2 THEN 'trusted' WHEN hits = 1 THEN 'weak' ELSE 'failed' END AS c_text, CASE WHEN l.doc_id IS NULL THEN 'weak' WHEN toxic = 1 THEN 'failed' ELSE 'trusted' END AS c_safe
  FROM {SQL_HITS} h LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"""


def checks(t: Tables):
    """Three-valued constraints on each document: trusted, weak or failed."""
    marks = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.lit(1).alias("labelled"))
    h = hits(t).join(marks, "doc_id", "left")
    lang = F.when(F.col("lang") == "en", "trusted").when(F.col("lang").isin("fr", "de"), "weak").otherwise("failed")
    found = F.when(F.col("hits") >= 2, "trusted").when(F.col("hits") == 1, "weak").otherwise("failed")
    safe = F.when(F.col("labelled").isNull(), "weak").when(F.col("toxic") == 1, "failed").otherwise("trusted")
    return h.select("doc_id", "source", lang.alias("c_lang"), found.alias("c_text"), safe.alias("c_safe"))


def _all(f):
    return F.array("c_lang", "c_text", "c_safe") if f is None else F.size(F.filter(F.array("c_lang", "c_text", "c_safe"), lambda c: c == f))


@query(f"""SELECT doc_id, c_lang, c_text, c_safe, 'failed' NOT IN (c_lang, c_text, c_safe) AS accepted,
CASE WHEN 'failed' IN (c_lang, c_text, c_safe) THEN 'failed' WHEN 'weak' IN (c_lang, c_text, c_safe) THEN 'weak' ELSE 'trusted' END AS trust FROM {SQL_CHECKS}""")
def three_valued_filter(t: Tables):
    trust = F.when(_all("failed") > 0, "failed").when(_all("weak") > 0, "weak").otherwise("trusted")
    return checks(t).select("doc_id", "c_lang", "c_text", "c_safe", (_all("failed") == 0).alias("accepted"), trust.alias("trust"))


@query(f"SELECT doc_id, len(list_intersect(list_distinct({SQL_TERMS}), ['the', 'with'])) = 2 AS has_all, len(list_intersect(list_distinct({SQL_TERMS}), ['auch', 'nicht', 'pour'])) > 0 AS has_any FROM documents")
def required_evidence_all_any(t: Tables):
    text = F.col("text")
    return t.documents.select("doc_id", (X.lexical_score(text, ("the", "with")) == 2).alias("has_all"), (X.lexical_score(text, ("auch", "nicht", "pour")) > 0).alias("has_any"))


SQL_LEDGER = f"(SELECT *, CAST(c_lang = 'trusted' AS INT) + CAST(c_text = 'trusted' AS INT) + CAST(c_safe = 'trusted' AS INT) AS hard, CAST(c_lang = 'weak' AS INT) + CAST(c_text = 'weak' AS INT) + CAST(c_safe = 'weak' AS INT) AS soft FROM {SQL_CHECKS})"


@query(f"SELECT source, sum(hard) AS hard, sum(soft) AS soft, sum(3 - hard - soft) AS failed, count(*) AS segments FROM {SQL_LEDGER} GROUP BY source", hard="BIGINT", soft="BIGINT", failed="BIGINT")
def verification_tally(t: Tables):
    return checks(t).groupBy("source").agg(F.sum(_all("trusted")).alias("hard"), F.sum(_all("weak")).alias("soft"), F.sum(_all("failed")).alias("failed"), F.count("*").alias("segments"))


@query(f"""SELECT doc_id, hard, soft, round(100 * least(1, greatest(0, (hard * 0.75 + 0.55 * (soft * 0.45)) / 3 - (0.45 * (3 - hard - soft))))) AS trust_score FROM {SQL_LEDGER}""")
def evidence_trust_score(t: Tables):
    c = checks(t).select("doc_id", _all("trusted").alias("hard"), _all("weak").alias("soft"))
    s = (F.col("hard") * 0.75 + 0.55 * (F.col("soft") * 0.45)) / 3 - (0.45 * (3 - F.col("hard") - F.col("soft")))
    return c.select("doc_id", "hard", "soft", F.round(100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))).alias("trust_score"))


@query(f"""WITH p(preset, max_failed, min_hard) AS (VALUES ('broad', 1, 0), ('balanced', 0, 1), ('strict', 0, 3))
SELECT preset, source, count(*) AS segments FROM {SQL_LEDGER}, p WHERE 3 - hard - soft <= max_failed AND hard >= min_hard GROUP BY preset, source""")
def trust_filter_presets(t: Tables):
    presets = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(f).alias("max_failed"), F.lit(h).alias("min_hard")) for n, f, h in (("broad", 1, 0), ("balanced", 0, 1), ("strict", 0, 3))])
    c = checks(t).select("source", _all("trusted").alias("hard"), _all("failed").alias("failed"), F.explode(presets).alias("p"))
    return c.filter("failed <= p.max_failed and hard >= p.min_hard").groupBy(F.col("p.preset").alias("preset"), "source").agg(F.count("*").alias("segments"))


@query(f"""WITH t(trust, rank) AS (VALUES ('unavailable', 0), ('heuristic', 1), ('inferred', 2), ('candidate', 3), ('detected', 4), ('aligned', 5), ('observed', 6)),
d AS (SELECT CASE WHEN c_safe = 'failed' THEN 'unavailable' WHEN hard = 3 THEN 'observed' WHEN hard = 2 THEN 'aligned' WHEN hard = 1 AND soft = 2 THEN 'detected' WHEN hard = 1 THEN 'candidate' WHEN soft = 0 THEN 'heuristic' ELSE 'inferred' END AS trust FROM {SQL_LEDGER})
SELECT t.trust, t.rank, count(d.trust) AS segments FROM t LEFT JOIN d USING (trust) GROUP BY t.trust, t.rank""")
def trust_histogram(t: Tables):
    c = checks(t).select("c_safe", _all("trusted").alias("hard"), _all("weak").alias("soft"))
    tier = (
        F.when(F.col("c_safe") == "failed", "unavailable").when(F.col("hard") == 3, "observed").when(F.col("hard") == 2, "aligned")
        .when((F.col("hard") == 1) & (F.col("soft") == 2), "detected").when(F.col("hard") == 1, "candidate").when(F.col("soft") == 0, "heuristic").otherwise("inferred")
    )
    names = ("unavailable", "heuristic", "inferred", "candidate", "detected", "aligned", "observed")
    dense = t.spark.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("rank", "trust"))
    counts = c.groupBy(tier.alias("trust")).agg(F.count("*").alias("segments"))
    return dense.join(counts, "trust", "left").select("trust", "rank", F.coalesce("segments", F.lit(0)).cast("long").alias("segments"))


@query("""SELECT d.doc_id, CASE WHEN l.q IS NULL THEN 'not_applicable' WHEN tox = 1 THEN 'blocked' WHEN q = 1 THEN 'metadata_complete' ELSE 'review' END AS status,
coalesce(tox, 0) = 0 AND coalesce(q, 1) = 1 AS searchable FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS tox FROM labels GROUP BY doc_id) l USING (doc_id)""")
def compliance_gate(t: Tables):
    marks = t.labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("tox"))
    status = F.when(F.col("q").isNull(), "not_applicable").when(F.col("tox") == 1, "blocked").when(F.col("q") == 1, "metadata_complete").otherwise("review")
    d = t.documents.select("doc_id").join(marks, "doc_id", "left").withColumn("status", status)
    return d.select("doc_id", "status", F.col("status").isin("not_applicable", "metadata_complete").alias("searchable"))


@query(f"""WITH c AS {SQL_COSINE}, x AS (SELECT q.query_id, h.doc_id, hits, coalesce(cosine, 0) AS cosine FROM {SQL_HITS} h CROSS JOIN {SQL_QUERIES} q LEFT JOIN c ON c.vec_id = h.doc_id AND c.query_id = q.query_id)
SELECT query_id, doc_id, hits >= 2 AS lexical, cosine >= 0.88 AS semantic, cosine >= 0.45 AS visual FROM x WHERE hits >= 2 OR cosine >= 0.88 OR cosine >= 0.45""")
def search_inclusion(t: Tables):
    x = hits(t).join(vectors(t), F.col("doc_id") == F.col("id"), "left").select(F.col("doc_id").alias("id"), "v", "hits")
    x = R.within(queries(t), x, 0.45, F.col("hits") >= 2, ["hits"])
    return x.select("query_id", F.col("id").alias("doc_id"), (F.col("hits") >= 2).alias("lexical"), (F.col("cosine") >= 0.88).alias("semantic"), (F.col("cosine") >= 0.45).alias("visual"))


@query(f"""WITH r AS (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS z FROM {SQL_SEGMENT}),
k AS (SELECT *, a <= 2 OR z <= 2 AS fixed FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY source, fixed ORDER BY score DESC, doc_id) AS b FROM k),
p AS (SELECT * FROM s WHERE fixed OR b <= 4) SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM p""")
def representative_sampling(t: Tables):
    """The first two and last two texts of a source and the four best of the others."""
    s = segment_scores(t).select("source", "doc_id", "score")
    first = O.top_per_group(s, ["source"], 2, [F.col("doc_id")], "doc_id")
    last = O.top_per_group(s, ["source"], 2, [F.col("doc_id").desc()], "doc_id")
    ends = first.union(last).select("source", "doc_id").distinct()
    # The four best besides at most four: the eight best of all hold them.
    best = O.top_per_group(s, ["source"], 8, [F.col("score").desc(), F.col("doc_id")], "doc_id").join(ends, ["source", "doc_id"], "left_anti")
    best = best.withColumn("b", F.row_number().over(W.partitionBy("source").orderBy(F.col("score").desc(), "doc_id"))).filter("b <= 4")
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return ends.union(best.select("source", "doc_id")).select("source", "doc_id", place.cast("long").alias("place"))


@query("""WITH q AS (SELECT * FROM (SELECT doc_id, max(quality) + CASE WHEN max(toxic) = 0 THEN 1 ELSE 0 END AS rel FROM labels GROUP BY doc_id)),
r AS (SELECT d.source, d.doc_id, q.rel, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank, row_number() OVER (PARTITION BY d.source ORDER BY q.rel DESC, d.doc_id) AS ideal FROM documents d JOIN q USING (doc_id))
SELECT source, max(CASE WHEN rank <= 5 AND rel > 0 THEN 1 ELSE 0 END) AS hit_at_5, round(coalesce(1 / min(CASE WHEN rel > 1 THEN rank END), 0), 4) AS rr,
round(sum(CASE WHEN rank <= 10 THEN (power(2, rel) - 1) / log2(rank + 1) ELSE 0 END) / greatest(1e-9, sum(CASE WHEN ideal <= 10 THEN (power(2, rel) - 1) / log2(ideal + 1) ELSE 0 END)), 4) AS ndcg_at_10 FROM r GROUP BY source""")
def ndcg_mrr_eval(t: Tables):
    rel = t.labels.groupBy("doc_id").agg((F.max("quality") + F.when(F.max("toxic") == 0, 1).otherwise(0)).alias("rel"))
    d = t.documents.select("doc_id", "source", "n_chars").join(rel, "doc_id")
    gain = lambda c: F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col(c) + 1))
    key = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").alias("d"))
    real = O.top_per_group(d, ["source"], 10, [F.col("n_chars").desc(), F.col("doc_id")], "doc_id")
    real = real.groupBy("source").agg(F.max(F.when((F.col("rank") <= 5) & (F.col("rel") > 0), 1).otherwise(0)).alias("hit_at_5"), gain("rank").alias("dcg"))
    ideal = O.top_per_group(d, ["source"], 10, [F.col("rel").desc(), F.col("doc_id")], "doc_id").groupBy("source").agg(gain("rank").alias("best"))
    # The rank of the first relevant text is the number of texts up to it.
    relevant = d.filter("rel > 1").groupBy("source").agg(F.min(key).alias("first"))
    rank = d.join(relevant, "source").filter(key <= F.col("first")).groupBy("source").agg(F.count("*").alias("first_rank"))
    out = real.join(ideal, "source").join(rank, "source", "left")
    return out.select("source", "hit_at_5", F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 4).alias("rr"), F.round(F.col("dcg") / F.greatest(F.lit(1e-9), F.col("best")), 4).alias("ndcg_at_10"))


SQL_PAIRS = f"(SELECT conv_id, turn, {NORM} AS a, lag({NORM}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)"


@query(f"""WITH p AS (SELECT * FROM {SQL_PAIRS} WHERE b IS NOT NULL),
x AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS g FROM p) GROUP BY ALL),
y AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS g FROM p) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS o FROM x JOIN y USING (conv_id, turn, g) GROUP BY ALL),
s AS (SELECT conv_id, turn, coalesce(2 * o / greatest(1, greatest(0, length(a) - 1) + greatest(0, length(b) - 1)), 0) AS s FROM p LEFT JOIN o USING (conv_id, turn))
SELECT conv_id, turn, round(s, 4) AS similarity, CASE WHEN s >= 0.82 THEN 'match' WHEN s >= 0.58 THEN 'review' ELSE 'mismatch' END AS status FROM s""")
def dice_bigram_compare(t: Tables):
    c = spread(t.conversations.select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn", X.normalised(F.col("text")).alias("a"), F.floor(F.col("turn") / 256).alias("part"))
    p = O.neighbours(c, ["conv_id"], "part", ["turn"], b=("a", -1)).filter("b is not null").select("conv_id", "turn", "a", "b")
    size = F.greatest(F.lit(1), F.greatest(F.lit(0), F.length("a") - 1) + F.greatest(F.lit(0), F.length("b") - 1))
    s = p.withColumn("s", 2 * X.shared_bigrams("a", "b") / size)
    return s.select("conv_id", "turn", F.round("s", 4).alias("similarity"), F.when(F.col("s") >= 0.82, "match").when(F.col("s") >= 0.58, "review").otherwise("mismatch").alias("status"))


SQL_ITEM = f"SELECT item_id, list_distinct({SQL_KEYWORDS}) AS k FROM benchmark"
SQL_CANDIDATES = f"""(WITH i AS ({SQL_ITEM}), x AS (SELECT item_id, len(k) AS size, unnest(k) AS term FROM i), d AS (SELECT doc_id, unnest(list_distinct({SQL_KEYWORDS})) AS term FROM documents)
SELECT doc_id, item_id, count(*) AS shared, any_value(size) AS size FROM d JOIN x USING (term) GROUP BY doc_id, item_id)"""


def candidates(t: Tables, need):
    """(document, item) pairs that share at least `need` keywords, a column of the item's size."""
    item = t.benchmark.select("item_id", X.keywords(F.col("text"), None).alias("k")).select("item_id", F.size("k").cast("long").alias("size"), "k")
    texts = spread(t.documents.select("doc_id", "text"), "doc_id")
    return overlap.sharing(texts.select("doc_id", X.keywords(F.col("text"), None).alias("k")), item, need)


@query(f"SELECT doc_id, item_id, shared, round(shared / size, 4) AS share FROM {SQL_CANDIDATES} WHERE shared >= 3")
def inverted_index_candidates(t: Tables):
    return candidates(t, F.lit(3)).select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("size"), 4).alias("share"))


@query(f"""SELECT doc_id, item_id, round(shared / size, 4) AS share, shared / size >= 0.8 AS strong FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared / size DESC, item_id) AS r FROM {SQL_CANDIDATES}) WHERE r = 1 AND shared / size >= 0.5""")
def best_alignment(t: Tables):
    c = candidates(t, F.ceil(F.col("size") / 2)).withColumn("share", F.col("shared") / F.col("size"))
    best = c.groupBy("doc_id").agg(F.max(F.struct("share", (-F.col("item_id")).alias("i"))).alias("b")).filter("b.share >= 0.5")
    return best.select("doc_id", (-F.col("b.i")).alias("item_id"), F.round("b.share", 4).alias("share"), (F.col("b.share") >= 0.8).alias("strong"))


@query(f"""WITH a AS (SELECT item_id, k[1] || ' ' || k[2] AS alias FROM (SELECT item_id, {SQL_TERMS} AS k FROM benchmark) WHERE len(k) >= 2),
d AS (SELECT doc_id, {SQL_TERMS} AS k FROM documents), b AS (SELECT doc_id, unnest(list_transform(range(1, len(k)), lambda i: struct_pack(at := i, gram := k[i] || ' ' || k[i + 1]))) AS g FROM d)
SELECT doc_id, arg_min(item_id, (g.at, item_id)) AS item_id, min(g.at) AS first_at, count(DISTINCT item_id) AS items FROM b JOIN a ON a.alias = b.g.gram GROUP BY doc_id""")
def alias_dictionary_join(t: Tables):
    pair = lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    alias = t.benchmark.select("item_id", X.terms(F.col("text")).alias("k")).filter("size(k) >= 2").select("item_id", F.concat_ws(" ", F.get("k", F.lit(0)), F.get("k", F.lit(1))).alias("gram"))
    doc = t.documents.select("doc_id", X.terms(F.col("text")).alias("k")).select("doc_id", F.posexplode(pair("k")).alias("at", "gram"))
    hit = doc.join(alias, "gram").groupBy("doc_id").agg(F.min(F.struct("at", "item_id")).alias("b"), F.count_distinct("item_id").alias("items"))
    return hit.select("doc_id", "b.item_id", (F.col("b.at") + 1).cast("long").alias("first_at"), "items")

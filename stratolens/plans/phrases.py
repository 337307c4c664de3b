"""Search lines with phrases and exclusions, ranked by proximity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import proximity
from .base import Tables, query
from .search import SQL_TERMS


def lines(t: Tables):
    """A search line for each item: its first two words as a phrase, two more words, and a word that odd items exclude."""
    k = t.benchmark.select(F.col("item_id").alias("query_id"), X.terms(F.col("text")).alias("k")).filter("size(k) >= 8")
    w = lambda i: F.get("k", F.lit(i))
    out = F.when(F.col("query_id") % 2 == 1, F.concat(F.lit(" -"), w(7))).otherwise("")
    return k.select("query_id", F.concat(F.lit('"'), w(0), F.lit(" "), w(1), F.lit('" '), w(3), F.lit(" "), w(5), out).alias("asked"))


@query(f"""WITH k AS (SELECT item_id AS query_id, {SQL_TERMS} AS k FROM benchmark), i AS (SELECT query_id, k[1] AS a, k[2] AS b, k[4] AS c, k[6] AS e, CASE WHEN query_id % 2 = 1 THEN k[8] END AS x FROM k WHERE len(k) >= 8),
d AS (SELECT doc_id, {SQL_TERMS} AS t FROM documents), w AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM d),
h AS (SELECT query_id, doc_id FROM (SELECT query_id, a, b, c, e, x, doc_id, t FROM i JOIN d ON list_contains(t, a) AND list_contains(t, b) AND list_contains(t, c) AND list_contains(t, e)) WHERE x IS NULL OR NOT list_contains(t, x)),
o AS (SELECT query_id, p.doc_id, 1 AS clause, p.pos AS s, p.pos + 1 AS z FROM h JOIN i USING (query_id) JOIN w p ON p.doc_id = h.doc_id AND p.term = a JOIN w n ON n.doc_id = p.doc_id AND n.pos = p.pos + 1 AND n.term = b
      UNION ALL SELECT query_id, w.doc_id, 2, pos, pos FROM h JOIN i USING (query_id) JOIN w ON w.doc_id = h.doc_id AND term = c
      UNION ALL SELECT query_id, w.doc_id, 3, pos, pos FROM h JOIN i USING (query_id) JOIN w ON w.doc_id = h.doc_id AND term = e),
l AS (SELECT query_id, doc_id, z, max(s) FILTER (clause = 1) OVER g AS l1, max(s) FILTER (clause = 2) OVER g AS l2, max(s) FILTER (clause = 3) OVER g AS l3 FROM o WINDOW g AS (PARTITION BY query_id, doc_id ORDER BY z)),
m AS (SELECT query_id, doc_id, least(l1, l2, l3) AS s, min(z) AS z FROM l WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL GROUP BY ALL)
SELECT query_id, doc_id, round(sum(0.1e0 / (1 + greatest(0, z - s + 1 - CASE WHEN (SELECT c = e FROM i WHERE i.query_id = m.query_id) THEN 3 ELSE 4 END))), 6) AS score, count(*) AS covers, min(z - s + 1) AS closest FROM m GROUP BY query_id, doc_id""", closest="INT")
def phrase_proximity_rank(t: Tables):
    """All texts that hold an item's phrase and words, without what it excludes, with the score of their covers."""
    found = proximity.rank(t.documents.select("doc_id", "text"), lines(t))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "covers", "closest")

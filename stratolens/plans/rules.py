"""Texts by a table of rules. The benchmark's items serve as rules: their longer words are terms, their last one a cue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as U
from .base import Tables, query


def rule_table(t: Tables):
    """A rule an item: up to four of its words of five letters or more, in order of the alphabet; every third needs a cue, which is the item's last such word."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))))
    b = t.benchmark.select(F.col("item_id").cast("int").alias("rule"), words.alias("w")).filter("size(w) > 0")
    return b.select("rule", F.concat(F.lit("class-"), F.col("rule") % 50).alias("label"), F.slice("w", 1, 4).alias("terms"), F.slice("w", F.size("w"), F.lit(1)).alias("cues"), (F.col("rule") % 3 == 0).alias("needs_cue"), (F.col("rule") % 4).cast("int").alias("bonus"))


@query(r"""WITH w AS (SELECT CAST(item_id AS INT) AS rule, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS w FROM benchmark),
r AS (SELECT rule, 'class-' || (rule % 50) AS label, w[1:4] AS terms, w[len(w):] AS cues, rule % 3 = 0 AS needs, rule % 4 AS bonus FROM w WHERE len(w) > 0),
d AS (SELECT doc_id, lower(text) AS t, coalesce(n_chars > 900, false) AS long, coalesce(lang = 'en', false) AS english, coalesce(source IS NOT NULL AND doc_id % 2 = 0, false) AS cue FROM documents),
m AS (SELECT d.*, rule, label, needs, bonus, len(list_filter(terms, lambda x: contains(t, x))) AS hits, len(list_filter(cues, lambda x: contains(t, x))) AS cues FROM d, r),
s AS (SELECT *, least(92, 34 + least(28, 14 * hits) + CASE WHEN cue OR cues > 0 THEN 12 ELSE 0 END + bonus + CASE WHEN long THEN 8 ELSE 0 END + CASE WHEN english THEN 4 ELSE 0 END) AS confidence FROM m WHERE hits > 0 AND (NOT needs OR cue OR cues > 0)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, rule) = 1)
SELECT d.doc_id, coalesce(label, 'unknown') AS label, CAST(coalesce(confidence, 0) AS INT) AS confidence, rule, concat_ws('+', CASE WHEN d.long THEN 'long' END, CASE WHEN d.english THEN 'english' END) AS features FROM d LEFT JOIN b ON b.doc_id = d.doc_id""")
def rule_classification(t: Tables):
    """Whole texts by all rules, each text read once."""
    d = t.documents.select("doc_id", "text", "n_chars", "lang", "source")
    out = U.classified(d, rule_table(t), "text", F.col("source").isNotNull() & (F.col("doc_id") % 2 == 0), {"long": (F.col("n_chars") > 900, 8), "english": (F.col("lang") == "en", 4)})
    return out.select("doc_id", "label", "confidence", "rule", F.concat_ws("+", "features").alias("features"))

"""Text search with phrases and exclusions, ranked by how closely what is asked for stands together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .staging import spread, stored

#: What a cover without other words in it scores.
WEIGHT = 0.1


def clauses(asked: Column) -> Column:
    """array of (words, negative): quoted phrases and single words of a search line; a leading minus excludes. Words are read as terms, so one with signs inside is a phrase of its parts. Repeated clauses are one; those without a term are left out."""
    parts = F.regexp_extract_all(F.coalesce(asked, F.lit("")), F.lit(r'-?"[^"]*"?|[^\s"]+'), 0)
    one = F.transform(parts, lambda p: F.struct(X.terms(F.regexp_replace(p, "^-", "")).alias("words"), p.startswith("-").alias("negative")))
    return F.array_distinct(F.filter(one, lambda c: F.size(c["words"]) > 0))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """texts (doc_id, text) -> doc_id, term, at (positions from 0, ascending) of the given terms."""
    # An outer explode, as Spark would make the terms once more, in a filter, for an inner one; the join drops its nulls.
    words = spread(texts.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode_outer(X.terms(F.col("text"))).alias("at", "term")).join(terms, "term", "left_semi")
    return words.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("at")).alias("at"))


def _covers(places: Column, length: Column) -> Column:
    """places: for each clause its (start, end) in order -> struct (score, covers, closest): all windows that hold every clause and no smaller window that does."""
    marks = F.flatten(F.transform(places, lambda p, c: F.transform(p, lambda x: F.struct(x["end"].alias("end"), c.alias("clause"), x["start"].alias("start")))))
    # Bound as a lambda's variable, so the ordered marks are made once, not for each mark.
    ends = lambda m: F.transform(m, lambda x, i: F.struct(x["end"].alias("end"), x["clause"].alias("clause"), x["start"].alias("start"), F.coalesce(F.get(m, i + 1)["end"] != x["end"], F.lit(True)).alias("whole")))
    marks = F.flatten(F.transform(F.array(F.array_sort(marks)), ends))
    begin = F.struct(F.transform(places, lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("from"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("covers"), F.lit(None).cast("int").alias("closest"))

    def step(s: Column, m: Column) -> Column:
        last = F.transform(s["last"], lambda x, c: F.when(c == m["clause"], m["start"]).otherwise(x))
        at = F.array_min(last)
        new = m["whole"] & (at > s["from"])
        size = m["end"] - at + 1
        noise = F.greatest(F.lit(0), size - length)
        return F.struct(last.alias("last"), F.when(new, at).otherwise(s["from"]).alias("from"), (s["score"] + F.when(new, WEIGHT / (1 + noise)).otherwise(0.0)).alias("score"),
                        (s["covers"] + F.when(new, 1).otherwise(0)).alias("covers"), F.when(new, F.least(s["closest"], size)).otherwise(s["closest"]).alias("closest"))

    return F.aggregate(marks, begin, step)


def rank(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """texts (doc_id, text), asked (query_id, asked: a search line) -> query_id, doc_id, score, covers, closest (words of the smallest cover) of all texts that hold every clause and no excluded one.

    A cover is a smallest stretch of words that holds each clause; it scores WEIGHT / (1 + its words beyond those asked for),
    and a text the sum of its covers. Only texts with a query's rarest word are looked at: what they hold of its other words
    comes by a join on text and word, so a word of a third of the texts moves only what candidates need, and positions are
    one row a text and word. Null and empty texts hold nothing; lines that ask for nothing find nothing. Identifiers are unique.
    """
    q = stored(asked.select("query_id", F.posexplode(clauses(F.col("asked"))).alias("no", "c")).select("query_id", "no", "c.words", "c.negative"))
    words = q.select("query_id", "negative", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.min("negative").alias("negative"))
    found = stored(postings(texts, words.select("term").distinct()))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    rare = words.filter("not negative").join(df, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).select("query_id", F.col("r.term").alias("term"))
    pairs = found.select("doc_id", "term").join(rare, "term").select("query_id", "doc_id")
    held = pairs.join(words, "query_id").join(found, ["doc_id", "term"])
    must = words.filter("not negative").groupBy("query_id").agg(F.count("*").alias("must"))
    held = held.groupBy("query_id", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("at"), F.count_if(~F.col("negative")).alias("has"))
    held = held.join(must, "query_id").filter("has = must")
    lines = q.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("no", "words", "negative"))).alias("c"))
    none = F.array().cast("array<int>")
    shifted = lambda w, j: F.transform(F.coalesce(F.element_at("at", w), none), lambda p: p - j)

    def places(words: Column) -> Column:
        rest = F.slice(words, 2, F.size(words))
        starts = F.aggregate(F.transform(rest, lambda w, j: shifted(w, j + 1)), shifted(F.get(words, F.lit(0)), F.lit(0)), F.array_intersect)
        return F.transform(F.array_sort(starts), lambda p: F.struct(p.alias("start"), (p + F.size(words) - 1).alias("end")))

    held = held.join(lines, "query_id").withColumn("p", F.transform("c", lambda c: F.struct(c["negative"].alias("negative"), F.size(c["words"]).alias("size"), places(c["words"]).alias("places"))))
    held = held.filter(F.forall("p", lambda x: x["negative"] == (F.size(x["places"]) == 0)))
    wanted = F.filter("p", lambda x: ~x["negative"])
    held = held.withColumn("cover", _covers(wanted["places"], F.aggregate(wanted["size"], F.lit(0), lambda a, b: a + b)))
    return held.select("query_id", "doc_id", F.col("cover.score").alias("score"), F.col("cover.covers").alias("covers"), F.col("cover.closest").alias("closest"))

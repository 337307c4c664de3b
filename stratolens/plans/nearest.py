"""Searches with an index of cells: approximate with a measured recall, and exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, vector_search as R
from .base import Tables, query
from .search import SQL_COSINE, queries, sql_best, vectors


def _distances(found):
    return found.select("query_id", F.col("id").alias("vec_id"), "label", F.round(1 - F.col("cosine"), 6).alias("distance"))


@query()
def ann_topk(t: Tables):
    """The nearest 25 of each query in as many cells as a recall of 0.95 takes. Approximate: ann_recall holds it against the exact ones."""
    index = ann.build(vectors(t))
    return _distances(ann.search(index, queries(t), 25, ann.tune(index, 25), ["label"]))


@query(f"SELECT query_id, vec_id, label, round(1 - cosine, 6) AS distance FROM {sql_best(SQL_COSINE, 25, 'cosine DESC, vec_id')}")
def exact_topk_by_cells(t: Tables):
    """The nearest 25 of each query: cells that can't hold one of them stay closed."""
    return _distances(ann.exact(ann.build(vectors(t)), queries(t), 25, extra=["label"]))


@query("SELECT count(*) AS queries, 25 * count(*) AS neighbours, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(t: Tables):
    """Whether the approximate search finds at least 0.9 of the exact nearest 25."""
    index = ann.build(vectors(t))
    near = ann.search(index, queries(t), 25, ann.tune(index, 25)).select("query_id", "id", F.lit(1).alias("hit"))
    true = R.top_per_query(queries(t), vectors(t), 25).join(near, ["query_id", "id"], "left")
    return true.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("reached"))

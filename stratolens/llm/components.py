"""Connected components of an edge table, by passing minima along edges and up trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (id, label): each end with the smallest id it reaches. Rounds grow with the logarithm of a path's length; each is written to the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("n_id")).agg(F.min("label").alias("n_label"))
        step = labels.join(near, F.col("id") == F.col("n_id"), "left").select("id", "label", F.least("label", F.coalesce("n_label", "label")).alias("low"))
        hook = step.filter("low < label").groupBy(F.col("label").alias("h_id")).agg(F.min("low").alias("h_low"))
        step = step.join(hook, F.col("id") == F.col("h_id"), "left").select("id", "label", F.least("low", F.coalesce("h_low", "low")).alias("low"))
        step = stored(step, "labels-step")
        up = step.select(F.col("id").alias("u_id"), F.col("low").alias("u_low"))
        new = stored(step.join(up, F.col("low") == F.col("u_id"), "left").select("id", F.col("label").alias("old"), F.coalesce("u_low", "low").alias("label")), "labels")
        if new.filter("old != label").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")

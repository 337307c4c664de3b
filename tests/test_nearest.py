"""The index of cells, null assets in nested search, intervals of any length."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratolens.operators import ann, intervals as I, vector_search as R


@pytest.fixture(scope="module")
def clustered(spark):
    """600 vectors around 20 places, a third of the rows copies of one, some without a vector."""
    rng = np.random.default_rng(2)
    places = rng.normal(size=(20, 16))
    v = places[rng.integers(0, 20, 600)] + 0.2 * rng.normal(size=(600, 16))
    v[:200] = v[0]
    rows = [(i, [float(x) for x in r], i % 5) for i, r in enumerate(v)] + [(700, None, 1), (701, [0.0] * 16, 2), (None, [1.0] * 16, None)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3).cache()


@pytest.fixture(scope="module")
def asked(clustered):
    return clustered.filter("id % 7 = 3 or id in (700, 701)").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def rows_of(df):
    return sorted((r["query_id"], r["rank"], -1 if r["id"] is None else r["id"], round(r["cosine"], 9)) for r in df.collect())


def test_exact_search_by_cells(clustered, asked, monkeypatch):
    want = rows_of(R.top_per_query(asked, clustered, 12))
    for cells, probes, block in ((12, 2, 4096), (30, 1, 64)):  # also with the copies' cell and its queries in parts
        monkeypatch.setattr(ann, "BLOCK", block)
        assert rows_of(ann.exact(ann.build(clustered, cells), asked, 12, probes)) == want


def test_recall_is_what_was_asked_for(clustered, asked):
    index = ann.build(clustered, 24)
    probes = ann.tune(index, 10, 0.95, 200)
    assert 1 <= probes < 12  # cells follow the places, so few need to be opened
    near = {(q, i) for q, _, i, _ in rows_of(ann.search(index, asked.filter("q is not null and query_id <> 701"), 10, probes))}
    true = {(q, i) for q, _, i, _ in rows_of(R.top_per_query(asked.filter("q is not null and query_id <> 701"), clustered, 10))}
    assert len(near & true) >= 0.9 * len(true)
    every = ann.search(index, asked, 10, len(index.centroids))
    assert rows_of(every) == rows_of(R.top_per_query(asked, clustered, 10))


def test_recall_without_structure(spark):
    """Random directions are the worst case: more cells are opened, and the recall holds."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=24)]) for i in range(1500)], "id long, v array<float>")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    index = ann.build(rows)
    near = {(q, i) for q, _, i, _ in rows_of(ann.search(index, asked, 25, ann.tune(index, 25)))}
    true = {(q, i) for q, _, i, _ in rows_of(R.top_per_query(asked, rows, 25))}
    assert 0.9 * len(true) <= len(near & true)


def test_index_is_kept_and_added_to(spark, clustered, asked, tmp_path):
    half, rest = clustered.filter("coalesce(id, 0) % 2 = 0"), clustered.filter("id % 2 = 1")
    ann.build(half, 10).save(str(tmp_path / "index"))
    index = ann.load(spark, str(tmp_path / "index"))
    assert rows_of(ann.exact(index, asked, 5)) == rows_of(R.top_per_query(asked, half, 5))
    more = index.added(rest)
    assert more.rows.count() == clustered.count() == int(more.sizes.sum())
    assert rows_of(ann.exact(more, asked, 5)) == rows_of(R.top_per_query(asked, clustered, 5))


def test_tables_without_vectors(spark, clustered, asked):
    none = clustered.limit(0)
    index = ann.build(none)
    assert ann.search(index, asked, 5, 3).collect() == [] and ann.exact(index, asked, 5).collect() == [] and ann.tune(index, 5) == 1
    blank = clustered.withColumn("v", F.lit(None).cast("array<double>")).limit(4)
    assert {r["cosine"] for r in ann.search(ann.build(blank), asked, 5, 3).collect()} == {0.0}
    assert ann.search(ann.build(clustered), asked.limit(0), 5, 3).collect() == []


def test_a_null_asset_is_its_own(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 10], None if i < 3 else "None", True, False, False, 0.0, 1.0) for i in range(6)], "id long, v array<double>, asset string, always boolean, strict boolean, seen boolean, bonus double, weight double")
    found = R.nested(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>"), rows, "asset", 2, 0.1, 0.1, [])
    assert sorted((str(r["asset"]), r["id"]) for r in found.collect()) == [("None", 0), ("None", 1), ("None", 3), ("None", 4)]
    assert {r["asset"] for r in found.collect()} == {None, "None"}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_of_any_length_and_nulls(spark, how):
    rng = random.Random(1)
    make = lambda n: [(i, rng.choice(["a", "b", None]), s if rng.random() > 0.1 else None, s + rng.choice([0, 1, 5, 40, 900, 100_000]) if rng.random() > 0.1 else None) for i in range(n) for s in [rng.randrange(-500, 3000)]]
    left, right = make(60), make(70)
    l = spark.createDataFrame(left, "i int, key string, start long, end long")
    r = spark.createDataFrame(right, "j int, key string, r_start long, r_end long")
    want = []
    for i, k, a, z in left:
        met = [(i, j, min(z, y) - max(a, x)) for j, c, x, y in right if None not in (k, a, z, c, x, y) and k == c and y > a and x < z]
        want += met or ([(i, None, None)] if how == "left" else [])
    got = [(x["i"], x["j"], x["overlap"]) for x in I.overlap_join(l, r, ["key"], 10, how).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_year_is_in_few_buckets(spark):
    year = spark.createDataFrame([(1, "a", 0, 365 * 24 * 60)], "i int, key string, start long, end long")
    minutes = spark.range(1000).selectExpr("id as j", "'a' as key", "id * 100 as r_start", "id * 100 + 1 as r_end")
    joined = I.overlap_join(year, minutes, ["key"], 1)
    assert joined.count() == 1000
    widest = year.select(F.lit(1)).count() * (I.FAN + 1)
    cut = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" in cut and widest == I.FAN + 1

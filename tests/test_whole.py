"""The whole job: queries that no limit, border or subset cuts, on the smallest tables and on small fixtures."""

import duckdb
import pytest

import __spark_entry__ as entry
from test_queries import SF, TABLES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["hybrid_search_topk", "cosine_topk", "visual_topk_filtered", "appearance_cluster_collapse", "knowledge_vector_score", "search_inclusion"])
def test_search_takes_every_query_row(spark, duck, name):
    """test_queries.py compares the rows with the SQL, which has the same queries."""
    ids = [r[0] for r in duck.execute("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0 ORDER BY 1").fetchall()]
    found = sorted(r[0] for r in entry.queries()[name](spark, SF).select("query_id").distinct().collect())
    assert len(ids) > 1 and found == ids


def test_top_per_query_over_many_blocks(spark, monkeypatch):
    """Copies of one vector tie and go by id, whatever block they are in."""
    import numpy as np

    from stratolens.operators import vector_search as R

    monkeypatch.setattr(R, "BLOCK", 7)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 8))
    m[10:40] = m[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    q = df.filter("id % 3 = 0").selectExpr("id AS query_id", "v AS q")
    got = {}
    for r in R.top_per_query(q, df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    u = m / np.linalg.norm(m, axis=1)[:, None]
    assert got == {i: sorted(range(60), key=lambda j: (-round(float(u[i] @ u[j]), 10), j))[:5] for i in range(0, 60, 3)}


def test_gallery_takes_the_fourth_vector_of_an_identity(spark, tmp_path):
    v = [(1, 1, [1.0, 0.0, 0.0]), (2, 1, [1.0, 0.1, 0.0]), (3, 1, [1.0, 0.2, 0.0]), (4, 1, [0.0, 0.0, 1.0]), (5, 0, [0.0, 0.0, 1.0])]
    spark.createDataFrame(v, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: (r["identity"], r["similarity"]) for r in entry.queries()["gallery_match"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0), 3: (1, 1.0), 4: (0, 1.0), 5: (0, 1.0)}


def greedy(rows, budget):
    import re

    out = {}
    for source in {r[0] for r in rows}:
        kept, total = [], 0
        for _, i, n, text in sorted((r for r in rows if r[0] == source), key=lambda r: (-r[2], r[1])):
            h = re.sub(r"[\W_]+", " ", text.lower()).strip()
            if kept and (total + n > budget or any(h and k and (h in k or k in h) for _, k in kept)):
                continue
            kept.append((i, h))
            total += n
        out[source] = (len(kept), total, ",".join(str(i) for i, _ in kept))
    return out


def test_summary_goes_through_all_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id", "n_chars", "text").collect()]
    got = {r["source"]: (r["picked"], r["chars"], r["ids"]) for r in entry.queries()["extractive_summary_greedy"](spark, SF).collect()}
    assert got == greedy(rows, 30_000)


def test_summary_compares_whole_texts_and_goes_on_past_copies(spark, tmp_path, monkeypatch):
    from stratolens.operators import summaries

    monkeypatch.setattr(summaries, "ROUND", 2)
    same = "These texts begin alike but "
    texts = [same + "x" * 40, same + "y" * 40, *[same + "x" * 40] * 20, "y" * 30, "Other, text!", "other text", "tiny", "...", "--"]
    texts += ["z" * 29_700, "w" * 200]
    for source, some in (("a", texts[:-2]), ("b", texts), ("c", ["q" * 40_000, "r"])):
        rows = [(source, i, len(t), t) for i, t in enumerate(some, 100 * ord(source))]
        spark.createDataFrame(rows, "source string, doc_id long, n_chars long, text string").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("source", "doc_id", "n_chars", "text").collect()]
    want = greedy(rows, 30_000)
    assert want["a"][0] == 6 and want["c"][0] == 1
    assert {r["source"]: (r["picked"], r["chars"], r["ids"]) for r in entry.queries()["extractive_summary_greedy"](spark, str(tmp_path)).collect()} == want


def test_every_player_has_a_cover(spark):
    got = entry.queries()["player_cover_selection"](spark, SF).collect()
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert len(got) == orders.count() and len({r["player"] for r in got if r["covers"]}) == orders.select("o_custkey").distinct().count()


def test_tracks_and_clusters_have_no_borders(spark, tmp_path):
    from datetime import datetime as D

    e = [(1, D(2024, 1, 1, 22), 1, "view", 50.0, "{}"), (2, D(2024, 1, 1, 23, 59), 1, "view", 10.0, "{}"), (3, D(2024, 1, 2, 0, 1), 1, "view", 11.0, "{}")]
    spark.createDataFrame(e, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    q = entry.queries()
    assert {r["event_id"]: r["track"] for r in q["greedy_track_assignment"](spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 1}
    assert [tuple(r) for r in q["min_gap_thinning"](spark, str(tmp_path)).select("user_id", "n").collect()] == [(1, 2)]
    v = [(63, [1.0, 0.0], 0), (64, [1.0, 0.01], 0), (65, [1.0, 0.0], 0)]
    spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(63, "a"), (64, "a")], "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["vec_id"]: (r["asset"], r["cluster"]) for r in q["leader_clustering"](spark, str(tmp_path)).collect()}
    assert got == {63: ("a", 0), 64: ("a", 0), 65: ("", 0)}

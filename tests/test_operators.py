"""Operators on small fixtures: ties, nulls, empty tables, plain versions."""

import random

from pyspark.sql import functions as F

from stratolens.functions import text as X, vectors as V
from stratolens.operators import intervals as I, merging as M, vector_search as R


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(1)
    left = [(i, rng.randrange(3), s := rng.randrange(1000), s + rng.randrange(0, 300)) for i in range(60)] + [(60, 9, 5, 900)]
    right = [(i, rng.randrange(3), s := rng.randrange(1000), s + rng.randrange(1, 300)) for i in range(80)]
    l = spark.createDataFrame(left, "id long, k long, start long, end long")
    r = spark.createDataFrame(right, "r_id long, k long, r_start long, r_end long")
    want = sorted((a[0], b[0], min(a[3], b[3]) - max(a[2], b[2])) for a in left for b in right if a[1] == b[1] and b[3] > a[2] and b[2] < a[3])
    for bucket in (7, 100, 5000):
        got = I.overlap_join(l, r, ["k"], bucket).select("id", "r_id", "overlap").collect()
        assert sorted(map(tuple, got)) == want
        kept = I.overlap_join(l, r, ["k"], bucket, "left").select("id", "r_id", "overlap").collect()
        none = {a[0] for a in left} - {a for a, _, _ in want}
        assert none and sorted(map(tuple, kept), key=str) == sorted([*want, *((i, None, None) for i in none)], key=str)
    assert I.overlap_join(l, r.limit(0), ["k"], 10).count() == 0
    assert I.overlap_join(l, r.limit(0), ["k"], 10, "left").count() == 61 and "_id" not in I.overlap_join(l, r, ["k"], 10, "left").columns


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(3), rng.randrange(1000)) for i in range(60)]
    right = [(i, rng.randrange(3), rng.randrange(1000)) for i in range(40)]
    got = I.nearest(spark.createDataFrame(left, "id long, k long, at long"), spark.createDataFrame(right, "r_id long, k long, r_at long"), ["k"], 50, "r_id").collect()
    for r in got:
        near = sorted((abs(r["at"] - b[2]), b[2], b[0]) for b in right if b[1] == r["k"] and abs(r["at"] - b[2]) <= 50)
        assert (r["gap"], r["r_at"], r["r_id"]) == (near[0] if near else (None, None, None))
    assert len(got) == 60
    null = spark.createDataFrame([(1, 1, 10, None), (1, 1, 10, "x"), (2, None, 10, "x"), (3, 1, None, None)], "id long, k long, at long, note string")
    got = I.nearest(null, spark.createDataFrame([(7, 1, 12)], "r_id long, k long, r_at long"), ["k"], 50, "r_id").select("id", "note", "r_id").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "x", 7), (1, None, 7), (2, "x", None), (3, None, None)]


def test_coalesced_and_split(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 11, 20), ("a", 5, 6), ("a", 40, 50), ("b", 0, 1)], "k string, start long, end long")
    got = sorted(tuple(r) for r in I.coalesced(df, ["k"], 1).collect())
    assert got == [("a", 0, 20, 3), ("a", 40, 50, 1), ("b", 0, 1, 1)]
    parts = sorted(tuple(r) for r in I.split(df, 4).filter("k = 'a' and part >= 0").select("part", "start", "end").collect())
    assert all(z - a <= 4 for _, a, z in parts) and sum(z - a for _, a, z in parts) == 30


def test_merges(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (2, 5, None), (None, 1, "z")], "k long, o long, v string")
    assert sorted((tuple(r) for r in M.best_per_key(df, ["k"], F.col("o")).select("k", "v").collect()), key=str) == [(1, "y"), (2, None), (None, "z")]
    new = spark.createDataFrame([(2, 0, "n")], df.schema)
    assert {r["v"] for r in M.replaced(df.filter("k is not null"), new, F.col("k") == 2, ["k"], F.col("o")).collect()} == {"y", "n"}
    assert M.without(df, new, ["k"]).count() == 3
    assert M.best_per_key(df.limit(0), ["k"], F.col("o")).collect() == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.is_valid(F.col("a"), 2).alias("ok")).collect()
    assert abs(got[0]["c"] - 0.96) < 1e-12 and got[1]["c"] == 0 and [r["ok"] for r in got] == [True, False, False]


def test_fusion_keeps_rows_of_one_list(spark):
    v = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 2)], "id long, vec_score double, vec_rank int")
    l = spark.createDataFrame([(2, 1.0, 1), (3, 2.0, 2)], "id long, lex_score double, lex_rank int")
    got = {r["id"]: r["score"] for r in R.fused(v, l, "id", 10).collect()}
    assert got == {1: round(0.86 * 0.9 + 1 / 61, 6), 2: round(0.86 * 0.5 + 0.14 + 1 / 62 + 1 / 61, 6), 3: round(0.14 + 1 / 62, 6)}


def test_text(spark):
    df = spark.createDataFrame([("  Été   d'AOÛT the-end- x ",), ("",), (None,)], "t string")
    got = df.select(X.normalised(F.col("t")).alias("n"), X.keywords(F.col("t")).alias("k"), X.slug(F.col("t")).alias("s")).collect()
    assert tuple(got[0]) == ("ete d'aout the-end- x", ["ete", "aout", "the-end"], "ete-d-aout-the-end-x") and got[1]["k"] == [] and got[2]["n"] is None
    n = spark.createDataFrame([("1,234.5",), ("x",)], "t string").select(X.number(F.col("t"))).collect()
    assert [r[0] for r in n] == [1234.5, None]
    east = spark.createDataFrame([("생일 축하 ring 日本 a ü", 1)], "t string, i long")
    assert east.select(X.keywords(F.col("t"))).first()[0] == ["생일", "축하", "ring", "日本"]
    score = east.select(*[X.lexical_score(F.col("t"), [q]) for q in ("일 축", "생", "ring", "rin", "ring 日本", "U", "축하  RING", "日")]).first()
    assert list(score) == [1, 1, 1, 0, 1, 1, 1, 0]
    assert [r[0] for r in spark.createDataFrame([(7384,), (59,), (-3,)], "s long").select(X.minutes(F.col("s"))).collect()] == ["123:04", "0:59", "0:00"]
    row = spark.createDataFrame([("hello world-wide x_y", "football.final_third", "Yes", ["A  b", "a B", " ", None, "c"])], "a string, b string, c string, d array<string>")
    got = row.select(X.title_case(F.col("a")), X.readable(F.col("b")), X.boolean(F.col("c")), X.distinct_spellings(F.col("d"))).first()
    assert tuple(got) == ("Hello World-Wide X_y", "final third", True, ["A b", "c"])
    assert spark.range(1, 5).select(X.ordinal(F.col("id"))).collect()[3][0] == "4th"


def test_leader_clusters(spark):
    import numpy as np

    from stratolens.operators.clusters import greedy_tracks, leader_clusters

    rng = np.random.default_rng(3)
    rows = [(i // 20, i, rng.normal(size=4).tolist()) for i in range(60)]
    got = {r["key"]: r["cluster"] for r in leader_clusters(spark.createDataFrame(rows, "asset long, key long, v array<double>"), "asset", "key", "v", 0.5).collect()}
    for a in range(3):
        sums = []
        for _, k, v in rows[a * 20 : a * 20 + 20]:
            u = np.array(v) / np.linalg.norm(v)
            sims = [u @ s / np.linalg.norm(s) for s in sums]
            c = int(np.argmax(sims)) if sims and max(sims) >= 0.5 else len(sums)
            sums[c : c + 1] = [sums[c] + u] if c < len(sums) else [u]
            assert got[k] == c
    points = [("g", 1, 0, 1.0), ("g", 2, 0, 5.0), ("g", 3, 1, 1.2), ("g", 4, 1, 1.1), ("g", 5, 2, 5.1)]
    tracks = greedy_tracks(spark.createDataFrame(points, "g string, key long, t long, x double"), "g", "key", "t", "x", 1.0)
    assert [r["track"] for r in tracks.orderBy("key").collect()] == [0, 1, 2, 0, 1]


def test_files(spark, tmp_path):
    from stratolens.sources import files, sinks

    (tmp_path / "eng_2023-24.csv").write_text('Home Team,Home-Team,Note\n"A ""x""",B,"two\nlines"\n\nC,D,\n')
    df = files.read_csv(spark, str(tmp_path / "eng_2023-24.csv"))
    assert df.columns == ["home_team", "home_team_2", "note"] and sorted(map(tuple, df.collect()), key=str) == [('A "x"', "B", "two\nlines"), ("C", "D", None)]
    (tmp_path / "a.json").write_text('{"meta": 1, "rows": [{"Player Name": "x", "n": 2}, {"Player Name": "y"}]}')
    assert sorted(r["player_name"] for r in files.read_json_rows(spark, str(tmp_path / "a.json")).collect()) == ["x", "y"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.mp4").write_bytes(b"123")
    (tmp_path / "m/b.txt").write_bytes(b"123")
    assert [r["name"] for r in files.scan_media(spark, str(tmp_path / "m")).collect()] == ["a.mp4"]
    assert files.checksums(spark, str(tmp_path / "m"), "*.mp4").first()["sha256"].startswith("a665a459")
    log = spark.createDataFrame([("n:0 pts_time:1.5 x pts_time: 2",), ("silence_start: 3.25",), ("silence_end: 4 | d: 1",)], "value string")
    assert [r["at"] for r in files.scene_times(log).collect()] == [1.5, 2.0]
    assert sorted(tuple(r) for r in files.silences(log).collect()) == [("end", 4.0), ("start", 3.25)]
    p = spark.createDataFrame([('[{"position": "1200", "label": "goal", "confidence": "2"}]',), ('{"actions": [{"position": "x", "label": "foul"}]}',), ("{}",)], "value string")
    assert sorted((tuple(r) for r in files.predictions(p).collect()), key=str) == [(1200.0, "goal", 1.0), (None, "foul", 0.0)]
    p = spark.createDataFrame([('[{"time": 1200000, "class": "goal", "score": 0.5}, {"gameTime": "1 - 00:12", "label": "foul"}, {"label": "no time"}, {"position": "7", "name": " "}]',), ('{"events": [{"second": 12, "event": "card", "confidence": 3}]}',)], "value string")
    assert [tuple(r) for r in files.spots(p, 5400).collect()] == [(12.0, "card", 1.0), (12.0, "foul", 1.0), (1200.0, "goal", 0.5)]
    out = str(tmp_path / "out")
    sinks.rebuild(spark.createDataFrame([(1, "a"), (2, "b")], "v long, k string").repartition(1), out + "/x")
    for rows in ([(1, "a"), (2, "b")], [(3, "b")]):
        sinks.replace_partitions(spark.createDataFrame(rows, "v long, k string"), out + "/parts", "k")
    assert sorted(map(tuple, spark.read.parquet(out + "/parts").select("v", "k").collect())) == [(1, "a"), (3, "b")]
    both = sinks.write_batch({"job": out + "/job", "outbox": out + "/outbox"})
    for _ in range(2):
        both(spark.createDataFrame([("job", 1), ("outbox", 1)], "kind string, id long"), 7)
    assert spark.read.parquet(out + "/job").count() == 1 == spark.read.parquet(out + "/outbox").count()


def test_stream_progress(spark, tmp_path):
    from stratolens.streaming import jobs

    spark.createDataFrame([(1, 5.0), (1, 3.0), (2, 7.0)], "k long, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v double").parquet(str(tmp_path / "in"))
    got = {r["k"]: (r["best"], r["seen"]) for r in jobs.run(jobs.progress(stream, "k", "v"), "update").collect()}
    assert got == {1: (5.0, 2), 2: (7.0, 1)}

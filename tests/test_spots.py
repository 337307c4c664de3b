"""Candidates, ordered alignment and merged events of spotted actions against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from stratolens.operators import spotting as S


def test_candidates_equal_a_loop(spark):
    rng = random.Random(3)
    terms = lambda n: None if rng.random() < 0.1 else [rng.choice(["a", "b", "c", "d", "e", None][:n]) for _ in range(rng.randint(0, 3))]
    cues = [(rng.choice(["x", "y", None]), i if i % 11 else None, rng.choice([1, 2, 3, None]), terms(6), terms(3), terms(2)) for i in range(60)]
    plays = [(rng.choice(["x", "x", "y", None]), 100 + i, i % 7 if i % 9 else None, terms(6), terms(3), terms(2)) for i in range(50)]
    c = spark.createDataFrame(cues, "game string, cue int, at int, players array<string>, words array<string>, teams array<string>").withColumn("note", F.lit(1))
    p = spark.createDataFrame(plays, "game string, play int, play_at int, p_players array<string>, p_words array<string>, p_teams array<string>").withColumn("text", F.lit(1))
    got = S.candidates(c, p, ["game"], {"players": 20, "words": 10}, {"teams": 5}, 30, 15)
    want = set()
    own = lambda x: {t for t in x or [] if t is not None}
    for g, cue, at, *a in cues:
        if None in (g, cue, at):
            continue
        pairs = [(play, when, [len(own(x) & own(y)) for x, y in zip(a, b)]) for h, play, when, *b in plays if h == g and when is not None]
        wide = sum(s[0] > 0 or s[1] > 0 for _, _, s in pairs) < 30
        for play, when, (x, y, z) in pairs:
            if (x or y or (z and wide)) and (score := 20 * x + 10 * y + 5 * z) >= 15:
                want.add((g, cue, at, play, when, score, "players" if x else "words" if y else "teams"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and {r[-1] for r in rows} >= {"players", "words"}


def plain_chain(pairs):
    """By its definition: every pair's best chain, then the best of all."""
    pairs = sorted(set(pairs))
    best = {}
    for at, cue, play_at, play, score in pairs:
        before = [v for k, v in best.items() if k[:2] < (at, cue) and k[2:] < (play_at, play)]
        total, *_, chain = max(before, key=lambda v: v[0]) if before else (0, [])
        ties = [v for v in before if v[0] == total]
        if ties:
            chain = min(ties, key=lambda v: (v[1], v[2]))[3]
        best[at, cue, play_at, play] = (total + score, (play_at, play), (at, cue), [*chain, (at, cue, play_at, play, score)])
    return min(best.values(), key=lambda v: (-v[0], v[1], v[2]))[3] if best else []


@pytest.mark.parametrize("seed", range(4))
def test_alignment_keeps_order_and_is_dearest(spark, seed):
    rng = random.Random(seed)
    rows = {(g, rng.randint(0, 9), c, rng.randint(0, 9), p): rng.choice([1, 1, 2, 5, 9]) for g in ("x", "x2", "hot") for c in range(20) for p in range(20) if rng.random() < (0.6 if g == "hot" else 0.05)}
    data = [(*k, v) for k, v in rows.items()]
    df = spark.createDataFrame([*data, ("x", None, 1, 1, 1, 9), (None, 1, 1, 1, 1, 9), ("x", 1, 99, 1, 1, 0)], "game string, at int, cue int, play_at int, play int, score int").withColumn("more", F.lit(2))
    got = S.aligned(df.repartition(3), ["game"])
    for g in ("x", "x2", "hot"):
        found = sorted(tuple(r)[1:] for r in got.collect() if r["game"] == g)
        assert found == plain_chain([r[1:] for r in data if r[0] == g])
        assert all(a[:2] < b[:2] and a[2:4] < b[2:4] for a, b in zip(found, found[1:]))
    assert S.aligned(df.limit(0), ["game"]).collect() == []


def test_confidence_and_first_five(spark):
    cues = spark.createDataFrame([("g", 1, 10, "punt", 700), ("g", 2, 20, "pass", 900), ("g", 3, 30, "rush", 640)], "game string, cue long, at long, label string, base long")
    chosen = spark.createDataFrame([("g", 1, 7, 40), ("g", 2, 8, 500)], "game string, cue long, play long, score long")
    spots = S.predictions(cues, chosen, ["game"])
    assert {r["cue"]: (r["play"], r["confidence"]) for r in spots.collect()} == {1: (7, 786), 2: (8, 960), 3: (None, 640)}
    windows = spark.createDataFrame([("g", 50, 0, 25), ("g", 51, 20, 31), ("g", 52, 90, 95), ("g", 53, None, 9)], "game string, window long, start long, end long")
    events = spark.createDataFrame([(50, i, "own", 786 if i < 103 else 10) for i in range(100, 106)] + [(51, 1, "own", None), (99, 1, "own", 5)], "window long, id long, label string, confidence long")
    got = S.applied(windows, spots.withColumnRenamed("cue", "id"), events, ["game"], 16).collect()
    assert sorted((r["window"], r["rank"], r["kind"], r["id"]) for r in got) == [(50, 1, "spot", 2), (50, 2, "spot", 1), (50, 3, "event", 100), (50, 4, "event", 101), (50, 5, "event", 102), (51, 1, "spot", 2), (51, 2, "spot", 3)]

"""Candidates, constrained assignment and review against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from stratolens.operators import identity as D

SCOPE = ["asset", "segment"]
TRACK = "asset string, segment int, track string, start int, end int, zone string, lane string, n int, in_zone int, in_lane int, speed double, displacement double, clock boolean, context int, confirmed boolean"
ROSTER = "asset string, player int, group string, flipped boolean, valid_from int, valid_to int"
FACE = "asset string, segment int, track string, player int, face int"


def resolved(spark, tracks, roster, faces=()):
    found = D.candidates(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(roster, ROSTER), spark.createDataFrame(list(faces), FACE), SCOPE, "track", "player")
    return {(r["track"], r["player"]): (r["score"], r["face"], r["confidence"], r["status"]) for r in found.collect()}


def track(name="t", zone="final_third", lane="central", n=12, in_zone=9, in_lane=8, speed=0.04, displacement=0.08, clock=True, context=5500, confirmed=True, start=70, end=76):
    return ("a", 1, name, start, end, zone, lane, n, in_zone, in_lane, speed, displacement, clock, context, confirmed)


def test_zones_and_positions_narrow_the_roster(spark):
    roster = [("a", 7, "forward", False, 0, None), ("a", 4, "defender", False, 0, None), ("a", 1, "goalkeeper", False, 0, None), ("b", 9, "forward", False, 0, None), ("a", 8, None, False, 0, None)]
    got = resolved(spark, [track()], roster)
    assert got == {("t", 7): (1500, 0, 8400, "candidate"), ("t", 1): (1700, 0, 8600, "candidate")}
    assert resolved(spark, [track(n=1, in_zone=1, in_lane=1)], roster) == {}
    # The same place is the other end for a team that attacks the other way.
    assert resolved(spark, [track()], [("a", 4, "defender", True, 0, None), ("a", 7, "forward", True, 0, None)]) == {("t", 4): (1700, 0, 8600, "candidate")}


def test_faces_count_for_players_in_the_roster_only(spark):
    roster = [("a", 20, "unknown", False, 50, 80), ("a", 21, None, False, 76, None), ("a", 22, None, False, None, None)]
    got = resolved(spark, [track(clock=True)], roster, [("a", 1, "t", 20, 91), ("a", 1, "t", 20, 62), ("a", 1, "t", 21, 95), ("a", 1, "t", 99, 97), ("a", 1, "t", None, 97)])
    assert got == {("t", 20): (2180, 91, 9100, "confirmed")}
    assert resolved(spark, [track(clock=False)], roster, [("a", 1, "t", 20, 91)])[("t", 20)][3] == "candidate"
    assert resolved(spark, [track()], roster, [("a", 1, "t", 20, 61)]) == {}


def test_three_candidates_a_track(spark):
    roster = [("a", p, "forward", False, 0, None) for p in range(9)] + [("a", 3, "forward", False, 10, 90)]
    assert sorted(p for _, p in resolved(spark, [track()], roster, [("a", 1, "t", 8, 70)])) == [0, 1, 8]
    assert resolved(spark, [], roster) == {} and resolved(spark, [track()], []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_is_the_greedy_choice(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), rng.choice("pqrstuvw") if rng.random() > 0.05 else None, rng.randrange(9) if rng.random() > 0.05 else None, rng.choice([1, 5, 5, 9, None]), "x") for _ in range(150)]
    want = set()
    for scope in {r[:2] for r in rows}:
        left, right = set(), set()
        for s, l, r in sorted((-x[4], x[2], x[3]) for x in rows if x[:2] == scope and None not in x[2:5]):
            if l not in left and r not in right:
                left.add(l), right.add(r), want.add((*scope, l, r, -s))
    df = spark.createDataFrame(rows, "asset string, segment int, track string, player int, score int, note string").repartition(3)
    got = D.one_to_one(df, SCOPE, "track", "player", "score")
    assert got.columns == df.columns
    assert sorted(map(str, ((*r,)[:5] for r in got.collect()))) == sorted(map(str, want))
    assert D.one_to_one(df.limit(0), SCOPE, "track", "player", "score").collect() == []


def test_chains_take_a_round_a_link(spark):
    rows = [("a", 1, f"t{i:02d}", j, 100 - i - j) for i in range(8) for j in (i, i + 1)]
    got = D.one_to_one(spark.createDataFrame(rows, "asset string, segment int, track string, player int, score int"), SCOPE, "track", "player", "score")
    assert {(r["track"], r["player"]) for r in got.collect()} == {(f"t{i:02d}", i) for i in range(8)}


def review(candidates, log):
    """Plain: the log one by one."""
    state = {k: [c, s, None, 0, None] for k, c, s in candidates}
    for edit, key, decision, by in sorted({(e, k, d, b) for e, k, d, b in log if e is not None and k in state and d in ("confirmed", "rejected")}):
        x = state[key]
        state[key] = [0 if decision == "rejected" else max(x[0], 9800), decision, edit, x[3] + 1, by]
    return {k: tuple(v) for k, v in state.items()}


@pytest.mark.parametrize("seed", range(2))
def test_review_log(spark, seed):
    rng = random.Random(seed)
    keys = [("a", f"t{i}", i % 4) for i in range(12)]
    found = [(k, rng.choice([4000, 6100, 9900]), "candidate") for k in keys]
    log = [(e, rng.choice([*keys, ("a", "t404", 1), ("z", "t1", 1)]), rng.choice(["confirmed", "rejected", "rejected", "maybe"]), rng.choice(["x", None])) for e in range(40)] + [(None, keys[0], "rejected", "x")]
    names = ["asset", "track", "player"]
    df = spark.createDataFrame([(*k, c, s) for k, c, s in found], "asset string, track string, player int, confidence int, status string")
    edits = lambda some: spark.createDataFrame([(e, *k, d, b) for e, k, d, b in some], "edit long, asset string, track string, player int, decision string, reviewer string")
    plain = lambda out: {(r["asset"], r["track"], r["player"]): (r["confidence"], r["status"], r["last_edit"], r["reviews"], r["reviewer"]) for r in out.collect()}
    want = review(found, log)
    once = D.reviewed(df, edits(log + log[:7]), names)
    assert plain(once) == want
    # In cuts, and replayed.
    parts = D.reviewed(D.reviewed(D.reviewed(df, edits(log[:13]), names), edits(log[:25]), names), edits(log[13:] + log), names)
    assert plain(parts) == want
    kept = D.one_to_one(once.filter("status <> 'rejected'"), ["asset"], "track", "player", "confidence").collect()
    assert kept and all(want[(r["asset"], r["track"], r["player"])][1] != "rejected" for r in kept)
    told = {r["edit"]: r["outcome"] for r in D.outcomes(df, edits(log).filter("edit is not null"), names, ["asset"]).collect()}
    assert all(told[e] == ("applied" if k in dict((x[0], 1) for x in found) else "no_segment" if k[0] == "z" else "no_candidate") for e, k, _, _ in log if e is not None)
    assert D.reviewed(df.limit(0), edits(log), names).collect() == []

"""Who a track is: scored roster candidates, constrained assignment and reviewed decisions.

Scores are whole numbers of ten-thousandths, so that ties are ties on every engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import ordered
from .staging import stored

UNIT = 10_000


def team_zone(zone: Column, flipped: Column) -> Column:
    """A zone of the pitch as a team that attacks the other way sees it."""
    return F.when(flipped & (zone == "defensive_third"), "final_third").when(flipped & (zone == "final_third"), "defensive_third").otherwise(zone)


def movement_score(group: Column, zone: Column, lane: Column, n: Column, in_zone: Column, in_lane: Column, speed: Column, displacement: Column) -> Column:
    """How well a track's places fit a position group; n, in_zone and in_lane count its points. Under two points, or without a group, nothing fits."""
    share = lambda hits, percent: 100 * hits >= percent * n
    some = lambda *cases: reduce(lambda c, x: c.when(x[0], x[1]), cases[1:], F.when(*cases[0])).otherwise(0)
    # Points by position group, of 10000.
    keeper = some(((zone != "middle_third") & share(in_zone, 45) & (speed <= 0.06) & (displacement <= 0.12), 1400))
    defender = some((zone == "defensive_third", 1200), (zone == "middle_third", 700)) + some((speed <= 0.08, 200))
    midfielder = some((zone == "middle_third", 1200)) + some(((lane == "central") & share(in_lane, 45), 300))
    forward = some((zone == "final_third", 1200), (zone == "middle_third", 600))
    wide = some((lane != "central", 1100)) + some((zone != "defensive_third", 400))
    base = some((group == "goalkeeper", keeper), (group == "defender", defender), (group == "midfielder", midfielder), (group == "forward", forward), (group == "wide", wide))
    return F.when((n >= 2) & (base > 0), F.least(F.lit(2200), base + some((share(in_zone, 55), 300)))).otherwise(0)


def candidates(tracks: DataFrame, roster: DataFrame, faces: DataFrame, scope: Sequence[str], track: str, player: str, keep: int = 3) -> DataFrame:
    """The best `keep` players of each track: scope, track, player, score, face, confidence, status.

    tracks: scope, track, start, end (exclusive), zone, lane, n, in_zone, in_lane, speed, displacement, clock (a clock was
    read), context (confidence of the match, of 10000) and confirmed; roster: the scope's columns that it has, player, group,
    flipped, valid_from, valid_to (exclusive; null: no end); faces: scope, track, player and face, a confidence in hundredths
    (the highest counts). A player is a candidate while a window of theirs shares time with the track, if the score is 0.14
    or the face 0.62. Rows with a null scope, track or player have no candidates. Ties go to the smaller player.
    """
    shared = [c for c in scope if c in roster.columns]
    in_time = (F.col("start") < F.coalesce("valid_to", F.lit((1 << 63) - 1))) & (F.col("end") > F.col("valid_from"))
    met = tracks.join(roster, shared).filter(in_time).drop("valid_from", "valid_to").dropDuplicates([*scope, track, player])
    best_face = faces.groupBy(*scope, track, player).agg(F.max("face").alias("face"))
    met = met.join(best_face, [*scope, track, player], "left").withColumn("face", F.greatest(F.lit(0), F.least(F.lit(98), F.coalesce("face", F.lit(0)))))
    zone = team_zone(F.col("zone"), F.col("flipped"))
    moved = movement_score(F.col("group"), zone, F.col("lane"), F.col("n"), F.col("in_zone"), F.col("in_lane"), F.col("speed"), F.col("displacement"))
    known = F.col("face") >= 62
    seen = F.when(known, F.least(F.lit(2400), F.expr("(face * 24 + 5) div 10 * 10"))).otherwise(0)
    met = met.withColumn("score", F.least(F.lit(4200), moved + seen).cast("int")).filter((F.col("score") >= 1400) | known)
    met = ordered.top_per_group(met, [*scope, track], keep, [F.col("score").desc(), F.col("face").desc(), F.col(player)], player)
    sure = F.col("context") + 1000 + F.least(F.lit(1800), F.col("score")) + F.when(known, F.col("face") * 18).otherwise(0) + F.when(F.col("clock"), 400).otherwise(0)
    status = F.when((F.col("face") >= 88) & F.col("confirmed") & F.col("clock"), "confirmed").otherwise("candidate")
    confidence = F.least(F.lit(9100), sure).cast("int")
    return met.select(*scope, track, player, "score", F.col("face").cast("int").alias("face"), confidence.alias("confidence"), status.alias("status"))


def one_to_one(pairs: DataFrame, scope: Sequence[str], left: str, right: str, score: str) -> DataFrame:
    """Of each scope the pairs a greedy choice by score takes, each left and each right at most once; ties to the smaller left, then right.

    A pair that is the best of both its sides is what the greedy choice takes of them, whatever else there is; so all such
    pairs are taken at once, what they exclude goes, and so on. No scope meets in one task. There are as many rounds as pairs
    can wait for one another in a chain; the rows left, at least one a scope fewer each round, are written between. Pairs with
    a null left, right or score are never taken; a null scope is a scope; of repeated pairs the best counts.
    """
    order = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    open_ = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(score).isNotNull()).withColumn("_order", order)
    open_ = stored(open_.groupBy(*scope, left, right).agg(F.min_by(F.struct(*[c for c in pairs.columns if c not in (*scope, left, right)], "_order"), "_order").alias("_row")).select(*scope, left, right, "_row.*"))
    taken = open_.limit(0)

    def beside(df: DataFrame, other: DataFrame, side: str, how: str) -> DataFrame:
        other = other.select(*[F.col(c).alias(f"_x_{c}") for c in (*scope, side)], *[c for c in other.columns if c.startswith("_best")])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_x_{c}")) for c in (*scope, side)])
        return df.join(other, same, how).drop(*[f"_x_{c}" for c in (*scope, side)])

    while not open_.isEmpty():
        both = open_
        for side, name in ((left, "_best_l"), (right, "_best_r")):
            both = beside(both, open_.groupBy(*scope, side).agg(F.min("_order").alias(name)), side, "inner")
        chosen = stored(both.filter((F.col("_order") == F.col("_best_l")) & (F.col("_order") == F.col("_best_r"))).drop("_best_l", "_best_r"))
        taken = taken.unionByName(chosen)
        open_ = stored(beside(beside(open_, chosen, left, "left_anti"), chosen, right, "left_anti"))
    return taken.select(pairs.columns)


def reviewed(found: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates after the review log: the last edit of a candidate wins.

    found: keys, confidence (of 10000), status, and what earlier applications left (last_edit, reviews); edits: keys, edit (a
    number that orders the log), decision (confirmed or rejected), reviewer. A confirmed candidate has a confidence of at
    least 0.98, or just that if it had been rejected before; a rejected one has 0. Edits up to a candidate's last_edit are
    known already, so a log may be replayed, and applied in any cuts that keep its order. An edit that is there twice counts
    once; one with a null key, number or another decision changes nothing.
    """
    for c, kind in (("last_edit", "long"), ("reviews", "long"), ("reviewer", "string")):
        if c not in found.columns:
            found = found.withColumn(c, F.lit(0 if c == "reviews" else None).cast(kind))
    log = edits.filter(F.col("edit").isNotNull() & F.col("decision").isin("confirmed", "rejected")).select(*[F.col(k).alias(f"_e_{k}") for k in keys], "edit", "decision", F.col("reviewer").alias("_by")).dropDuplicates([*[f"_e_{k}" for k in keys], "edit"])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_e_{k}") for k in keys])
    marks = found.select(*keys, "last_edit").join(log, same).filter(F.col("last_edit").isNull() | (F.col("edit") > F.col("last_edit")))
    fold = marks.groupBy(*keys).agg(F.max("edit").alias("_edit"), F.max_by("decision", "edit").alias("_decision"), F.max_by("_by", "edit").alias("_reviewer"), F.max((F.col("decision") == "rejected").cast("int")).alias("_was"), F.count("*").alias("_n"))
    out = found.join(fold, list(keys), "left")
    sure = F.when(F.col("_decision") == "rejected", 0).when(F.col("_was") == 1, 9800).otherwise(F.greatest(F.col("confidence"), F.lit(9800)))
    edited = F.col("_edit").isNotNull()
    return out.select(*[c for c in found.columns if c not in ("confidence", "status", "last_edit", "reviews", "reviewer")], F.when(edited, sure).otherwise(F.col("confidence")).cast("int").alias("confidence"), F.coalesce("_decision", "status").alias("status"), F.coalesce("_edit", "last_edit").alias("last_edit"), (F.col("reviews") + F.coalesce("_n", F.lit(0))).alias("reviews"), F.when(edited, F.col("_reviewer")).otherwise(F.col("reviewer")).alias("reviewer"))


def outcomes(found: DataFrame, edits: DataFrame, keys: Sequence[str], segment: Sequence[str]) -> DataFrame:
    """edit and outcome of each edit: applied, no_candidate (its segment has others) or no_segment."""
    there = found.select(*keys).distinct().withColumn("_hit", F.lit(True))
    segments = found.select(*segment).distinct().withColumn("_segment", F.lit(True))
    out = edits.join(there, list(keys), "left").join(segments, list(segment), "left")
    return out.select("edit", F.when(F.col("_hit"), "applied").when(F.col("_segment"), "no_candidate").otherwise("no_segment").alias("outcome"))

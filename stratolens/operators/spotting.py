"""Cues of a recording aligned with the recorded plays of a game, in order, and what becomes of the events of its windows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .intervals import overlap_join
from .ordered import top_per_group
from .staging import stored


def candidates(cues: DataFrame, plays: DataFrame, scope: Sequence[str], indexes: Mapping[str, int], fallback: Mapping[str, int], few: int, least: int, bonus: Column | None = None) -> DataFrame:
    """cues (scope, cue, at, arrays of terms) and plays (scope, play, play_at, the same arrays with p_ before their names; other columns of both may be used by bonus) -> scope, cue, at, play, play_at, score (long), found_by (the first index that holds the pair).

    A pair is a candidate if it shares a term of any array in indexes; a cue with fewer than few of those also takes the pairs
    of the arrays in fallback. Of a candidate, each shared term of any array counts the array's points, and bonus is added;
    those with a score of least or more are given.

    A pair is kept in the first index and at the first term that it shares, so none is made unique by a shuffle. Scopes should
    be parts of a game (a quarter, a day): pairs meet inside one. Rows with a null in scope, cue or play, at or play_at meet
    nothing, nor do null or missing terms; repeated terms count once. cue and play are unique in a scope.
    """
    names = [*indexes, *fallback]
    some = lambda c: F.array_compact(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    cues = cues.withColumns({n: some(n) for n in names}).filter("cue is not null and at is not null")
    plays = plays.withColumns({f"p_{n}": some(f"p_{n}") for n in names}).filter("play is not null and play_at is not null")
    plays = plays.withColumnsRenamed({k: f"_p_{k}" for k in scope})
    points = indexes | fallback
    score = sum((F.size(F.array_intersect(n, f"p_{n}")) * F.lit(points[n]) for n in names), F.lit(0) if bonus is None else F.coalesce(bonus, F.lit(0)))

    def found(left: DataFrame, name: str, earlier: Sequence[str]) -> DataFrame:
        l, r = left.withColumn("_term", F.explode(name)), plays.withColumn("_p_term", F.explode(f"p_{name}"))
        on = F.col("_term") == F.col("_p_term")
        for k in scope:
            on &= F.col(k) == F.col(f"_p_{k}")
        for e in earlier:
            on &= ~F.arrays_overlap(e, f"p_{e}")
        met = l.join(r, on & (F.col("_term") == F.array_min(F.array_intersect(name, f"p_{name}"))))
        return met.select(*scope, "cue", "at", "play", "play_at", score.cast("long").alias("score"), F.lit(name).alias("found_by"))

    def union(left: DataFrame, which: Sequence[str], earlier: Sequence[str]) -> DataFrame:
        out = found(left, which[0], earlier)
        for i, n in enumerate(which[1:], 1):
            out = out.unionByName(found(left, n, [*earlier, *which[:i]]))
        return out

    first = union(cues, list(indexes), [])
    if fallback:
        first = stored(first)
        enough = first.groupBy(*scope, "cue").agg(F.count("*").alias("_n")).filter(F.col("_n") >= few)
        first = first.unionByName(union(cues.join(enough, [*scope, "cue"], "left_anti"), list(fallback), list(indexes)))
    return first.filter(F.col("score") >= least)


def _chains(n_scope: int):
    """Rows (scope, at, cue, play_at, play, score, n) ordered by scope, at and cue -> the rows of each scope's dearest chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = cue = schema = None
        nodes, keys, front, waiting = [], [], [], []  # nodes: (row, total, node before); front: the places where totals rise

        def settle() -> None:
            """The pairs of one cue join the front; before that they can't follow one another."""
            for key, node in waiting:
                at = bisect_left(keys, key)
                here = at < len(keys) and keys[at] == key
                if (here and nodes[front[at]][1] >= nodes[node][1]) or (at and nodes[front[at - 1]][1] >= nodes[node][1]):
                    continue
                end = at
                while end < len(keys) and nodes[front[end]][1] <= nodes[node][1]:
                    end += 1
                keys[at:end], front[at:end] = [key], [node]
            waiting.clear()

        def chain() -> list:
            settle()
            out, node = [], front[-1] if front else None
            while node is not None:
                out.append(nodes[node][0])
                node = nodes[node][2]
            for x in (nodes, keys, front):
                x.clear()
            return out

        def table(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            schema = schema or b.schema
            done = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:n_scope] != scope:
                    done += chain()
                    scope, cue = row[:n_scope], None
                now = row[n_scope : n_scope + 2]
                if now != cue:
                    settle()
                    cue = now
                key, score = row[n_scope + 2 : n_scope + 4], row[n_scope + 4]
                at = bisect_left(keys, key)
                before = front[at - 1] if at else None
                waiting.append((key, len(nodes)))
                nodes.append((row, score + (nodes[before][1] if at else 0), before))
            yield table(done)
        if schema is not None:
            yield table(chain())

    return run


def aligned(pairs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Of pairs (scope, cue, at, play, play_at, score), those of the dearest chain of each scope: from one pair to the next both the cue (by at, then cue) and the play (by play_at, then play) go forward, so order is kept and none is used twice; their scores add up to the most.

    Of chains that cost the same the one whose last play is earliest is taken, then whose last cue is, and so on backwards.
    Rows are sorted by scope; a task walks over them, finds the dearest chain so far by bisection, and holds the pairs of one
    scope at a time. Rows with a null, or a score under 1, are left out. Columns other than those named go.
    """
    names = [*scope, "at", "cue", "play_at", "play", "score"]
    rows = pairs.select(*names).dropna().filter("score > 0").repartition(*scope).sortWithinPartitions(*names)
    return rows.mapInArrow(_chains(len(scope)), rows.schema)


def predictions(cues: DataFrame, chosen: DataFrame, scope: Sequence[str]) -> DataFrame:
    """cues (scope, cue, at, label, base: confidence in thousandths) with the play of chosen, if any: scope, cue, label, at, play, score, confidence.

    An aligned play's own confidence is 520 and 50 a point of ten, 960 at most; 12% of it go to the cue's, 960 at most. Cues
    without a play stay with their own.
    """
    out = cues.select(*scope, "cue", "at", "label", "base").join(chosen.select(*scope, "cue", "play", "score"), [*scope, "cue"], "left")
    own = F.least(F.lit(960), 520 + F.col("score") * 5)
    both = F.least(F.lit(960), F.col("base") + F.floor(own * 12 / 100)).cast("long")
    return out.select(*scope, "cue", "label", "at", "play", "score", F.when(F.col("play").isNull(), F.col("base").cast("long")).otherwise(both).alias("confidence"))


def applied(windows: DataFrame, spots: DataFrame, events: DataFrame, keys: Sequence[str], bucket: int, k: int = 5) -> DataFrame:
    """windows (keys, window, start, end), spots (keys, at, id, label, confidence) and the trusted events that windows have already (window, id, label, confidence) -> the first k of both of each window: keys, window, rank, kind (spot or event), id, label, confidence.

    By falling confidence, spots before events, then id. Windows without either have no row, nor have rows without confidence.
    """
    points = spots.select(*keys, F.col("at").alias("r_start"), (F.col("at") + 1).alias("r_end"), "id", "label", "confidence")
    within = overlap_join(windows.select(*keys, "window", "start", "end"), points, keys, bucket).select(*keys, "window", F.lit("spot").alias("kind"), "id", "label", "confidence")
    own = windows.select(*keys, "window").join(events.select("window", "id", "label", "confidence"), "window").select(*keys, "window", F.lit("event").alias("kind"), "id", "label", "confidence")
    rows = within.unionByName(own).filter("confidence is not null")
    order = [F.col("confidence").desc(), F.col("kind").desc(), F.col("id")]
    return top_per_group(rows, [*keys, "window"], k, order, "id")

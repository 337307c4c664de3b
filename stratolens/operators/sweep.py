"""Windows with all the layers of their asset, in one sweep over time."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def _sweep(size: int, layers: int):
    """Rows (part, start, end, layer, id, key) ordered by key, part and start -> (id, layer, n, overlap, first, best) of each window, part and layer where any row meets it. Layer -1 is the windows."""
    names = ["id", "layer", "n", "overlap", "first_start", "first_id", "best_overlap", "best_start", "best_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, rows, out = None, [], [[] for _ in range(layers)], []

        def meet(window: tuple, start: int, end: int, layer: int, ident: int) -> None:
            w_end, _, w_id, w_start, found = window
            begin = max(start, w_start)
            if begin < now[1] * size:  # met in an earlier part
                return
            over = min(end, w_end) - begin
            n, total, first, best = found.get(layer, (0, 0, (start, ident), (-over, start, ident)))
            found[layer] = n + 1, total + over, min(first, (start, ident)), min(best, (-over, start, ident))

        def close(window: tuple) -> None:
            out.extend((window[2], layer, n, total, *first, -best[0], *best[1:]) for layer, (n, total, first, best) in window[4].items())

        def table() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names=names)
            out.clear()
            return batch

        count = 0
        for b in batches:
            for part, start, end, layer, ident, key in zip(*(c.to_pylist() for c in b.columns)):
                if now != (key, part):
                    for w in windows:
                        close(w)
                    now, windows, rows = (key, part), [], [[] for _ in range(layers)]
                while windows and windows[0][0] <= start:
                    close(heapq.heappop(windows))
                if layer < 0:
                    count += 1
                    window = (end, count, ident, start, {})
                    for k, active in enumerate(rows):
                        while active and active[0][0] <= start:
                            heapq.heappop(active)
                        for r_end, r_start, r_id in active:
                            meet(window, r_start, r_end, k, r_id)
                    heapq.heappush(windows, window)
                else:
                    for w in windows:
                        meet(w, start, end, layer, ident)
                    heapq.heappush(rows[layer], (end, start, ident))
                if len(out) > 1 << 16:
                    yield table()
            yield table()
        for w in windows:
            close(w)
        yield table()

    return run


def layered(windows: DataFrame, layers: Mapping[str, DataFrame], part: int) -> DataFrame:
    """windows and layers (key, id, start, end; id, start and end as long) -> each window with <layer>_n (rows that share time with it), <layer>_overlap (their time in common, summed), <layer>_first (id of the earliest) and <layer>_best (of the one with most time in common, then the earliest) for each layer.

    All layers are unioned and ordered once. A key's time is cut into parts, so a key of a third of all rows is many tasks; an
    interval is a row in each part that it touches, and a pair counts in the part where the later of both begins. Memory holds
    what is open at one time, not a key. Ids of windows are unique. Windows that meet nothing stay, with 0 and nulls, as do
    those with a null or without length; such rows of layers meet nothing. Ties go to the smaller id. Other columns are left out.
    """
    one = lambda df, k: df.select("key", F.col("id").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), F.lit(k).cast("long").alias("layer"))
    rows = one(windows, -1)
    for k, df in enumerate(layers.values()):
        rows = rows.unionByName(one(df, k))
    rows = rows.filter("end > start and key is not null and id is not null").withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / part), F.floor((F.col("end") - 1) / part))))
    # Windows come after rows that begin with them or before; the order of ties changes nothing.
    rows = rows.select("part", "start", "end", "layer", "id", "key").repartition("key", "part").sortWithinPartitions("key", "part", "start")
    met = rows.mapInArrow(_sweep(part, len(layers)), "id long, layer long, n long, overlap long, first_start long, first_id long, best_overlap long, best_start long, best_id long")
    of = lambda k, c: F.when(F.col("layer") == k, c)
    each = []
    for k, name in enumerate(layers):
        each += [F.sum(of(k, F.col("n"))).alias(f"{name}_n"), F.sum(of(k, F.col("overlap"))).alias(f"{name}_overlap"), F.min(of(k, F.struct("first_start", "first_id"))).alias(f"{name}_first")]
        each += [F.min(of(k, F.struct(-F.col("best_overlap"), "best_start", "best_id"))).alias(f"{name}_best")]
    met = met.withColumnRenamed("id", "m_id").groupBy("m_id").agg(*each)
    out = windows.select("key", "id", "start", "end").join(met, F.col("id") == F.col("m_id"), "left")
    for name in layers:
        out = out.withColumns({f"{name}_n": F.coalesce(f"{name}_n", F.lit(0)), f"{name}_overlap": F.coalesce(f"{name}_overlap", F.lit(0)), f"{name}_first": F.col(f"{name}_first.first_id"), f"{name}_best": F.col(f"{name}_best.best_id")})
    return out.drop("m_id")

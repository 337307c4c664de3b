"""Order-dependent clustering and assignment inside an asset, whose rows are few."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def leader_clusters(df: DataFrame, asset: str, key: str, vector: str, least: float = 0.86) -> DataFrame:
    """asset, key, cluster, similarity. In order of key each vector joins the most similar cluster (cosine to its mean of at least `least`) or begins one; clusters are numbered by their first member. An asset's vectors are taken together: assets are bounded."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key, kind="stable")
        unit = np.stack([v / (np.linalg.norm(v) or 1) for v in (np.asarray(x, float) for x in f[vector])])
        sums, length, n = np.empty((64, unit.shape[1])), np.ones(64), 0
        of = np.empty(len(unit), np.int64)
        for i, v in enumerate(unit):
            sims = sums[:n] @ v / length[:n]
            best = int(np.argmax(sims)) if n else -1
            if best >= 0 and sims[best] >= least:
                sums[best] += v
            else:
                if n == len(sums):
                    sums, length = np.concatenate([sums, np.empty_like(sums)]), np.concatenate([length, np.ones_like(length)])
                best, n = n, n + 1
                sums[best] = v
            length[best] = np.linalg.norm(sums[best]) or 1
            of[i] = best
        close = np.concatenate([(unit[i : i + 4096] * sums[of[i : i + 4096]]).sum(1) / length[of[i : i + 4096]] for i in range(0, len(unit), 4096)])
        return pd.DataFrame({asset: f[asset].to_numpy(), key: f[key].to_numpy(), "cluster": of, "similarity": close})

    a, k = (df.schema[c].dataType.simpleString() for c in (asset, key))
    return df.select(asset, key, vector).groupBy(asset).applyInPandas(one, f"{asset} {a}, {key} {k}, cluster long, similarity double")


def greedy_tracks(df: DataFrame, group: str, key: str, time: str, place: str, most: float) -> DataFrame:
    """group, key, track. In order of time each point takes the nearest open track that no point of the same time has, within `most` of its last place, or opens one. Partitions hold whole groups, sorted; the open tracks go on from batch to batch."""

    def many(batches):
        last: list[float] = []
        used: set[int] = set()
        now: tuple = ()
        for b in batches:
            out = []
            for g, t, p in zip(b[group].to_pylist(), b[time].to_pylist(), b[place].to_pylist()):
                if now[:1] != (g,):
                    last = []
                if now != (g, t):
                    now, used = (g, t), set()
                free = [(abs(p - q), i) for i, q in enumerate(last) if i not in used and abs(p - q) <= most]
                i = min(free)[1] if free else len(last)
                last[i:i + 1] = [p]
                used.add(i)
                out.append(i)
            yield pa.record_batch([b[group], b[key], pa.array(out, pa.int64())], names=[group, key, "track"])

    g, k = (df.schema[c].dataType.simpleString() for c in (group, key))
    return df.select(group, key, time, place).repartition(group).sortWithinPartitions(group, time, place, key).mapInArrow(many, f"{group} {g}, {key} {k}, track long")

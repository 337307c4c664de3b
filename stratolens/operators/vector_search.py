"""Vector, lexical and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import ordered

#: Rows of a block, on average; rows of the queries' block whose cosines are held at once; pairs recomputed at once.
BLOCK, CHUNK, PAIRS = 4096, 256, 65_536
#: Rows of a block where all pairs of two blocks may be results.
ALL = 1024
#: More than a matrix product and a sum in order can differ by.
SLACK = 1e-9


def _matrix(a: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, with their lengths; a missing vector is zero."""
    rows = a.to_pylist() if a.null_count else None
    if rows is None:
        m = a.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(a), -1)
    else:
        dims = max((len(x) for x in rows if x is not None), default=1)
        m = np.array([np.zeros(dims) if x is None else x for x in rows], float)
    n = np.sqrt((m * m).sum(1))
    return m, np.where(n == 0, 1.0, n)


def _numbers(c: pa.ChunkedArray) -> np.ndarray:
    """A column of whole numbers to sort and compare by; nulls come first."""
    return c.to_numpy() if not c.null_count else c.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()


def _blocks(queries: DataFrame, rows: DataFrame, pick: _Top | _Within | _Nested, schema: str, extra: Sequence[str], block: int) -> DataFrame:
    """Every query (query_id, q) against every row (id, v, bonus and extra): each block of queries meets each block of rows in one group. pick gets cosines of some queries and the rows of a block, and gives the pairs of interest; those are recomputed as a sum over the vector alone, so that equal vectors tie."""
    n_q, n_r = (max(1, -(-df.count() // block)) for df in (queries, rows.select("id")))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "q", part("query_id", n_q).alias("_qb")).withColumn("_rb", each(n_r))
    right = rows.withColumn("_rb", part("id", n_r)).withColumn("_qb", each(n_q))
    return left.groupBy("_qb", "_rb").cogroup(right.groupBy("_qb", "_rb")).applyInArrow(meeting(pick, schema, extra), schema)


def meeting(pick: _Top | _Within | _Nested, schema: str, extra: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a block of queries (query_id, q) and a block of rows (id, v, bonus, extra) give: see _blocks."""
    names = [x.split()[0] for x in schema.split(", ")]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if a.num_rows and b.num_rows:
            q, q_len = _matrix(a["q"])
            r, r_len = _matrix(b["v"])
            if q.shape[1] != r.shape[1]:  # no vector on one side
                q, r = (np.pad(x, ((0, 0), (0, max(q.shape[1], r.shape[1]) - x.shape[1]))) for x in (q, r))
            q_unit, r_unit = q / q_len[:, None], (r / r_len[:, None]).T
            q_id, r_id, bonus = _numbers(a["query_id"]), _numbers(b["id"]), b["bonus"].to_numpy()
            for at in range(0, len(q), CHUNK):
                z = at + CHUNK
                i, j = pick.near(q_unit[at:z] @ r_unit, bonus, b)
                i = i + at
                cos = np.empty(len(i))
                for k in range(0, len(i), PAIRS):
                    x, y = i[k : k + PAIRS], j[k : k + PAIRS]
                    cos[k : k + PAIRS] = pick.cut((q[x] * r[y]).sum(1) / (q_len[x] * r_len[y]))
                keep = pick.best(q_id[i], r_id[j], cos, bonus[j], b, j)
                i, j, cos = i[keep], j[keep], cos[keep]
                found.append(pa.table({"query_id": a["query_id"].take(pa.array(i)), "id": b["id"].take(pa.array(j)), "cosine": cos, "score": pick.score(cos, bonus[j], b, j), **{c: b[c].take(pa.array(j)) for c in extra}}).select(names))
        return pa.concat_tables(found) if found else pa.table({c: pa.array([], t) for c, t in zip(names, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[b.schema.field(c).type for c in extra]])})

    return meet


class _Pick:
    @staticmethod
    def cut(cos):
        """Cosines as they count and are given."""
        return cos


class _Top(_Pick):
    """The best k rows a query, the smaller tie (a column) first among equals."""

    def __init__(self, k: int, weight: float, tie: str):
        self.k, self.weight, self.tie = k, weight, tie

    def near(self, cos, bonus, b):
        s = self.weight * cos + bonus
        if self.k < s.shape[1]:
            return np.nonzero(s >= np.partition(s, -self.k, axis=1)[:, -self.k][:, None] - SLACK)
        return np.nonzero(np.ones_like(s, bool))

    def score(self, cos, bonus, b, j):
        return self.weight * cos + bonus

    def best(self, q, r, cos, bonus, b, j):
        order = np.lexsort((r, _numbers(b[self.tie])[j], -(self.weight * cos + bonus), q))
        first = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0]) if len(q) else np.array([], int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        return order[rank < self.k]


class _Within(_Pick):
    """All rows with a cosine of at least `least`, and those whose bonus isn't 0."""

    def __init__(self, least: float):
        self.least = least

    def score(self, cos, bonus, b, j):
        return cos + bonus

    def near(self, cos, bonus, b):
        return np.nonzero((cos >= self.least - SLACK) | (bonus != 0))

    def best(self, q, r, cos, bonus, b, j):
        return np.flatnonzero((cos >= self.least) | (bonus != 0))


class _Nested(_Pick):
    """The best k rows a query and group by bonus + weight x cosine + also x cosine (where seen), added in this order; cosines are cut to three places and at 0. Rows with `always` compete in any case, others where their cosine reaches one of two bounds; of a group with any `always` rows (`strict`), only those."""

    def __init__(self, k: int, group: str, semantic: float, visual: float, also: float):
        self.k, self.group, self.semantic, self.visual, self.also = k, group, semantic, visual, also

    def score(self, cos, bonus, b, j):
        return bonus + b["weight"].to_numpy()[j] * cos + self.also * np.where(b["seen"].to_numpy(zero_copy_only=False)[j], cos, 0)

    @staticmethod
    def cut(cos):
        """Halves are rounded up."""
        x = np.maximum(0, cos) * 1000
        return (np.floor(x) + (x - np.floor(x) >= 0.5)) / 1000

    def groups(self, b):
        """A number for each row's group; null is a group of its own."""
        return b[self.group].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()

    def allowed(self, cos, b, j):
        """Whether rows j compete, by their cosines less a slack for the first look."""
        always, strict, seen = (b[c].to_numpy(zero_copy_only=False)[j] for c in ("always", "strict", "seen"))
        return np.where(strict, always, (cos >= self.semantic) | (seen & (cos >= self.visual)))

    def near(self, cos, bonus, b):
        every = np.arange(len(bonus))
        ok = self.allowed(cos + 1e-3, b, every)
        s = np.where(ok, self.score(np.maximum(0, cos), bonus, b, every), -np.inf)
        rows, cols = [], []
        for g in np.unique(names := self.groups(b)):
            at = np.flatnonzero(names == g)
            part = s[:, at]
            least = np.partition(part, -self.k, axis=1)[:, -self.k][:, None] - 0.02 if self.k < len(at) else -np.inf
            x, y = np.nonzero((part >= least) & ok[:, at])
            rows.append(x)
            cols.append(at[y])
        return np.concatenate(rows), np.concatenate(cols)

    def best(self, q, r, cos, bonus, b, j):
        keep = np.flatnonzero(self.allowed(cos, b, j))
        group = self.groups(b)[j[keep]]
        order = np.lexsort((r[keep], -self.score(cos, bonus, b, j)[keep], group, q[keep]))
        pair = np.stack([q[keep], group])[:, order]
        first = np.flatnonzero(np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(0)]) if len(keep) else np.array([], int)
        rank = np.arange(len(keep)) - np.repeat(first, np.diff(np.r_[first, len(keep)]))
        return keep[order[rank < self.k]]


def _schema(rows: DataFrame, extra: Sequence[str]) -> str:
    return ", ".join(["query_id long", "id long", "cosine double", "score double", *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra]])


def _rows(rows: DataFrame, bonus: Column | None, extra: Sequence[str]) -> DataFrame:
    return rows.select("id", "v", (F.lit(0.0) if bonus is None else bonus.cast("double")).alias("bonus"), *extra)


def top_per_query(queries: DataFrame, rows: DataFrame, k: int, extra: Sequence[str] = (), weight: float = 1.0, bonus: Column | None = None, name: str = "rank", tie: str = "id", block: int | None = None) -> DataFrame:
    """query_id, id, cosine, score, extra and the rank: the best k rows of each query by score (weight x cosine + bonus), then tie and id."""
    found = _blocks(queries, _rows(rows, bonus, extra), _Top(k, weight, tie), _schema(rows, extra), extra, block or BLOCK)
    return ordered.top_per_group(found, ["query_id"], k, [F.col("score").desc(), F.col(tie), F.col("id")], "id", name)


def within(queries: DataFrame, rows: DataFrame, least: float, also: Column, extra: Sequence[str] = ()) -> DataFrame:
    """query_id, id, cosine, extra: the rows within a cosine of each query, and for every query those that `also` holds for. A row without a vector has cosine 0."""
    return _blocks(queries, _rows(rows, also.cast("int"), extra), _Within(least), _schema(rows, extra), extra, ALL).drop("score")


def nested(queries: DataFrame, rows: DataFrame, group: str, k: int, semantic: float, visual: float, extra: Sequence[str], also: float = 0.0) -> DataFrame:
    """query_id, id, cosine (cut), score, the group, extra and rank: the best k rows of each query and group, see _Nested; a row whose bonus is null comes last and has no score. rows: id, v, bonus, weight, always, strict, seen, group, extra."""
    more, none = [group, *extra], F.lit(float("-inf"))
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("always", "strict", "seen")]
    some = rows.select("id", "v", F.coalesce(F.col("bonus").cast("double"), none).alias("bonus"), F.col("weight").cast("double").alias("weight"), *marks, *[c for c in more if c != "seen"])
    found = _blocks(queries, some, _Nested(k, group, semantic, visual, also), _schema(rows, more), more, BLOCK)
    best = ordered.top_per_group(found, ["query_id", group], k, [F.col("score").desc(), F.col("id")], "id")
    return best.withColumn("score", F.when(F.col("score") > none, F.col("score")))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, k: int, score: str, tie: str, name: str) -> DataFrame:
    """The best k with their rank. Only k rows meet in the window."""
    best = top(df, k, F.col(score).desc(), F.col(tie))
    return best.withColumn(name, F.row_number().over(W.orderBy(F.col(score).desc(), F.col(tie))))


def fused(vector: DataFrame, lexical: DataFrame, key: str, k: int, vector_share: float = 0.86, lexical_share: float = 0.14, constant: int = 60, per: Sequence[str] = ()) -> DataFrame:
    """Full-outer merge of two ranked lists (vec_score, vec_rank; lex_score, lex_rank), of each query with `per`: weighted scores plus reciprocal ranks."""
    both = vector.join(lexical, [*per, key], "full")
    reciprocal = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    score = vector_share * F.coalesce("vec_score", F.lit(0.0)) + lexical_share * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("lex_score", F.lit(0.0)))) + reciprocal("vec_rank") + reciprocal("lex_rank")
    both = both.withColumn("score", F.round(score, 6))
    if per:
        return ordered.top_per_group(both, per, k, [F.col("score").desc(), F.col(key)], key).drop("rank")
    return top(both, k, F.col("score").desc(), F.col(key))


def collapsed(hits: DataFrame, cluster: str, key: str, score: str, per: Sequence[str] = ()) -> DataFrame:
    """The best hit of each cluster (of each query with `per`), raised a little by the cluster's size and its hits: least(.04, log2(size + 1) / 100) + least(.02, (hits - 1) * .004)."""
    g = hits.groupBy(*per, cluster).agg(F.max(F.struct(F.col(score), (-F.col(key)).alias("k"))).alias("best"), F.count("*").alias("support"), F.max("cluster_size").alias("size"))
    boost = F.least(F.lit(0.04), F.log2(F.greatest(F.lit(1), F.col("size")) + 1) * 0.01) + F.least(F.lit(0.02), (F.col("support") - 1) * 0.004)
    return g.select(*per, F.col(cluster), (-F.col("best.k")).alias(key), "support", F.round(F.col(f"best.{score}") + boost, 6).alias("score"))

"""An index for approximate and for exact nearest vectors by cosine: cells around centroids, some of them opened for a query.

Centroids come from spherical k-means over a sample of at most SAMPLE vectors; there are about the root of the number of rows
of them, and never more than MAX_BYTES of them, so they can be sent to every task. Every row is then put in the cell of its
nearest centroid, and each cell's size and its widest angle are kept.

A search sends each query to the cells whose centroids are nearest (`probes`) and ranks the rows of those by their exact
cosine. How many cells a wanted recall asks for depends on the data: `tune` reads it off the exact neighbours of some rows, by
where their cells stand in the order that a query opens cells in. `exact` opens every cell that can still hold a row of the
best k: the angle between a query and a row is at least the angle to the centroid less the cell's widest one.

Rows and queries meet in groups of one cell. A cell of more than BLOCK rows (copies, say) is cut into parts by a hash of the
identifier, and so are its queries, so no group is larger than about BLOCK of each. A row moves once for each BLOCK of queries
that open its cell, a query once for each cell and part.

A missing vector and one of zeros have cosine 0 with everything, and stay in the first cell. Null identifiers are kept; of
equal cosines the smaller tie and identifier come first. Tables without rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ordered
from .staging import stored
from .vector_search import _matrix, _rows, _schema, _Top, meeting, top_per_query

#: Vectors in the sample for centroids, bytes of centroids at most, rounds of k-means, rows of a group, queries that tune() takes.
SAMPLE, MAX_BYTES, ROUNDS, BLOCK, TUNING = 65_536, 32 << 20, 12, 4096, 256
#: Cosines of rows with centroids that a task holds at once.
HELD = 1 << 20
#: More than a cosine by matrix product can differ by from the sum in order, as an angle.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """rows: id, v, further columns and cell; centroids: unit vectors; sizes and widest: rows and largest angle of each cell."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    widest: np.ndarray

    def save(self, path: str) -> None:
        """Rows in order of their cells, so that a search of some cells reads those row groups, and the centroids."""
        self.rows.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")
        table = [(i, [float(x) for x in c], int(n), float(w)) for i, (c, n, w) in enumerate(zip(self.centroids, self.sizes, self.widest))]
        self.rows.sparkSession.createDataFrame(table, "cell int, centroid array<double>, size long, widest double").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    def added(self, rows: DataFrame) -> "Index":
        """The index with further rows (of the same columns), put in the cells there are."""
        return _filled(self.rows.select(rows.columns).unionByName(rows), self.centroids)


def load(spark: SparkSession, path: str) -> Index:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return Index(spark.read.parquet(f"{path}/rows"), np.array([r["centroid"] for r in cells]), np.array([r["size"] for r in cells]), np.array([r["widest"] for r in cells]))


def _units(a: pa.Array, dims: int) -> np.ndarray:
    if not len(a) or a.null_count == len(a):
        return np.zeros((len(a), dims))
    m, n = _matrix(pa.chunked_array([a]))
    return m / n[:, None] if m.shape[1] == dims else np.zeros((len(a), dims))


def _pieces(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the cosines of their rows with all centroids are about HELD."""
    n = max(1, HELD // cells)
    for b in batches:
        for a in range(0, b.num_rows, n):
            yield b.slice(a, n)


def centroids_of(vectors: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit vectors; a cell that runs empty starts again at the vector that is farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = vectors[rng.permutation(len(vectors))[:cells]].copy()
    for _ in range(ROUNDS):
        cos = vectors @ c.T
        own = cos.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, vectors)
        length = np.sqrt((sums**2).sum(1))
        empty = np.flatnonzero(length < 1e-12)
        if len(empty):
            sums[empty] = vectors[np.argsort(cos[np.arange(len(own)), own])[: len(empty)]]
            length = np.sqrt((sums**2).sum(1))
        c = sums / np.maximum(length, 1e-12)[:, None]
    return c


def _filled(rows: DataFrame, centroids: np.ndarray) -> Index:
    spark, dims = rows.sparkSession, centroids.shape[1]
    shared, at = spark.sparkContext.broadcast(centroids), rows.columns.index("v")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, len(centroids)):
            cos = _units(b.column(at), dims) @ shared.value.T
            own = cos.argmax(1)
            angle = np.arccos(np.clip(cos[np.arange(len(own)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    held = stored(rows.mapInArrow(assign, f"{fields}, cell int, angle double"))
    sizes, widest = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in held.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("w")).collect():  # a row a cell
        sizes[r["cell"]], widest[r["cell"]] = r["n"], r["w"]
    return Index(held.drop("angle"), centroids, sizes, widest)


def build(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of rows (id, v and further columns). Where no row has a vector there is one cell."""
    some = rows.filter("v is not null and size(v) > 0")
    n = some.count()
    if not n:
        return _filled(rows, np.zeros((1, 1)))
    draw = F.pmod(F.xxhash64("id", "v", F.lit("cells")), F.lit(1 << 30)) / (1 << 30)
    drawn = some.filter(draw < min(1.0, 1.2 * sample / n + 1e-3)).orderBy(draw, "id").limit(sample).select("v").toArrow()["v"]
    drawn = drawn if len(drawn) else some.select("v").limit(1).toArrow()["v"]
    m, length = _matrix(drawn)
    units = (m / length[:, None])[(m * m).sum(1) > 0]
    dims = m.shape[1]
    most = max(1, min(len(units) // 8, MAX_BYTES // (8 * dims)))
    if not len(units):
        units = np.eye(1, dims)
    return _filled(rows, centroids_of(units, min(cells or math.ceil(n**0.5), most)))


def _opened(index: Index, queries: DataFrame, choose) -> DataFrame:
    """query_id, q and cell for every cell that choose(cosines with the centroids, the batch) picks."""
    shared, dims = queries.sparkSession.sparkContext.broadcast(index.centroids), index.centroids.shape[1]
    at = queries.columns.index("q")

    cells = len(index.centroids)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, cells):
            every, cell = np.nonzero(choose(_units(b.column(at), dims) @ shared.value.T, b))
            for a in range(0, len(every), BLOCK):  # a query's vector comes back once a cell
                i = pa.array(every[a : a + BLOCK])
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(i), b.column(at).take(i), pa.array(cell[a : a + BLOCK].astype(np.int32))], names=["query_id", "q", "cell"])

    kinds = dict(queries.dtypes)
    return queries.mapInArrow(pick, f"query_id {kinds['query_id']}, q {kinds['q']}, cell int")


def _first(cos: np.ndarray, probes: int) -> np.ndarray:
    """The cells with the largest cosines, of each row."""
    if probes >= cos.shape[1]:
        return np.ones_like(cos, bool)
    out = np.zeros_like(cos, bool)
    np.put_along_axis(out, np.argsort(-cos, axis=1, kind="stable")[:, :probes], True, 1)
    return out


def _ranked_in(index: Index, opened: DataFrame, k: int, extra: Sequence[str], tie: str) -> DataFrame:
    """The best k rows of each query in each group of a cell that it opens."""
    spark, sizes = opened.sparkSession, index.sizes
    opened = stored(opened)
    asked = {r["cell"]: r["n"] for r in opened.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    parts = [(c, max(1, -(-int(sizes[c]) // BLOCK)), -(-n // BLOCK)) for c, n in asked.items()]
    parts = F.broadcast(spark.createDataFrame(parts, "cell int, row_parts int, query_parts int"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = opened.join(parts, "cell").select("cell", "query_id", "q", part("query_id", "query_parts").alias("qp")).join(parts, "cell").select("cell", "query_id", "q", "qp", each("row_parts").alias("rp"))
    rows = _rows(index.rows.filter(F.col("cell").isin(sorted(asked))) if len(asked) < min(1000, len(sizes)) else index.rows, None, [*extra, "cell"])
    right = rows.join(parts, "cell").withColumn("rp", F.pmod(F.xxhash64("id", "v"), F.col("row_parts")).cast("int")).withColumn("qp", each("query_parts")).drop("row_parts", "query_parts")
    schema, keys = _schema(index.rows, extra), ["cell", "qp", "rp"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meeting(_Top(k, 1.0, tie), schema, extra), schema)


def _best(found: DataFrame, k: int, tie: str) -> DataFrame:
    return ordered.top_per_group(found, ["query_id"], k, [F.col("score").desc(), F.col(tie), F.col("id")], "id")


def search(index: Index, queries: DataFrame, k: int, probes: int, extra: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """query_id, id, cosine, score, extra, rank: the best k of the rows in the `probes` nearest cells of each query (query_id, q)."""
    return _best(_ranked_in(index, _opened(index, queries, lambda cos, b: _first(cos, probes)), k, extra, tie), k, tie)


def exact(index: Index, queries: DataFrame, k: int, probes: int = 4, extra: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """As search, but the best k of all rows: after the nearest cells, those that can hold a row as good as the k-th so far."""
    near = stored(_ranked_in(index, _opened(index, queries, lambda cos, b: _first(cos, probes)), k, extra, tie))
    floor = _best(near, k, tie).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("floor")).withColumnRenamed("query_id", "f_id")
    widest = index.widest

    def rest(cos: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        floor = b.column("floor").fill_null(-2.0).to_numpy()
        least = np.maximum(0, np.arccos(np.clip(cos, -1, 1)) - widest[None, :] - SLACK)
        return (np.cos(least) >= floor[:, None]) & ~_first(cos, probes)

    more = queries.join(floor, F.col("query_id").eqNullSafe(F.col("f_id")), "left").select("query_id", "q", "floor")
    return _best(near.unionByName(_ranked_in(index, _opened(index, more, rest), k, extra, tie)), k, tie)


def tune(index: Index, k: int, recall: float = 0.95, queries: int = TUNING) -> int:
    """The fewest cells to open for a share `recall` of the exact best k of some rows, at most `queries` of them."""
    drawn = index.rows.filter("v is not null").orderBy(F.xxhash64("id", "v", F.lit("tune"))).limit(queries)
    asked = stored(drawn.select(F.monotonically_increasing_id().alias("query_id"), F.col("v").alias("q")))
    true = top_per_query(asked, index.rows.select("id", "v", "cell"), k, ["cell"]).groupBy("query_id").agg(F.collect_list("cell").alias("cells"))  # k cells a query
    found = asked.join(true, "query_id").select("q", "cells").toArrow()
    if not found.num_rows:
        return 1
    order = np.argsort(-(_units(found["q"].combine_chunks(), index.centroids.shape[1]) @ index.centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    places = np.sort(np.concatenate([place[i, cells] for i, cells in enumerate(found["cells"].to_pylist())]))
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1

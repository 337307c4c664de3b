"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), in time linear in the features. Words
are hashed to BUCKETS; their values are log(1 + count), scaled to length 1. Statistics of the text's structure (shares of
upper case, digits, marks, blanks, line ends; lengths of words and lines; repeated words) and its recorded length are each
cut into LEVELS steps, one feature a step.

Training reads at most SAMPLE_DOCS labelled texts outside the held-out fold, chosen by a hash of the identifier, one of each
identifier; that bound is a parameter, and a text has at most WIDTH features, whatever its length. Scoring covers whole texts
of all rows, a batch at a time.

Null and empty texts are scored by their statistics alone; a null length counts as 0. A text with several labels has the
highest. Without labels, or without texts for them, all scores are 0.5. Null identifiers count as empty for the fold and have
no label. Repeated rows get the same score. Other columns pass through, also one with the score's name (the score gets an
underscore before it then). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import counts_in, fresh, small_batches, utf8
from .shingles import word_hashes

BUCKETS, FACTORS, LEVELS, SAMPLE_DOCS = 1 << 15, 4, 12, 5000
#: Statistics and the value of each that reaches the highest step.
_STATS = (("upper", 0.6), ("digit", 0.2), ("mark", 0.35), ("other", 0.2), ("blank", 0.3), ("line", 0.1), ("word", 16.0), ("sentence", 0.08), ("bar", 0.08), ("distinct", 1.0), ("size", 18.0), ("recorded", 18.0))
WIDTH = BUCKETS + LEVELS * len(_STATS)
_CLASS = np.full(256, 2, np.uint8)  # marks
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 4, 1, 3
_CLASS[[32, 9, 11, 12, 13]] = 5
_CLASS[10] = 6
_CLASS[[46]] = 7
_CLASS[[124]] = 8


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(5)) == 0


def features(texts: pa.Array, recorded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and values of a batch of texts, in order of rows; recorded: the length each row's metadata states."""
    data, at = utf8(texts)
    n = len(at) - 1
    rows, ids, values = [], [], []
    words, distinct = np.zeros(n), np.zeros(n)
    for first, hashes, ends in word_hashes(texts):
        size = np.diff(ends)
        doc = np.repeat(np.arange(len(size)), size) + first
        key, count = np.unique(doc * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
        doc, bucket = key // BUCKETS, key % BUCKETS
        x = np.log1p(count)
        norm = np.sqrt(np.bincount(doc - first, x * x, len(size)))
        rows.append(doc)
        ids.append(bucket)
        values.append(x / norm[doc - first])
        words[first : first + len(size)] = size
        distinct[first : first + len(size)] = np.bincount(doc - first, minlength=len(size))
    c = _CLASS[data]
    kinds = np.stack([counts_in(c == k, at) for k in range(9)])
    size = np.maximum(1, np.diff(at))
    letters = np.maximum(1, kinds[0] + kinds[4])
    stats = {
        "upper": kinds[0] / letters, "digit": kinds[1] / size, "mark": (kinds[2] + kinds[7] + kinds[8]) / size, "other": kinds[3] / size, "blank": kinds[5] / size, "line": kinds[6] / size,
        "word": size / np.maximum(1, words), "sentence": kinds[7] / size, "bar": kinds[8] / size, "distinct": distinct / np.maximum(1, words), "size": np.log2(size), "recorded": np.log2(np.maximum(1, recorded)),
    }
    for j, (name, top) in enumerate(_STATS):
        step = np.minimum(LEVELS - 1, (stats[name] / top * LEVELS).astype(np.int64))
        rows.append(np.arange(n))
        ids.append(BUCKETS + j * LEVELS + np.maximum(0, step))
        values.append(np.full(n, 0.5))
    rows, ids, values = np.concatenate(rows), np.concatenate(ids), np.concatenate(values)
    order = np.argsort(rows, kind="stable")
    return rows[order], ids[order], values[order]


class FactorisationMachine:
    def __init__(self, seed: int = 5):
        self.bias, self.w = 0.0, np.zeros(WIDTH)
        self.v = np.random.default_rng(seed).normal(size=(WIDTH, FACTORS)) * 0.02

    def raw(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of v x (row, factor)."""
        out = self.bias + np.bincount(rows, self.w[ids] * x, n)
        sums = np.empty((n, FACTORS))
        for f in range(FACTORS):
            vx = self.v[ids, f] * x
            sums[:, f] = np.bincount(rows, vx, n)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(rows, vx * vx, n))
        return out, sums

    def score(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, ids, x, n)[0], -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 9) -> "FactorisationMachine":
        """Adagrad on the logarithmic loss; docs: each text's features and values."""
        rng, gw, gv, gb = np.random.default_rng(seed), np.full(WIDTH, 1e-2), np.full((WIDTH, FACTORS), 1e-2), 1e-2
        share = float(np.clip(label.mean(), 0.01, 0.99))
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                ids, x = (np.concatenate([docs[j][k] for j in part]) for k in (0, 1))
                rows = np.repeat(np.arange(len(part)), [len(docs[j][0]) for j in part])
                raw, sums = self.raw(rows, ids, x, len(part))
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[part]) / len(part)
                ex = error[rows] * x
                used, slot = np.unique(ids, return_inverse=True)
                dw = np.bincount(slot, ex, len(used)) + decay * self.w[used]
                dv = np.stack([np.bincount(slot, ex * (sums[rows, f] - self.v[ids, f] * x), len(used)) for f in range(FACTORS)], 1) + decay * self.v[used]
                gb += error.sum() ** 2
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.bias -= rate * error.sum() / np.sqrt(gb)
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
        return self


def _lengths(column: pa.Array) -> np.ndarray:
    return np.array([x or 0 for x in column.to_pylist()], float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> FactorisationMachine | None:
    """A machine for label_col of the labelled rows outside the held-out fold; None if there are none."""
    marked = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col)).cast("double").alias("y"))
    n = marked.count()
    draw = F.pmod(F.xxhash64("label_id", F.lit("quality")), F.lit(1 << 30)) / (1 << 30)
    # At most sample_docs rows of an identifier and a label: small enough to send to every task.
    chosen = marked.filter(draw < 1.2 * sample_docs / max(1, n)).withColumn("draw", draw).orderBy("draw", "label_id").limit(sample_docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(size_col).alias("size"), F.xxhash64(text_col).alias("h")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, x = features(b.column(1), _lengths(b.column(2)))
            cut = np.searchsorted(rows, np.arange(len(b) + 1))
            packed = [[y[a:z].tobytes() for a, z in zip(cut, cut[1:])] for y in (ids.astype(np.int32), x.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), *(pa.array(y, pa.binary()) for y in packed)], names=["draw", "y", "h", "ids", "x"])

    small_batches(docs.sparkSession)
    found = rows.select("draw", "text", "size", "y", "h").mapInArrow(extract, "draw double, y double, h long, ids binary, x binary")
    # One text of an identifier, so the bound holds whatever repeats.
    found = [r["b"] for r in found.groupBy("draw").agg(F.min(F.struct("draw", "h", "y", "ids", "x")).alias("b")).collect()]
    if not found:
        return None
    found.sort(key=lambda r: (r["draw"], r["h"]))
    sets = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["x"], np.float32).astype(float)) for r in found]
    return FactorisationMachine().fit(sets, np.array([r["y"] for r in found]))


def score_quality(docs: DataFrame, machine: FactorisationMachine | None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with quality_score (with underscores before it where docs has such a column)."""
    small_batches(docs.sparkSession)
    name = fresh(docs, "quality_score")[0]
    text, size = docs.columns.index(text_col), docs.columns.index(size_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = machine.score(*features(b.column(text), _lengths(b.column(size))), len(b)) if machine else np.full(len(b), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{fields}, `{name}` double")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All texts by a machine that learns from the labels of the folds that are not held out. Edge cases: see the module."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score_quality(docs.select("doc_id", "text", "n_chars"), machine)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))

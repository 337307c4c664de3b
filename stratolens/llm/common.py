"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters that separate words: space and \t \n \v \f \r.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes in an Arrow batch; a batch holds whole texts, so both are kept low.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode without that setting a temporary folder; on a cluster without it an error."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if (spark.sparkContext.master or "").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(shared_dir, "local", None):
        shared_dir.local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return shared_dir.local


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage, and survives lost executors. clear() takes it away."""
    path = f"{shared_dir(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes what stored() has written in this process, once results that read it are no longer needed; the number of folders."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that hold whole texts. The session keeps the setting, as batches are cut when a frame is run, not when it is made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores before it until no column of df has that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column and where each text begins and ends (one more entry than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def counts_in(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of a mask are set in each text; needs no more memory than a number a text."""
    out, some = np.zeros(len(at) - 1, np.int64), at[1:] > at[:-1]
    if some.any():
        out[some] = np.add.reduceat(mask, at[:-1][some], dtype=np.int64)
    return out

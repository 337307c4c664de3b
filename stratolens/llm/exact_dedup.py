"""Exact duplicates by sorting content.

1. A sample of the rows gives splitters: the first KEY_BYTES bytes of the normalised text, 8 bytes of its SHA-256 and 8 bytes
   of a hash of the identifier. They deal all rows into ranges, so equal texts meet in one partition. A text that is so
   frequent that two or more splitters have it (hot) is spread by its rows' identifiers over the ranges between them; there
   are fewer of these than partitions, and their sizes and keepers are aggregated beforehand, with a partial result a task.
2. Each partition is sorted (Spark's external sort) by the normalised bytes, longest original and smallest identifier first.
3. The sorted rows are streamed: each is compared in full with its neighbour, and the first of a run is the one that stays.
   Nothing of a run but its identifiers and carried columns is held until it ends, and of a hot text's run nothing at all.

Nulls and empty texts count as the empty text and are equal to each other and to texts of blanks alone. A null identifier
sorts last. Of rows that are repeated with identifier and text alike, exactly one is kept. Ties of length go to the smallest
identifier. A very long text is normalised and compared whole; a batch holds at least one row, whatever its length. Other
columns pass through, also under the names that results have: those get an underscore before them. Empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import counts_in, fresh, partitions, small_batches, utf8

#: Bytes of the normalised text in a splitter; sampled rows, bytes and rows a partition.
KEY_BYTES, SAMPLE, PART_BYTES, PART_ROWS = 32, 64, 32 << 20, 250_000
_KEEP_BYTE = np.ones(256, bool)
_KEEP_BYTE[[32, 9, 10, 11, 12, 13]] = False


def normalised(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    """The texts without blanks (space, \\t, \\n, \\v, \\f, \\r), as UTF-8; null is empty."""
    data, at = utf8(column)
    keep = _KEEP_BYTE[data]
    ends = np.concatenate([[0], np.cumsum(counts_in(keep, at))])
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[keep])])


def _keys(norm: pa.LargeBinaryArray, width: int) -> tuple[np.ndarray, list[bytes]]:
    """The splitters' first width + 8 bytes (a function of the text, in the texts' order), and SHA-256, of each text."""
    shas = [hashlib.sha256(x.as_buffer()).digest() for x in norm]
    prefix = pc.binary_slice(norm, 0, width).to_pylist()
    return np.array([p.ljust(width, b"\0") + s[:8] for p, s in zip(prefix, shas)], f"S{width + 8}"), shas


def _whole(text_keys: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Splitters' keys: the text's, then the row's."""
    n, width = len(text_keys), text_keys.dtype.itemsize
    both = [text_keys.view(np.uint8).reshape(n, width), spread.astype(">u8").view(np.uint8).reshape(n, 8)]
    return np.concatenate(both, 1).view(f"S{width + 8}").reshape(n)


class _Ranges:
    """Sampled splitters, sorted, and the texts that several of them have."""

    def __init__(self, keys: Sequence[bytes], parts: int, width: int):
        keys = np.sort(np.array(keys, f"S{width + 16}"))
        self.at = keys[(np.arange(1, parts) * len(keys)) // parts] if len(keys) else keys
        texts, n = np.unique(self.at.astype(f"S{width + 8}"), return_counts=True)
        self.hot = texts[n > 1]

    def place(self, text_keys: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partition of each row, and whether its text is hot."""
        hot = np.isin(text_keys, self.hot)
        return np.searchsorted(self.at, _whole(text_keys, np.where(hot, spread, 0).astype(np.uint64)), "right"), hot


def _sampled(rows: DataFrame, names: Sequence[str], parts: int, n: int, width: int) -> _Ranges:
    """names: text and spread columns. At most about SAMPLE keys a partition reach the driver."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, _ = _keys(normalised(b.column(0)), width)
            yield pa.RecordBatch.from_arrays([pa.array(_whole(text, b.column(1).to_numpy().astype(np.uint64)).tolist(), pa.binary())], names=["k"])

    share = min(1.0, SAMPLE * parts / max(1, n))
    some = rows.select(*names) if share == 1 else rows.select(*names).sample(share, 1)
    return _Ranges([r["k"] for r in some.mapInArrow(keys, "k binary").collect()], parts, width)


def _solve(id_at: int, id_type: pa.DataType, out: Sequence[str], known: dict[bytes, tuple], sized: bool):
    """Sorted rows (columns, then sha, length, norm) -> columns, keep_id, group_size, kept, text_sha256."""

    def piece(t: pa.RecordBatch, keep: list, size: list, kept: np.ndarray) -> pa.RecordBatch:
        sha = pa.array([x.as_py().hex() for x in t.column(t.num_columns - 2)], pa.string())
        size = pa.array(size if sized else [None] * len(t), pa.int64())
        return pa.RecordBatch.from_arrays([*t.columns[:-2], pa.array(keep, id_type), size, pa.array(kept), sha], names=list(out))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = now = None  # the row before: its text; its run: [keeper, known or counted size, whether known]
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []

        def release(n: int) -> Iterator[pa.RecordBatch]:
            for b, first in held:
                yield piece(b, [now[0]] * len(b), [n] * len(b), first)
            held.clear()

        for b in batches:
            if not len(b):
                continue
            norm, b = b.column(b.num_columns - 1), pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1])
            same = np.zeros(len(b), bool)
            same[1:] = pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
            same[0] = last is not None and norm[0].as_buffer().equals(last.as_buffer())
            last = norm[len(b) - 1]
            starts = np.flatnonzero(~same)
            cut = np.concatenate([[0], starts, [len(b)]]) if same[0] else np.append(starts, len(b))
            ids, shas, sizes = b.column(id_at), b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            keep, size, kept = [], [], np.zeros(len(b), bool)
            done = 0  # rows before it are passed on
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if not same[a]:
                    if now is not None and not now[2]:
                        yield from release(now[1])
                    sha = shas[a].as_py()
                    if sha in known:
                        now = [*known[sha][:2], True]
                        kept[a] = known[sha][0] == ids[a].as_py() and known[sha][2] == sizes[a].as_py()
                    else:
                        now, kept[a] = [ids[a].as_py(), 0, False], True
                if not now[2]:
                    now[1] += z - a
                    if z == len(b):  # may go on
                        if a > done:
                            yield piece(b.slice(done, a - done), keep, size, kept[done:a])
                        if sized:
                            held.append((b.slice(a, z - a), kept[a:z]))
                        else:
                            yield piece(b.slice(a, z - a), [now[0]] * (z - a), [], kept[a:z])
                        keep, size, done = [], [], z
                        break
                    if held:  # the run began in a batch before
                        yield from release(now[1])
                keep += [now[0]] * (z - a)
                size += [now[1]] * (z - a)
            if done < len(b):
                yield piece(b.slice(done), keep, size, kept[done:])
        if now is not None and not now[2]:
            yield from release(now[1])

    return stream


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), sized: bool = True, parts: int | None = None, key_bytes: int = KEY_BYTES) -> DataFrame:
    """id_col and the columns of carry, with keep_id, group_size, kept and text_sha256 of each row's group of equal texts. carry may name text_col and any other column; where it holds one of the four names, the new column gets an underscore before it. Without `sized`, group_size is null and no row is held. parts: ranges, by size if not given; key_bytes: bytes of the text in a splitter."""
    spark = docs.sparkSession
    small_batches(spark)
    carry = list(dict.fromkeys(c for c in carry if c != id_col))
    results = fresh(docs.select(id_col, *carry), "keep_id", "group_size", "kept", "text_sha256")
    spread, text, length, norm, sha, part, hot = fresh(docs.select(id_col, *carry), "k_spread", "k_text", "k_length", "k_norm", "k_sha", "k_part", "k_hot")
    rows = docs.select(id_col, *carry, F.xxhash64(id_col).alias(spread), F.col(text_col).alias(text), F.coalesce(F.length(text_col), F.lit(0)).alias(length))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    parts = parts or max(partitions(spark), -(-size // PART_BYTES), -(-n // PART_ROWS))
    ranges = _sampled(rows, [text, spread], parts, n, key_bytes)
    width = 1 + len(carry)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = normalised(b.column(width + 1))
            keys, shas = _keys(found, key_bytes)
            place, is_hot = ranges.place(keys, b.column(width).to_numpy().astype(np.uint64))
            more = [found.cast(pa.binary()), pa.array(shas, pa.binary()), b.column(width + 2), pa.array(place.astype(np.int32)), pa.array(is_hot)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *more], names=[id_col, *carry, norm, sha, length, part, hot])

    fields = lambda df, names: ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    dealt = rows.mapInArrow(deal, f"{fields(rows, [id_col, *carry])}, `{norm}` binary, `{sha}` binary, `{length}` int, `{part}` int, `{hot}` boolean")
    known: dict[bytes, tuple] = {}
    if len(ranges.hot):  # fewer than partitions
        best = F.min(F.struct(-F.col(length), F.col(id_col).isNull(), id_col)).alias("best")
        found = dealt.filter(F.col(hot)).groupBy(sha).agg(F.count("*").alias("n"), best).collect()
        known = {bytes(r[0]): (r["best"][2], r["n"], -r["best"][0]) for r in found}
    order = [F.col(norm), F.col(length).desc(), F.col(id_col).asc_nulls_last()]
    held = dealt.repartitionById(parts, F.col(part)).sortWithinPartitions(*order).select(id_col, *carry, sha, length, norm)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{fields(rows, [id_col, *carry])}, `{results[0]}` {kind}, `{results[1]}` long, `{results[2]}` boolean, `{results[3]}` string"
    return held.mapInArrow(_solve(0, id_type, [id_col, *carry, *results], known, sized), schema)



def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with the row that stays of their group of equal texts. Edge cases: see the module."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id NULLS LAST)
"""

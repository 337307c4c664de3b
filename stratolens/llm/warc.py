"""WARC archives as a table of chunks.

A record is a run of rows (record, chunk_no, data): chunk 0 has the WARC and HTTP headers, the others at most CHUNK bytes of
the payload each, with the running SHA-1 of the payload so far. A record's data are one gzip member, as in .warc.gz files,
flushed at the end of each chunk. The reader takes a record's chunks in order and carries
that digest, so neither side ever holds a record's bytes together beyond the row that brought the payload. A payload that
occurs again (by SHA-256) is written as a revisit: headers only, naming the response with the smallest identifier. A payload
that fills a fair part of all rows is looked up in a table that every task has, so its rows stay where they are; there are at
most HOT such payloads a partition. write_files streams the chunks of whole records to .warc.gz files.

Every record has an identifier of its own. A response's comes from its digest and source, so that revisits in other tasks can
name it. Null payloads are empty. A null source comes after all others, and stays null; other
sources come back as they were, whatever characters they have. Repeated rows are records each: those
with the smallest source are responses; if that source is there several times, revisits name it by address alone. Very long
payloads take one row of memory and a chunk at a time. Other columns are left out, so names can't clash. An empty table gives
an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import partitions, small_batches, stored

CHUNK = 64 << 10
#: A payload with more rows than a partition's share / HOT is hot.
HOT = 4
_HEAD = "WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uuid}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\nX-Payload-Length: {size}\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "/".join(map(str, parts))))


def _line(value) -> str:
    """An address as a header's value; line ends would break the header."""
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def _named(header: str, value) -> str:
    """A header line whose value the reader gets back as it was; null has none."""
    return "" if value is None else f"{header}: {quote(str(value))}\r\n"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    names = ["record", "chunk_no", "data", "running_sha1", "last"]
    for b in batches:
        rows: list[tuple] = []
        held = 0
        for source, url, payload, sha1, kind, first, times in zip(*(c for c in b.columns)):
            source, url, sha1, kind, first, times = (x.as_py() for x in (source, url, sha1, kind, first, times))
            view = memoryview(payload.as_buffer()) if payload.is_valid and len(payload.as_buffer()) else memoryview(b"")
            size = len(view)
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            own = _uuid(sha1, source) if kind == "response" and times == 1 else _uuid("record", part, n)
            head = _HEAD.format(kind=kind, uuid=own, url=_line(url), digest=digest, size=size) + _named("X-Source-Id", source)
            if kind == "revisit":
                refers = f"WARC-Refers-To: <urn:uuid:{_uuid(sha1, first)}>\r\n" if times == 1 else ""
                head += f"WARC-Profile: {_PROFILE}\r\n{refers}{_named('X-Refers-To-Source', first)}Content-Length: 0\r\n\r\n"
                view = memoryview(b"")
            else:
                http = _HTTP.format(size=size)
                head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + size}\r\n\r\n{http}"
            record, h = (part << 32) + n, hashlib.sha1()
            n += 1
            member = zlib.compressobj(1, zlib.DEFLATED, 31)
            zipped = lambda data, last, m=member: m.compress(data) + (m.compress(b"\r\n\r\n") + m.flush() if last else m.flush(zlib.Z_SYNC_FLUSH))
            rows.append((record, 0, zipped(head.encode(), not len(view)), h.hexdigest(), not len(view)))
            for k in range(0, len(view), CHUNK):
                piece, last = view[k : k + CHUNK], k + CHUNK >= len(view)
                h.update(piece)
                rows.append((record, k // CHUNK + 1, zipped(piece, last), h.hexdigest(), last))
                held += len(piece)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """The chunk table (record, chunk_no, data, running_sha1, last) of an archive with a record for each row; payloads under `least` bytes are never revisits."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("source"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns({"sha1": F.sha1("payload"), "sha2": F.sha2("payload", 256)})
    times = rows.groupBy("sha2", "source").agg(F.count("*").alias("times"))
    first = times.groupBy("sha2").agg(F.min(F.struct(F.col("source").isNull().alias("none"), "source", "times")).alias("best"), F.sum("times").alias("n"))
    first = stored(first.select(F.col("sha2").alias("first_sha2"), F.col("best.source").alias("first"), "best.times", "n"), "warc-first")
    most = (first.agg(F.sum("n")).first()[0] or 0) / (HOT * partitions(pages.sparkSession))
    # At most HOT rows a partition: small enough to send to every task.
    hot = F.broadcast(first.filter((F.col("n") > most) & (F.col("n") > 1)).select(F.col("first_sha2").alias("hot_sha2"), F.col("first").alias("hot_first"), F.col("times").alias("hot_times")))
    rows = rows.join(hot, F.col("sha2") == F.col("hot_sha2"), "left").withColumn("key", F.when(F.col("hot_sha2").isNull(), F.col("sha2")).otherwise(F.md5(F.concat(F.lit("hot "), F.coalesce(F.col("source").cast("string"), F.lit(""))))))
    # Never broadcast: payloads that occur more than once grow with the table.
    rows = rows.join(first.filter((F.col("n") <= most) & (F.col("n") > 1)).hint("merge"), F.col("key") == F.col("first_sha2"), "left")
    found, first, times = F.coalesce("first_sha2", "hot_sha2"), F.when(F.col("hot_sha2").isNull(), F.col("first")).otherwise(F.col("hot_first")), F.coalesce("times", "hot_times")
    again = found.isNotNull() & ~F.col("source").eqNullSafe(first) & (F.octet_length("payload") >= least)
    small = found.isNotNull() & (F.octet_length("payload") < least)  # several responses of one payload
    rows = rows.select("source", "url", "payload", "sha1", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, first).alias("first"), F.when(small, 2).otherwise(F.coalesce(times, F.lit(1))).alias("times"))
    return stored(rows.mapInArrow(_write, "record long, chunk_no long, data binary, running_sha1 string, last boolean"), "warc")


def write_files(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes the records of a chunk table to .warc.gz files in a folder that all executors share, a file a partition, streaming; (file, records, bytes). A file gets its name when it is whole, so a task that runs again replaces it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        files, top = fs.FileSystem.from_uri(folder)
        name = f"part-{context.partitionId():05d}.warc.gz"
        part, records, size = f"{top}/.{name}.{context.taskAttemptId()}", 0, 0
        files.create_dir(top)
        with files.open_output_stream(part) as out:
            for b in batches:
                for no, data in zip(b.column(0).to_pylist(), b.column(1)):
                    records += no == 0
                    size += out.write(data.as_buffer())
        files.move(part, f"{top}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], names=["file", "records", "bytes"])

    small_batches(chunks.sparkSession)
    rows = chunks.select("record", "chunk_no", "data").repartition("record").sortWithinPartitions("record", "chunk_no")
    done = rows.select("chunk_no", "data").mapInArrow(write, "file string, records long, bytes long")
    return chunks.sparkSession.createDataFrame(done.collect(), done.schema)  # a row a file; written once


class _Record:
    """What is known of a record whose chunks come in."""

    def __init__(self):
        self.member = zlib.decompressobj(31)
        self.head, self.fields, self.left, self.sha1, self.got, self.ok, self.tail = b"", None, 0, hashlib.sha1(), 0, True, b""

    def add(self, data: bytes, running: str) -> None:
        data = self.member.decompress(data)
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode().split("\r\n")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            data, self.left = self.head[end + 4 :], int(self.fields["Content-Length"])
            if self.left:
                end = data.find(b"\r\n\r\n")
                self.left -= end + 4
                data = data[end + 4 :]
        piece, self.tail = data[: self.left], self.tail + data[self.left :]
        self.left -= len(piece)
        self.got += len(piece)
        self.sha1.update(piece)
        self.ok &= self.sha1.hexdigest() == running

    def row(self) -> tuple:
        f = self.fields
        digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
        if f["WARC-Type"] == "response":
            self.ok &= self.got == size and base64.b32encode(self.sha1.digest()).decode() == digest
            digest, size = base64.b32encode(self.sha1.digest()).decode(), self.got
        back = lambda k: unquote(f[k]) if k in f else None
        return back("X-Source-Id"), f["WARC-Target-URI"], size, digest, f["WARC-Type"], back("X-Refers-To-Source"), self.ok and self.left == 0 and self.tail == b"\r\n\r\n"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["source", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    now = record = None
    for b in batches:
        rows = []
        for key, data, running in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            if key != now:
                if record:
                    rows.append(record.row())
                now, record = key, _Record()
            record.add(data.as_py(), running)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), types)], names=names)
    if record:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(record.row(), types)], names=names)


def read_warc(chunks: DataFrame) -> DataFrame:
    """source, url, payload_bytes, payload_digest, record_type, refers_to, intact of each record of a chunk table; identifiers are strings."""
    small_batches(chunks.sparkSession)
    rows = chunks.select("record", "data", "running_sha1", "chunk_no").repartition("record").sortWithinPartitions("record", "chunk_no")
    return rows.select("record", "data", "running_sha1").mapInArrow(_read, "source string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean")


def op5_warc_chunks(spark, sf_dir: str) -> DataFrame:
    """All pages written as chunked records and read back. Edge cases: see the module."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType
    found = read_warc(write_warc(pages))
    return found.select(F.col("source").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS INT), 5) AS INT)) AS v FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 15) % 32, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 10) % 32, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 5) % 32, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + x % 32, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""

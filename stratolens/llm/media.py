"""AVI motion-JPEG: bytes to lossless frames and back, RIFF index parsing, and shots by adaptive histogram differences.

A payload is cut into frames of 24 x 24 grey samples, each a lossless JPEG (ITU T.81 process 14: SOF3, left-neighbour
prediction), one `00dc` chunk of an AVI file with an `idx1` index. The Huffman table gives category s a code of 9 - s bits,
so every difference takes 9 bits with its extra bits; that makes coding and decoding arithmetic on whole arrays. Any
decoder of lossless JPEG reads the frames.

The reader finds the frames by the RIFF index, undoes byte stuffing, decodes, and sums the differences up again. Frames with
the header above are decoded many at once. Others are read by their own tables, sample by sample in jpeg.py: lossless grey of
any size, table and predictor, and baseline frames, of which the luma counts. A file without index, or with frames of another
sort or of several sizes, raises ValueError.

A cut is where the histogram (16 bins) changes by more than mean + DEVIATIONS standard deviations of the last RECENT changes, those
capped at LEAST; a change under LEAST is no cut. Clips run from cut to cut, timed at RATE frames a second.

Null texts are empty; empty texts give one frame of 255s. Equal texts give equal files. Very long texts are coded BLOCK
frames at a time. Other columns pass by; repeated rows get the same answer.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, utf8
from .jpeg import luma

SIDE, RATE = 24, 25
FRAME = SIDE * SIDE
BLOCK = 8192
DEVIATIONS, RECENT, LEAST = 3.0, 8, 0.25
_SCAN = FRAME * 9 // 8
_HEAD = (
    b"\xff\xd8"
    + b"\xff\xc3"
    + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1)
    + b"\x01\x11\x00"
    + b"\xff\xc4"
    + struct.pack(">H", 28)
    + b"\x00"
    + bytes([1] * 9 + [0] * 7)
    + bytes(range(8, -1, -1))
    + b"\xff\xda"
    + struct.pack(">HB", 8, 1)
    + b"\x01\x00"
    + b"\x01\x00\x00"
)
_END = b"\xff\xd9"
#: 9-bit code of each difference from -255 to 255, and back.
_CODE = np.zeros(511, np.uint16)
_DIFF = np.zeros(512, np.int16)
for _d in range(-255, 256):
    _s = abs(_d).bit_length()
    _prefix = (1 << (9 - _s)) - 2 if _s else 0b111111110
    _CODE[_d + 255] = (_prefix << _s) | (_d if _d >= 0 else _d + (1 << _s) - 1)
    _DIFF[_CODE[_d + 255]] = _d


def _scans(samples: np.ndarray) -> list[bytes]:
    """Frames (n, FRAME) of bytes -> entropy-coded scans."""
    x = samples.reshape(-1, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = _CODE[d.reshape(-1, 8) + 255]
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = ((c[:, k - 1] & ((1 << k) - 1)) << (8 - k)) | (c[:, k] >> (k + 1))
    out[:, 8] = c[:, 7] & 255
    flat = out.reshape(-1)
    full = flat == 255
    at = np.arange(len(flat)) + np.cumsum(full) - full
    stuffed = np.zeros(len(flat) + int(full.sum()), np.uint8)
    stuffed[at] = flat
    ends = np.append(at[::_SCAN], len(stuffed))
    whole = stuffed.tobytes()
    return [whole[a:z] for a, z in zip(ends.tolist(), ends[1:].tolist())]


def _samples(scans: list[bytes]) -> np.ndarray:
    """Entropy-coded scans -> frames (n, FRAME) of bytes."""
    flat = np.frombuffer(b"".join(scans), np.uint8)
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 255)
    b = flat[keep]
    if len(b) != len(scans) * _SCAN:
        raise ValueError("a scan has another length than its frame")
    b = b.reshape(-1, 9).astype(np.uint16)
    c = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        c[:, k] = ((b[:, k] << (k + 1)) | (b[:, k + 1] >> (7 - k))) & 511
    d = _DIFF[c].reshape(-1, SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], 1)
    return np.cumsum(d, 2, dtype=np.int16).astype(np.uint8).reshape(-1, FRAME)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _list(name: bytes, data: bytes) -> bytes:
    return _chunk(b"LIST", name + data)


def avi(frames: list[bytes]) -> bytes:
    """An AVI file of one video stream with an index."""
    n, largest = len(frames), max(map(len, frames))
    avih = struct.pack("<10I16x", 1_000_000 // RATE, largest * RATE, 0, 0x10, n, 0, 1, largest, SIDE, SIDE)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, RATE, 0, n, largest, -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    sizes = np.array([len(f) for f in frames], np.uint32)
    steps = 8 + sizes + sizes % 2
    index = np.zeros(n, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, 4 + np.cumsum(steps) - steps, sizes
    movi = _list(b"movi", b"".join(_chunk(b"00dc", f) for f in frames))
    body = b"AVI " + _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf))) + movi + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", body)


def frames_of(data: bytes) -> list[bytes]:
    """The frames of an AVI file, by its RIFF index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    video = index[np.isin(index[:, 0], [int.from_bytes(x, "little") for x in (b"00dc", b"00db")])]
    at = video[:, 2].astype(np.int64)
    if len(at) and data[movi + at[0] : movi + at[0] + 4] not in (b"00dc", b"00db"):  # some files count from their begin
        movi = 0
    return [data[a : a + n] for a, n in zip((movi + 8 + at).tolist(), video[:, 3].tolist())]


def decode(frames: list[bytes]) -> np.ndarray:
    """Samples of JPEG frames of one size, a row a frame."""
    if all(f.startswith(_HEAD) and f.endswith(_END) for f in frames):
        return np.concatenate([_samples([f[len(_HEAD) : -2] for f in frames[i : i + BLOCK]]) for i in range(0, len(frames), BLOCK)])
    found = [luma(f) for f in frames]
    if len({x.shape for x in found}) != 1:
        raise ValueError("frames of several sizes")
    return np.stack([x.reshape(-1) for x in found])


def cuts(samples: np.ndarray) -> list[int]:
    """Frames at which a shot begins, but for the first."""
    n = len(samples)
    if n < 2:
        return []
    hist = np.bincount((np.arange(n)[:, None] * 16 + (samples >> 4)).reshape(-1), minlength=16 * n).reshape(n, 16)
    change = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * samples.shape[1])
    calm = np.minimum(change, LEAST)  # a cut shall not hide the next one
    total, square = np.concatenate([[0], np.cumsum(calm)]), np.concatenate([[0], np.cumsum(calm**2)])
    i = np.arange(n - 1)
    a = np.maximum(0, i - RECENT)
    seen = np.maximum(1, i - a)
    mean = (total[i] - total[a]) / seen
    spread = np.sqrt(np.maximum(0, (square[i] - square[a]) / seen - mean**2))
    return (np.flatnonzero(change > np.maximum(LEAST, mean + DEVIATIONS * spread)) + 1).tolist()


def text_videos(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as the samples of an AVI file, filled up with 255s to whole frames."""
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            size = np.diff(at)
            n = np.maximum(1, -(-size // FRAME))
            first = np.concatenate([[0], np.cumsum(n)])
            samples = np.full(int(first[-1]) * FRAME, 255, np.uint8)
            for i in range(len(size)):
                samples[first[i] * FRAME : first[i] * FRAME + size[i]] = data[at[i] : at[i + 1]]
            samples = samples.reshape(-1, FRAME)
            scans = [s for i in range(0, len(samples), BLOCK) for s in _scans(samples[i : i + BLOCK])]
            media = [avi([_HEAD + s + _END for s in scans[a:z]]) for a, z in zip(first.tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(write, f"doc_id {kind}, n_bytes long, media binary")


def _decoded(media: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Bytes and samples of each file of a batch; the frames of all files are decoded together."""
    files = media.to_pylist()
    frames = [frames_of(f) for f in files]
    samples = decode([f for fs in frames for f in fs])
    at = 0
    for f, fs in zip(files, frames):
        yield f, samples[at : at + len(fs)]
        at += len(fs)


def video_features(videos: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, clips (seconds from-to of each shot, as shot_clips has them in rows) of each file: what its stored bytes decode to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, samples in _decoded(b.column(2)) if len(b) else ():
                payload, found = samples.tobytes(), cuts(samples)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(f), hashlib.sha256(f).hexdigest(), f"frames={len(samples)};shots={len(found) + 1};cuts={','.join(map(str, found))}", ",".join(f"{a / RATE:.2f}-{z / RATE:.2f}" for a, z in zip([0, *found], [*found, len(samples)]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in zip(*rows))] if rows else [c.slice(0, 0) for c in b.columns[:2]] + [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])

    kind = videos.schema["doc_id"].dataType.simpleString()
    return videos.select("doc_id", "n_bytes", "media").mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips string")


def shot_clips(videos: DataFrame) -> DataFrame:
    """doc_id, clip_no, first_frame, end_frame, start_s, end_s: a row for each shot of each file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, no, first, end = [], [], [], []
            for i, (_, samples) in enumerate(_decoded(b.column(1)) if len(b) else ()):
                found = [0, *cuts(samples), len(samples)]
                doc += [i] * (len(found) - 1)
                no += range(len(found) - 1)
                first += found[:-1]
                end += found[1:]
            ints = [pa.array(x, pa.int64()) for x in (no, first, end)]
            seconds = [pa.array([x / RATE for x in y], pa.float64()) for y in (first, end)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *ints, *seconds], names=["doc_id", "clip_no", "first_frame", "end_frame", "start_s", "end_s"])

    kind = videos.schema["doc_id"].dataType.simpleString()
    return videos.select("doc_id", "media").mapInArrow(read, f"doc_id {kind}, clip_no long, first_frame long, end_frame long, start_s double, end_s double")


def op1_mjpeg_avi(spark, sf_dir: str) -> DataFrame:
    """All texts through AVI files and back: what the stored bytes decode to, with the clips. Edge cases: see the module."""
    return video_features(text_videos(spark.read.parquet(f"{sf_dir}/documents.parquet")))



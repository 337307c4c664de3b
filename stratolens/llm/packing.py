"""Best-fit packing into bins of several permitted lengths.

Texts are cut into pieces of at most the largest length. Pieces are dealt by hash to shards of about SHARD_PIECES, and each
shard is packed in one task: longest first, every piece goes to the open bin it fills best; if it fits none, the pieces that
are left are counted by length, a bin of each permitted length is filled with them for a trial, and the length with the least
cost a word (of the bin shrunk to that content) opens. In the end each bin shrinks to the shortest permitted length that holds
its contents. As such choices don't look ahead beyond a bin, a shard is packed with one opening length at a time too, and its
cheapest packing stays: the lengths together are never dearer than one of them alone.

A bin's cost is fixed + length + length^2 / square: a start-up part, a linear part, and attention's square.

Null and empty texts have no words: one row with n_words 0 and no bin. Repeated rows are packed each and spread over the
shards by a row number, which holds for one layout of the input; null identifiers are values like others. A very long text is
many pieces. Ties go by identifier and piece number. Other columns are left out, so names can't clash. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import n_words, stored

SIZES, SHARD_PIECES = (256, 512, 1024, 2048, 4096), 16_384


def cost_of(size: int, fixed: float = 64, square: float = 16_384) -> float:
    return fixed + size + size * size / square


def _filled(first: int, size: int, left: list[int], mask: int) -> int:
    """Words in a bin of `size` that begins with `first` and is filled with the longest pieces left that fit, as counts by length and a bit for each length that is left."""
    room, own = size - first, {first: 1}
    while some := mask & ((1 << (room + 1)) - 1):
        n = some.bit_length() - 1
        k = min(left[n] - own.get(n, 0), room // n)
        room -= k * n
        mask &= (1 << n) - 1
    return size - room


def _pack(lengths: Sequence[int], sizes: Sequence[int], cost: dict[int, float], least: int | None) -> tuple[list[int], list[int], list[int]]:
    """Best fit of `lengths`; bins open in the shortest length from `least` on that holds the piece or, without it, in that of least cost a word."""
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by free words
    free, used = 0, []  # free: bit r is set if room[r] has a bin
    left, mask = [0] * (sizes[-1] + 1), 0  # what isn't packed yet, by length
    for n in lengths:
        left[n] += 1
        mask |= 1 << n
    bins, places = [], []
    for n in lengths:
        if fit := free >> n:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            b = len(used)
            used.append(0)
            if least is None:
                filled = {s: _filled(n, s, left, mask) for s in sizes if s >= n}
                r = min(filled, key=lambda s: (cost[next(x for x in sizes if x >= filled[s])] / filled[s], -s))
            else:
                r = next(s for s in sizes if s >= max(n, least))
        bins.append(b)
        places.append(used[b])
        used[b] += n
        left[n] -= 1
        if not left[n]:
            mask ^= 1 << n
        if r > n:
            room[r - n].append(b)
            free |= 1 << (r - n)
    return bins, places, [next(s for s in sizes if s >= u) for u in used]


def best_fit(lengths: Sequence[int], sizes: Sequence[int], fixed: float = 64, square: float = 16_384) -> tuple[list[int], list[int], list[int]]:
    """lengths, descending, each at most the largest size -> bin of each, place in the bin, and the bins' final sizes: the cheapest of the joint packing and those that open every bin in one length where it can."""
    sizes = sorted(sizes)
    cost = {s: cost_of(s, fixed, square) for s in sizes}
    return min((_pack(lengths, sizes, cost, least) for least in (None, *sizes)), key=lambda p: sum(cost[s] for s in p[2]))


def pack_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sequence[int] = SIZES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece_no, start (first word), n_words, bin_id, bin_offset, bin_size, bin_used; a row for each piece."""
    longest = max(sizes)
    rows = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("digest"))
    pieces = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / longest) - 1))))
    pieces = pieces.withColumn("start", F.col("piece_no") * longest).withColumn("n_words", F.least(F.lit(longest), F.col("size") - F.col("start")))
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece_no long, start long, n_words long, bin_id long, bin_offset long, bin_size int, bin_used long"

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece_no", "ascending"), ("digest", "ascending")])
        n = t.column("n_words").to_numpy()
        some = int(np.count_nonzero(n))
        bins, places, final = best_fit(n[:some].tolist(), sizes)
        used = np.bincount(bins, n[:some], len(final)).astype(np.int64) if some else np.zeros(0, np.int64)
        base, none = t.column("shard")[0].as_py() << 32, [None] * (len(n) - some)
        out = t.select(["doc_id", "piece_no", "start", "n_words"])
        for name, x, k in (("bin_id", [base + b for b in bins], pa.int64()), ("bin_offset", places, pa.int64()), ("bin_size", [final[b] for b in bins], pa.int32()), ("bin_used", [int(used[b]) for b in bins], pa.int64())):
            out = out.append_column(name, pa.array(x + none, k))
        return out

    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "digest", "piece_no", "row"), F.lit(shards)))
    return pieces.select("doc_id", "piece_no", "start", "n_words", "digest", "shard").groupBy("shard").applyInArrow(pack, schema)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All texts in bins of the permitted lengths, a row a piece. Edge cases: see the module."""
    return pack_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Phrase collocations by Toivonen's mining: a sample proposes, whole passes count, failures of the border widen what is counted.

1. Sample. All phrases of 1 to LONGEST words in about FRACTION of the rows (at most SAMPLE_BYTES of text on average) are
   counted; those that reach the lowered threshold are proposed. Proposals are kept as a bitmap of 2^BITS bits (16 MB at most; two
   bits a byte of a small input), which is all that is broadcast, once; two are kept at a time, as each is a file on the driver
   and on every executor. A phrase that only seems proposed is counted besides: no result depends on it.
2. Whole pass. Every row's phrases are counted exactly if their first and their last n-1 words are proposed: the proposed
   phrases and their negative border. The border of single words is all words.
3. Border failures. A border phrase that is frequent wasn't proposed, so longer ones that hold it may not have been counted.
   It is added to the proposals, and another whole pass counts what the wider proposals bring in; until nothing fails. Each
   such pass closes a length at least, so there are at most LONGEST - 1 of them; however poor the sample, the counts are exact.

Phrases meet by their text and language, never by a hash alone: equal ones of a batch are found by 128 bits of hash and summed
before the shuffle, so a passage in every text is one row a batch. Scores, the drop of phrases inside longer ones and the
ranks are joins over frequent phrases; their products are decimals.

Null texts are empty, a null language is `und` (and one with a text named so). Texts without words bring nothing. Repeated
rows count as often as they are there. A very long text is read a piece at a time, phrases over the cuts included. Ties of
score go to the larger count, then the phrase in the order of its bytes. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import top_per_group
from .common import small_batches, stored, utf8
from .shingles import _BYTE, _C, _power, mix

MIN_COUNT, LONGEST, TOP, PERCENT = 30, 4, 2000, 80
#: Bytes of text in the sample, on average; its largest share of the rows; bits of the proposals' bitmap as a power of two.
SAMPLE_BYTES, FRACTION, BITS = 256 << 20, 1 / 16, 27
#: Texts are read this many bytes at a time.
PIECE = 1 << 19
_BUCKET = 32_768  # bits of a bucket of Spark's bitmap functions
_BYTE_2 = np.random.default_rng(7_130_013).integers(1, 1 << 63, 256).astype(np.uint64)
_BYTE_2[65:91] = _BYTE_2[97:123]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9] = 32
_CLASS = np.zeros(256, np.uint8)  # of a word
_CLASS[[32, 9]] = 1
_CLASS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
SCHEMA = "lang string, n int, phrase string, c long"


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _views(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Index of the first text, bytes, texts' offsets in them and where the first words of phrases must begin before: runs of texts, and pieces of long ones with as many bytes more as phrases over the cut need."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        if j > i + 1 or at[j] - at[i] <= PIECE:
            yield i, data[at[i] : at[j]], at[i : j + 1] - at[i], int(at[j] - at[i])
        else:
            s, z = int(at[i]), int(at[j])
            while s < z:
                e = _after(data, min(z, s + PIECE), z, 0)
                t = _after(data, e, z, LONGEST - 1)
                yield i, data[s:t], np.array([0, t - s]), e - s
                s = e
        i = j


def _after(data: np.ndarray, e: int, z: int, words: int) -> int:
    """The end of the word at e (words = 0), or of so many words after e, or the first mark that cuts, or z."""
    if words == 0:
        while e < z:
            stop = np.flatnonzero(_CLASS[data[e : min(z, e + 4096)]])
            if len(stop):
                return e + int(stop[0])
            e += 4096
        return min(e, z)
    for _ in range(words):
        while e < z:
            c = _CLASS[data[e : min(z, e + 4096)]]
            stop = np.flatnonzero(c != 1)
            if len(stop):
                e += int(stop[0])
                if c[stop[0]] == 2:
                    return e
                break
            e += 4096
        e = _after(data, min(e, z), z, 0)
    return e


def _held(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(h), bool)
    v = h >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[v >> np.uint64(3)] >> (v & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _runs(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each distinct pair, and how often it is there."""
    order = np.argsort(h)
    a, b = h[order], h2[order]
    new = np.r_[True, a[1:] != a[:-1]]
    if (b != b[np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))]).any():  # 64 bits alike, 128 not
        order = np.lexsort((h2, h))
        a, b = h[order], h2[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.r_[first, len(h)])


def _hashed_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where words begin and end, which bytes are of words, and two hashes of each word."""
    n = len(data)
    black = _CLASS[data] == 0
    first, last, cut = black.copy(), black.copy(), at[(at > 0) & (at < n)]
    free = np.ones(n + 1, bool)
    free[cut] = False
    first[1:] &= ~(black[:-1] & free[1:n])
    last[:-1] &= ~(black[1:] & free[1:n])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    size = (end - start).astype(np.uint64) * _C
    hashes = []
    for table in (_BYTE, _BYTE_2):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * down[start] + size))
    return start, end, black, *hashes


def phrases_of(data: np.ndarray, at: np.ndarray, limit: int, seed: np.ndarray, old: np.ndarray | None, new: np.ndarray | None, words: bool) -> tuple[int, list[tuple]]:
    """Words that begin before limit, and for each length: first words' texts, phrases' bytes and offsets, counts. old: proposals whose phrases have been counted (None: none); new: those to count for (None: all)."""
    c, n = _CLASS[data], len(data)
    start, end, black, w, w2 = _hashed_words(data, at)
    counted = int(np.searchsorted(start, limit))
    if not counted:
        return 0, []
    keep = black.copy()
    keep[1:] |= (c[1:] == 1) & black[:-1]
    place = np.r_[0, np.cumsum(keep)]
    lean = _LOWER[data[keep]]
    doc = np.searchsorted(at, start, "right") - 1
    piece = np.r_[0, np.cumsum(c == 2)][start] + doc
    seeds = seed[doc]
    h, h2 = mix(w ^ seeds), mix(w2 + seeds)
    member, before = _held(new, h), _held(old, h) if old is not None else np.zeros(len(h), bool)
    found, ok, known = [], np.ones(len(h), bool), np.zeros(len(h), bool)
    ok[counted:] = False
    for k in range(1, LONGEST + 1):
        if k > 1:
            m = len(start) - k + 1
            if m <= 0:
                break
            here = piece[:m] == piece[k - 1 :]
            ok, known = here & member[:m] & member[1 : m + 1], here & before[:m] & before[1 : m + 1]
            h, h2 = mix(h[:m] * _C + w[k - 1 :]), mix(h2[:m] * _C + w2[k - 1 :])
            member = ok.copy()
            member[ok] = _held(new, h[ok])
            before = known.copy()
            if old is not None:
                before[known] = _held(old, h[known])
        if k == 1 and not words:
            continue
        i = np.flatnonzero(ok[:counted] & ~known[:counted])
        if len(i):
            at_first, count = _runs(h[i], h2[i])
            i = i[at_first]
            a, z = place[start[i]], place[end[i + k - 1]]
            ends = np.r_[0, np.cumsum(z - a)]
            text = lean[np.repeat(a - ends[:-1], z - a) + np.arange(ends[-1])]
            found.append((k, doc[i], text, ends, count))
    return counted, found


def counted(docs: DataFrame, old: Broadcast | None, new: Broadcast | None, words: bool, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, n, phrase, f: exact counts of all phrases that the proposals `new` (a bitmap that is broadcast) call for and `old` didn't; single words with `words`. n = 0 holds the number of all words."""
    small_batches(docs.sparkSession)
    held = old, new

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = (x and x.value for x in held)
        schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("c", pa.int64())])
        for b in batches:
            names = b.column(1).fill_null("und").dictionary_encode()
            langs, code = names.dictionary, names.indices.to_numpy()
            seed = np.array([_seed(x) for x in langs.to_pylist()], np.uint64)[code]
            total = np.zeros(len(langs), np.int64)
            for i, data, at, limit in _views(*utf8(b.column(0))):
                if not limit:
                    continue
                _, found = phrases_of(data, at, limit, seed[i:], old, new, words)
                for k, doc, text, ends, c in found:
                    lang = code[i + doc]
                    if k == 1:
                        total += np.bincount(lang, c, len(langs)).astype(np.int64)
                    phrase = pa.Array.from_buffers(pa.string(), len(c), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text)])
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), pa.array(np.full(len(c), k, np.int32)), phrase, pa.array(c)], schema=schema)
            some = np.flatnonzero(total)
            if len(some):
                m = len(some)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(some)), pa.array(np.zeros(m, np.int32)), pa.array([""] * m), pa.array(total[some])], schema=schema)

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, SCHEMA)
    return rows.groupBy("lang", "n", "phrase").agg(F.sum("c").alias("f"))


def hashed(found: DataFrame) -> DataFrame:
    """Adds h, the hash that the bitmap holds a phrase by. Only frequent phrases need it, so it stays out of the shuffle of all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = b.column(1).to_numpy(), np.zeros(len(b), np.uint64)
            seed = np.array([_seed(x) for x in b.column(0).to_pylist()], np.uint64)
            data, at = utf8(b.column(2))
            start, end, _, w, _ = _hashed_words(data, at)
            first = np.searchsorted(start, at[:-1])
            for k in range(LONGEST):
                some = np.flatnonzero(n > k)
                x = w[first[some] + k]
                out[some] = mix(x ^ seed[some]) if k == 0 else mix(out[some] * _C + x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.view(np.int64))], names=[*b.schema.names, "h"])

    return found.mapInArrow(add, "lang string, n int, phrase string, f long, h long")


def _bitmap(found: DataFrame, bits: int, on: np.ndarray | None = None) -> np.ndarray:
    """The bitmap of the hashes of found phrases, added to another one. At most 2^bits bits come to the driver."""
    v = F.shiftrightunsigned("h", 64 - bits) + 1
    rows = hashed(found).groupBy(F.bitmap_bucket_number(v).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8) if on is None else on.copy()
    for r in rows:
        a = (r["bucket"] - 1) * (_BUCKET // 8)
        out[a : a + _BUCKET // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _outside(found: DataFrame, shared: Broadcast) -> DataFrame:
    """Phrases that the bitmap doesn't hold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~_held(shared.value, b.column(4).to_numpy().view(np.uint64)))).select(["lang", "n", "phrase", "f"])

    return hashed(found).mapInArrow(keep, "lang string, n int, phrase string, f long")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, sample_bytes: int = SAMPLE_BYTES, fraction: float = FRACTION, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, n, phrase, f: all phrases of 1 to LONGEST words that are there min_count times or more, and the number of words as the phrase of no words. bits: of the bitmap, 15 or more."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    share = min(fraction, sample_bytes / max(1, size))
    mean = min_count * share
    lowered = max(min(2, min_count), int(mean - 2 * mean**0.5))
    drawn = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("collocations")), F.lit(1 << 30)) < share * (1 << 30))
    bits = min(bits, max(15, size.bit_length() + 1))
    send = docs.sparkSession.sparkContext.broadcast
    held = _bitmap(counted(drawn, None, None, True, text_col, lang_col).filter((F.col("f") >= lowered) & F.col("n").between(1, LONGEST - 1)), bits)
    old, new, out = None, send(held), None
    while True:
        found = stored(counted(docs, old, new, out is None, text_col, lang_col).filter((F.col("f") >= min_count) | (F.col("n") == 0)), "phrases")
        out = found if out is None else out.unionByName(found)
        failed = stored(_outside(found.filter(F.col("n").between(1, LONGEST - 1)), new), "failures")
        if old is not None:
            old.destroy()
        if failed.isEmpty():
            new.destroy()
            return out.select("lang", "n", "phrase", "f")
        held = _bitmap(failed, bits, held)
        old, new = new, send(held)


def collocations(docs: DataFrame, top: int = TOP, percent: int = PERCENT, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of two words or more whose weakest cut holds best, without those that mostly occur inside a longer one. how: see frequent_phrases."""
    found = frequent_phrases(docs, **how)
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    part = lambda a, m: F.array_join(F.slice("words", a, m), " ")
    many = found.filter("n >= 2").select("lang", "n", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    known = found.filter(F.col("n").between(1, LONGEST - 1))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    over = many.filter("n >= 3").select("lang", F.explode(inner).alias("inner"), "a").groupBy("lang", "inner").agg(F.max("a").alias("longer"))
    over = over.select(F.col("lang").alias("o_lang"), F.col("inner").alias("o_phrase"), "longer")
    kept = scored.join(over, (F.col("lang") == F.col("o_lang")) & (F.col("phrase") == F.col("o_phrase")), "left")
    kept = kept.filter(F.col("longer").isNull() | (100 * exact("longer") < percent * exact("a"))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = top_per_group(kept, ["lang"], top, [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "phrase", "rank")
    words = found.filter("n = 0").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's collocations in all texts. Edge cases: see the module."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
c AS (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) v(m)) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE m = 1 GROUP BY lang),
f AS (SELECT * FROM c WHERE f >= 30),
x AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
y AS (SELECT x.lang, x.phrase, m, a, k, lf AS l, rf AS r, CAST(2000000::HUGEINT * a // (lf + rf) AS BIGINT) AS score FROM x
      JOIN (SELECT lang, phrase AS lp, f AS lf FROM f) fl ON fl.lang = x.lang AND lp = array_to_string(ws[1:k], ' ') JOIN (SELECT lang, phrase AS rp, f AS rf FROM f) fr ON fr.lang = x.lang AND rp = array_to_string(ws[k + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT DISTINCT lang, m, ws, a, unnest(range(2, m)) AS s FROM x), unnest(range(1, 4)) u(i) WHERE i + s - 1 <= m GROUP BY ALL)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank, z.phrase, a, l, r, n, score FROM z LEFT JOIN o USING (lang, phrase) JOIN t ON t.lang = z.lang
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000
"""

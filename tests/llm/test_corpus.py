"""Media, WARC, mixing, packing, licenses and the pipeline."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratolens.llm import jpeg, licenses, media, mixing, packing, warc
from stratolens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_avi_round_trip(docs, texts, empty):
    videos = media.text_videos(docs).cache()
    by = defaultdict(set)
    for r in media.video_features(videos).collect():
        by[r["doc_id"]].add(tuple(r)[1:])
    assert all(got[-1].startswith("0.00-") for x in by.values() for got in x)
    for i, t in texts:
        b = (t or "").encode()
        n = len(b)
        b += b"\xff" * (576 - n % 576 if n % 576 or not n else 0)
        (got,) = by[i]
        assert got[:4] == (n, len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-32:]))
    rows = media.shot_clips(videos).filter("doc_id <> 130").orderBy("clip_no").collect()
    for r in media.video_features(videos).filter("doc_id <> 130").collect():
        assert r["clips"] == ",".join(f"{x['start_s']:.2f}-{x['end_s']:.2f}" for x in rows if x["doc_id"] == r["doc_id"])
    clips = media.shot_clips(videos).groupBy("doc_id").agg(F.max("end_frame").alias("n"), F.sum(F.col("end_frame") - F.col("first_frame")).alias("all")).collect()
    assert all(r["n"] == r["all"] for r in clips if r["doc_id"] not in (130,))
    assert media.video_features(media.text_videos(empty)).collect() == []


def test_avi_of_noise_and_of_broken_files():
    samples = np.random.default_rng(0).integers(0, 256, (40, media.FRAME)).astype(np.uint8)
    file = media.avi([media._HEAD + s + media._END for s in media._scans(samples)])
    assert (media.decode(media.frames_of(file)) == samples).all()
    with pytest.raises(ValueError):
        media.frames_of(b"RIFX" + file[4:])
    with pytest.raises(ValueError):
        media.decode([b"\xff\xd8\xff\xd9"])


def _bits(pairs):
    """Codes (value, length) as stuffed bytes, filled up with ones."""
    s = "".join(f"{v:0{n}b}" for v, n in pairs if n)
    s += "1" * (-len(s) % 8)
    return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def _value(d):
    """Size of a difference, and its extra bits."""
    n = abs(d).bit_length()
    return n, (d if d >= 0 else d + (1 << n) - 1, n)


def _segment(marker, data):
    return bytes([255, marker]) + (len(data) + 2).to_bytes(2, "big") + data


@pytest.mark.parametrize("kind", range(1, 8))
def test_lossless_frames_of_any_size_table_and_predictor(kind):
    rng = np.random.default_rng(kind)
    x = np.cumsum(rng.integers(-3, 4, (11, 17)), 1).astype(np.int64) % 256
    rows, codes, order = 5, [], [3, 0, 1, 2, 4, 5, 6, 7, 8, 9]  # symbols by code; all codes have four bits
    for y in range(11):
        if y % rows == 0 and y:
            codes.append(None)
        for k in range(17):
            a, b, c = (int(x[y, k - 1]), int(x[y - 1, k]), int(x[y - 1, k - 1])) if y and k else (0, 0, 0)
            before = (int(x[y, k - 1]) if k else 128) if y % rows == 0 else int(x[y - 1, 0]) if not k else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) // 2)[kind - 1]
            n, extra = _value(int(x[y, k]) - before)
            codes += [(order.index(n), 4), extra]
    scans, part = [], []
    for c in [*codes, None]:
        if c is None:
            scans.append(_bits(part))
            part = []
        else:
            part.append(c)
    scan = scans[0] + b"".join(bytes([255, 0xD0 + i % 8]) + s for i, s in enumerate(scans[1:]))
    frame = b"\xff\xd8" + _segment(0xC4, bytes([0] + [0, 0, 0, 10] + [0] * 12 + order)) + _segment(0xDD, (rows * 17).to_bytes(2, "big")) + _segment(0xC3, bytes([8, 0, 11, 0, 17, 1, 1, 0x11, 0])) + _segment(0xDA, bytes([1, 1, 0, kind, 0, 0])) + scan + b"\xff\xd9"
    assert (jpeg.luma(frame) == x).all()
    assert (media.decode(media.frames_of(media.avi([frame] * 3))) == x.reshape(-1)).all()
    with pytest.raises(ValueError):
        jpeg.luma(frame[:-30] + b"\xff\xd9")


@pytest.mark.parametrize("sampling", [(1, 1), (2, 2)])
def test_baseline_frames(sampling):
    """Blocks of known coefficients against the cosine sum, written out; chroma is skipped where it lies."""
    rng = np.random.default_rng(0)
    h, v = sampling
    one = h * v == 1
    size = (16, 24) if one else (30, 26)
    mcus = (2, 3) if one else (2, 2)
    want = np.zeros((mcus[0] * 8 * (1 if one else v), mcus[1] * 8 * (1 if one else h)))
    symbols = sorted({*range(12), *(r << 4 | n for r in range(16) for n in range(1, 11)), 0, 0xF0})
    at, codes, dc = {s: i for i, s in enumerate(symbols)}, [], [0, 0, 0]

    def put(component, coef):
        n, extra = _value(int(coef[0]) - dc[component])
        dc[component] = int(coef[0])
        codes.extend([(at[n], 8), extra])
        run = 0
        for c in coef[1:]:
            if not c:
                run += 1
                continue
            while run > 15:
                codes.append((at[0xF0], 8))
                run -= 16
            n, extra = _value(int(c))
            codes.extend([(at[run << 4 | n], 8), extra])
            run = 0
        if run:
            codes.append((at[0], 8))

    for my in range(mcus[0]):
        for mx in range(mcus[1]):
            for j in range(1 if one else h * v):
                coef = np.where(rng.random(64) < 0.1, rng.integers(-9, 10, 64), 0)
                coef[0] = rng.integers(-60, 60)
                put(0, coef)
                y0, x0 = ((my, mx) if one else (my * v + j // h, mx * h + j % h))
                for y in range(8):
                    for x in range(8):
                        want[y0 * 8 + y, x0 * 8 + x] = sum(coef[i] * 2 * (0.5**0.5 if not p[0] else 1) * (0.5**0.5 if not p[1] else 1) / 4 * np.cos((2 * y + 1) * p[0] * np.pi / 16) * np.cos((2 * x + 1) * p[1] * np.pi / 16) for i, p in enumerate(jpeg.ZIGZAG) if coef[i])
            for c in () if one else (1, 2):
                put(c, rng.integers(-3, 4, 64))
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    parts = [(1, 16 * h + v)] + ([] if one else [(2, 0x11), (3, 0x11)])
    frame = b"\xff\xd8" + _segment(0xDB, bytes([0] + [2] * 64)) + _segment(0xC4, b"\x00" + table + b"\x10" + table) + _segment(0xC0, bytes([8, 0, size[0], 0, size[1], len(parts)]) + b"".join(bytes([i, s, 0]) for i, s in parts))
    frame += _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i, 0]) for i, _ in parts) + bytes([0, 63, 0])) + _bits(codes) + b"\xff\xd9"
    assert np.abs(jpeg.luma(frame).astype(int) - np.clip(np.round(want[: size[0], : size[1]] + 128), 0, 255)).max() <= 1
    assert jpeg.ZIGZAG[:6] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)] and len(set(jpeg.ZIGZAG)) == 64


def test_cuts_equal_a_loop():
    rng = np.random.default_rng(7)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        level = np.repeat(rng.integers(0, 250, n), rng.integers(1, 5, n))[:n]
        samples = np.clip(level[:, None] + rng.integers(-6, 7, (n, media.FRAME)), 0, 255).astype(np.uint8)
        hist = [np.bincount(x >> 4, minlength=16) for x in samples]
        change = [np.abs(a - b).sum() / (2 * media.FRAME) for a, b in zip(hist[1:], hist)]
        want = []
        for i, c in enumerate(change):
            before = [min(x, media.LEAST) for x in change[max(0, i - media.RECENT) : i]]
            bound = np.mean(before) + media.DEVIATIONS * np.std(before) if before else 0
            if c > max(media.LEAST, bound) + 1e-9:
                want.append(i + 1)
        assert media.cuts(samples) == want


def test_cuts():
    dark, light = np.full((6, media.FRAME), 10, np.uint8), np.full((6, media.FRAME), 200, np.uint8)
    assert media.cuts(np.concatenate([dark, light, dark])) == [6, 12] and media.cuts(dark) == [] and media.cuts(dark[:1]) == []


def test_warc(spark):
    long = "é" * (3 * warc.CHUNK)
    rows = [(1, "u\r\n1", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (5, "u5", long), (0, "u0", long), (6, "u6", "\r\n\r\nHTTP"), (6, "u6", "\r\n\r\nHTTP"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    chunks = warc.write_warc(pages)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= warc.CHUNK + 4
    got = sorted((tuple(r) for r in warc.read_warc(chunks).drop("url").collect()), key=str)
    want = []
    for i, _, t in rows:
        b = (t or "").encode()
        first = min(x for x, _, y in rows if (y or "") == (t or "") and x is not None)
        want.append((None if i is None else str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else str(first), True))
    assert got == sorted(want, key=str)
    assert warc.read_warc(warc.write_warc(pages.limit(0))).collect() == []


def test_warc_keeps_identifiers_as_they_are(spark):
    ids = ["", "a\nb", "a%0Ab", "a: b", " c ", "\r\n\r\n", "é漢", "%", None]
    pages = spark.createDataFrame([(i, "u", f"page {n // 2}") for n, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r["source"]: r for r in warc.read_warc(warc.write_warc(pages)).collect()}
    assert set(got) == set(ids) and all(r["intact"] for r in got.values())
    for a, b in zip(ids[::2], ids[1::2]):
        first, other = sorted((a, b))
        assert got[first]["record_type"] == "response" and got[first]["refers_to"] is None
        assert got[other]["record_type"] == "revisit" and got[other]["refers_to"] == first


def _records(folder):
    """Headers of each gzip member of the files in a folder, read with the standard library alone."""
    for path in sorted(folder.glob("*.warc.gz")):
        data = path.read_bytes()
        while data:
            member = zlib.decompressobj(31)
            record, data = member.decompress(data), member.unused_data
            head, body = record.split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert len(body) == int(fields["Content-Length"]) + 4
            yield fields, body[: -4]


@pytest.mark.parametrize("hot", [4, 10**6])
def test_warc_files_and_record_ids(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    rows = [(i, f"u{i}", "error page" if i % 3 == 0 else f"page {i % 40} " + "é" * (i * 50)) for i in range(120)] + [(1, "again", "page 1 " + "é" * 50), (None, "n", "error page"), (7, "v", ""), (8, "w", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    done = warc.write_files(warc.write_warc(pages), str(tmp_path / "out")).collect()
    found = list(_records(tmp_path / "out"))
    assert sum(r["records"] for r in done) == len(found) == len(rows)
    ids = [f["WARC-Record-ID"] for f, _ in found]
    assert len(set(ids)) == len(ids)
    by = {f["WARC-Record-ID"]: (f, body) for f, body in found}
    revisits = [f for f, _ in found if f["WARC-Type"] == "revisit"]
    assert len(revisits) == len(rows) - len({h or "" for _, _, h in rows}) - 1
    for f in revisits:
        if f["X-Refers-To-Source"] != "1":
            assert by[f["WARC-Refers-To"]][0]["X-Source-Id"] == f["X-Refers-To-Source"] and by[f["WARC-Refers-To"]][0]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
    bodies = {f["X-Source-Id"]: body.split(b"\r\n\r\n", 1)[1].decode() for f, body in found if f["WARC-Type"] == "response"}
    assert all(bodies[i] == (dict((str(r[0]), r[2]) for r in rows[:120])[i]) for i in bodies if i not in ("1", "7", "8"))
    small = warc.read_warc(warc.write_warc(pages, least=10**6)).collect()
    assert {r["record_type"] for r in small} == {"response"} and all(r["intact"] for r in small)


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs, block=8, shard_words=500).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    of = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        of[r["source"]][0] += r["size"]
        of[r["source"]][1] += r["taken"]
        of[r["source"]][2] = r["target"]
        assert r["source_size"] == sum(x["size"] for x in rows if x["source"] == r["source"])
    total = sum(x[0] for x in of.values())
    order = sorted((s for s in of if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, target, capped = {s: 1 + i % 3 for i, s in enumerate(order)}, {}, set()
    while True:
        left = total - sum(3 * of[s][0] for s in capped)
        open_ = [s for s in order if s not in capped]
        target = {s: 3 * of[s][0] if s in capped else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 3 * of[s][0]}
        if not over:
            break
        capped |= over
    for s, (size, taken, t) in of.items():
        assert t == pytest.approx(target[s]) and abs(taken - t) <= 8 * (3 + size // 500), s
    again = {(r["doc_id"], r["digest"]): r["taken"] for r in mixing.mix_sources(docs.repartition(7), block=8, shard_words=500).collect()}
    assert all(again[r["doc_id"], r["digest"]] == r["taken"] for r in rows if r["doc_id"] != 130)
    teams = {(r["doc_id"], r["digest"]): r for r in mixing.mix_sources(docs, block=8, shard_words=200, fan=3).collect()}
    for s, (size, _, t) in of.items():
        rows_of = [r for r in teams.values() if r["source"] == s]
        assert all(r["taken"] <= 3 * r["size"] for r in rows_of)
        assert abs(sum(r["taken"] for r in rows_of) - t) <= 8 * (3 + size // 200) + 3 * sum(r["size"] for r in rows if r["doc_id"] == 130), s
    assert mixing.mix_sources(empty).collect() == []


def test_rows_without_identifier_are_spread(spark):
    rows = [(None if i % 3 == 0 else i, f"text {i} " + "w " * (i % 40), "a") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, block=8, shard_words=300)
    a = sorted((str(r["doc_id"]), r["digest"], r["taken"]) for r in got.collect())
    assert a == sorted((str(r["doc_id"]), r["digest"], r["taken"]) for r in mixing.mix_sources(df.repartition(5), block=8, shard_words=300).collect())
    assert sum(x[2] for x in a) == pytest.approx(sum(len(t.split()) for _, t, _ in rows), rel=0.05)
    key = mixing._seeded(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text")), 0)
    shards = df.filter("doc_id is null").groupBy(F.pmod(mixing._number(key), F.lit(60)).alias("s")).count().collect()
    assert len(shards) > 50 and max(r["count"] for r in shards) < 20


def test_highest_quotients(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        w, seats = rng.integers(1, 200, 9).tolist(), int(rng.integers(0, 400))
        df = spark.createDataFrame([("g", i, x, sum(w), len(w), seats, 10**6) for i, x in enumerate(w)], "g string, rank long, w long, all_w long, n long, seats long, most long")
        got = {r["rank"]: r["quota"] for r in mixing._apportion(df, ["g"], "rank").collect()}
        want = [0] * len(w)
        for _ in range(seats):
            want[max(range(len(w)), key=lambda i: (w[i] / (2 * want[i] + 1), -i))] += 1
        assert [got[i] for i in range(len(w))] == want


def test_packing(docs, texts, empty):
    sizes = (64, 128, 256, 1024)
    rows = packing.pack_sequences(docs, sizes=sizes, shard_pieces=50).collect()
    per, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        per[r["doc_id"]] += r["n_words"]
        if r["n_words"]:
            bins[r["bin_id"]].append(r)
        else:
            assert r["bin_id"] is None
    words = defaultdict(int)
    for i, t in texts:
        words[i] += len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    assert per == words
    for b in bins.values():
        b.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in b] == np.cumsum([0, *(r["n_words"] for r in b)])[:-1].tolist()
        used = sum(r["n_words"] for r in b)
        assert all(r["bin_used"] == used and r["bin_size"] == min(s for s in sizes if s >= used) for r in b)
    assert packing.pack_sequences(empty).collect() == []


def plain_packing(lengths, sizes, fixed, square):
    """Final sizes by the joint rule: best fit, and bins of the length that a trial with the longest pieces left fills at least cost."""
    cost = lambda s: packing.cost_of(s, fixed, square)
    holds = lambda used: min(s for s in sizes if s >= used)
    room, used = [], []
    for i, n in enumerate(lengths):
        fits = [b for b, r in enumerate(room) if r >= n]
        if fits:
            r = min(room[b] for b in fits)
            b = max(b for b in fits if room[b] == r)  # bins of equal room differ in nothing that counts
        else:
            filled = {}
            for s in sizes:
                if s >= n:
                    filled[s] = n
                    for m in lengths[i + 1 :]:
                        filled[s] += m if filled[s] + m <= s else 0
            b = len(room)
            room.append(min(filled, key=lambda s: (cost(holds(filled[s])) / filled[s], -s)))
            used.append(0)
        room[b] -= n
        used[b] += n
    return sum(cost(holds(u)) for u in used), len(used)


def cost_of_bins(plan, fixed, square):
    return sum(packing.cost_of(s, fixed, square) for s in plan[2])


def test_bins_open_in_the_length_of_least_cost():
    rng = np.random.default_rng(6)
    for sizes, fixed, square, top in [((16, 32, 64), 5, 100, 64), ((8, 24, 40), 1, 40, 30), ((256, 512, 1024, 2048, 4096), 64, 16_384, 900)]:
        lengths = sorted(rng.integers(1, top + 1, 120).tolist(), reverse=True)
        joint = packing._pack(lengths, sizes, {s: packing.cost_of(s, fixed, square) for s in sizes}, None)
        assert (pytest.approx(cost_of_bins(joint, fixed, square)), len(joint[2])) == plain_packing(lengths, sizes, fixed, square)
        bins, places, final = packing.best_fit(lengths, sizes, fixed, square)
        content = defaultdict(list)
        for n, b, at in zip(lengths, bins, places):
            assert at == sum(content[b])
            content[b].append(n)
        assert all(final[b] == min(s for s in sizes if s >= sum(x)) for b, x in content.items()) and len(content) == len(final)


@pytest.mark.parametrize("lengths,most", [([520] * 200, 158_656), ([700] * 200, 207_360), ([300] * 100 + [200] * 50, 47_360), ([4096] * 3 + [1] * 5, None), ([], None)])
def test_lengths_together_are_never_dearer_than_one(lengths, most):
    sizes = packing.SIZES
    together = cost_of_bins(packing.best_fit(lengths, sizes), 64, 16_384)
    cost = {s: packing.cost_of(s) for s in sizes}
    assert all(together <= cost_of_bins(packing._pack(lengths, sizes, cost, s), 64, 16_384) for s in sizes) and together <= (most or together)


def test_packing_is_near_the_best():
    rng = np.random.default_rng(8)
    sizes, fixed, square = (4, 6, 9, 16), 1, 20

    def best(left, bins):
        if not left:
            return sum(packing.cost_of(min(s for s in sizes if s >= b), fixed, square) for b in bins)
        n, rest = left[0], left[1:]
        out = best(rest, (*bins, n))
        for i in {b: i for i, b in enumerate(bins) if b + n <= sizes[-1]}.values():
            out = min(out, best(rest, (*bins[:i], bins[i] + n, *bins[i + 1 :])))
        return out

    ratios = []
    for _ in range(40):
        lengths = sorted(rng.integers(1, 10, 7).tolist(), reverse=True)
        ratios.append(cost_of_bins(packing.best_fit(lengths, sizes, fixed, square), fixed, square) / best(tuple(lengths), ()))
    assert max(ratios) < 1.25 and np.mean(ratios) < 1.05, (max(ratios), np.mean(ratios))


def test_licenses(spark, empty):
    rows = [(1, "x y\nReleased under the MIT License."), (2, "released, UNDER the mit license and more " * 2), (3, "under the licence of mit"), (4, None), (5, ""), (6, "Licensed"), (7, "Licensed under CC BY-NC 4.0.")]
    rows += [(8, "filler " * 5000 + licenses.TEMPLATES["GPL-notice"].replace("redistribute", "share") + " filler" * 100), (None, "Released under the MIT License.")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k in got if k[0] != 8} == {(1, "MIT"), (2, "MIT"), (7, "CC-BY-NC-4.0"), (None, "MIT")}
    assert got[1, "MIT"]["first_word"] == 2 and got[8, "GPL-notice"]["containment"] < 1 and got[8, "GPL-notice"]["first_word"] == 5000
    assert licenses.scan_licenses(empty).collect() == []


def plain_scan(rows, templates):
    """License and the windows that hold it, by the definition."""
    out = {}
    for i, text in rows:
        pairs = licenses._words(text or "")
        pairs = list(zip(pairs, pairs[1:]))
        for k, t in templates.items():
            has = set(licenses._pairs(t))
            w = licenses.width(len(has))
            starts = [a for a in range(0, len(pairs), w // 4) if len(has & set(pairs[a : a + w])) >= licenses.need(len(has))]
            if starts:
                first = min(j for a in starts for j in range(a, min(a + w, len(pairs))) if pairs[j] in has)
                out[i, k] = (max(len(has & set(pairs[a : a + w])) / len(has) for a in starts), first, len(starts))
    return out


def test_licenses_in_blocks_equal_the_plain_scan(spark):
    rng = np.random.default_rng(3)
    filler, rows = ["alpha", "beta", "the", "software", "of", "in", "notice", "x" * 90], []
    for i, (_, t) in enumerate(licenses.TEMPLATES.items()):
        w = licenses._words(t)
        for j in range(2):  # every tenth word changed, long texts around it
            part = [x if rng.random() > 0.1 * j else "changed" for x in w]
            rows.append((2 * i + j, " ".join([*rng.choice(filler, rng.integers(0, 900)), *part, *rng.choice(filler, rng.integers(0, 900))])))
    rows += [(900, "word " * 3000), (901, "y" * 9000)]
    got = licenses.scan_licenses(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string"), block=4000).collect()
    assert len(got) == len({(r["doc_id"], r["license"]) for r in got})
    assert {(r["doc_id"], r["license"]): (pytest.approx(r["containment"]), r["first_word"], r["windows"]) for r in got} == plain_scan(rows, licenses.TEMPLATES)


@pytest.mark.parametrize("block", [8, 16, 40, 200])
def test_words_far_apart_equal_the_plain_scan(spark, block):
    """Blanks, signs, other scripts and long words between a template's words, so that blocks have few words or none."""
    rng = np.random.default_rng(block)
    gaps, rows = [" ", " " * 3 * block, "\n" + "漢字 " * block, " ... " * block, "é" * block, " " + "q" * 2 * block + " "], []
    for i, k in enumerate(("MIT-grant", "GPL-notice", "CC-BY-4.0", "MIT", "Zlib-full")):
        w = licenses._words(licenses.TEMPLATES[k])
        rows.append((i, "lead words here" + " " * 5 * block + "".join(x + gaps[rng.integers(5) if rng.random() < 0.3 else 0] for x in w) + " end"))
        rows.append((10 + i, "".join(x + gaps[rng.integers(6) if rng.random() < 0.1 else 0] for x in w)))
    rows += [(20, " " * 9 * block), (21, licenses.TEMPLATES["MIT"] + " " * 50 * block)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert {(r["doc_id"], r["license"]): (pytest.approx(r["containment"]), r["first_word"], r["windows"]) for r in got} == plain_scan(rows, licenses.TEMPLATES)


def test_a_gap_longer_than_blocks(spark):
    w = licenses.TEMPLATES["MIT-grant"].split()
    rows = [(1, " ".join(w[:9]) + " " * 450_000 + " ".join(w[9:])), (2, " ".join(w))]
    assert {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(1, "MIT-grant"): 1.0, (2, "MIT-grant"): 1.0}


def test_bands_retrieve_by_themselves(spark):
    """Windows with the least share of a template's shingles, the others random: all are retrieved."""
    rng, rows = np.random.default_rng(5), []
    n_bands = licenses.bands()
    for k, t in licenses.TEMPLATES.items():
        pairs = licenses._pairs(t)
        for j in range(6):
            some = [pairs[i] for i in rng.permutation(len(pairs))[: licenses.need(len(pairs))]]
            some += [(f"r{rng.integers(10**9)}", "r") for _ in range(licenses.width(len(pairs)) - len(some))]
            rows.append((len(rows), k, licenses.width(len(pairs)), [f"{a} {b}" for a, b in some]))
    df = spark.createDataFrame(rows, "doc_id long, want string, width int, words array<string>")
    df = df.withColumn("pairs", F.transform("words", lambda x: F.xxhash64(F.split(x, " ")[0], F.split(x, " ")[1])))
    met = licenses._retrieved(df.withColumn("minima", licenses._minima(F.col("pairs"), n_bands)), licenses.TEMPLATES, n_bands)
    assert met.filter("want = license").select("doc_id").distinct().count() == len(rows)


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may read this text and share it with all of your friends")
    (tmp_path / "empty.txt").write_text("")
    own = licenses.templates_of(spark, str(tmp_path))
    assert list(own) == ["Own-1.0"]
    docs = spark.createDataFrame([(1, "Header: you may read this text and share it with all of your friends."), (2, "you may")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs, templates=own).collect()] == [(1, "Own-1.0")]


def test_every_template_is_found_in_itself(spark):
    rows = [(i, f"{'a b c ' * i}{t}{' d e f' * i}") for i, t in enumerate(licenses.TEMPLATES.values())]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, k) for i, k in enumerate(licenses.TEMPLATES)} <= got


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    kept = corpus_pipeline.keep_languages(spark, docs, SF).cache()
    assert kept.columns == docs.columns and n * 0.98 <= kept.count() <= n
    single = corpus_pipeline.drop_exact_copies(spark, kept, SF).cache()
    assert single.columns == docs.columns
    blankless = F.translate("text", " \t\n\x0b\x0c\r", "")
    assert single.count() == kept.select(blankless.alias("t")).distinct().count() == single.select(blankless.alias("t")).distinct().count()
    far = corpus_pipeline.drop_near_copies(spark, single, SF).cache()
    assert far.columns == docs.columns and far.count() <= single.count()
    mixed = corpus_pipeline.mix(spark, far, SF).cache()
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = corpus_pipeline.pack(spark, mixed, SF)
    assert packed.agg(F.sum("n_words")).first()[0] == mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mix_sources", "best_fit_packing"]


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("rows", [0, 1])
def test_pipeline_stages_take_edge_cases(spark, docs, empty, rows):
    """Nulls in any column, repeated rows, clashing columns; and no rows at all."""
    some = (docs if rows else empty).withColumn("kept", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, some, SF)
        if name == "best_fit_packing":
            assert (out.count() > 0) == bool(rows)
        else:
            assert out.columns == some.columns and (out.count() > 0) == bool(rows)

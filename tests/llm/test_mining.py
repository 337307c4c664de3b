"""Whitening, toxicity and phrase collocations against plain versions."""

import os
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratolens.llm import collocations, toxicity, whitening

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least, top=2000, longest=4):
    out = []
    by = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                by[lang or ("und" if lang is None else lang)].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, f in by.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in many.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in many.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["É", "été", "漢字", "don't", "a-b", "A", "B"]
    rows = []
    for i in range(300):
        w = rng.choices(words, k=rng.randint(0, 40))
        if i % 3 == 0:
            w += ["New", "York", "City", "hall"] * rng.randint(1, 3)
        rows.append((i if i % 50 else None, "".join(x + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "! ", " - "]) for x in w), rng.choice(["en", "de", None, "und", ""])))
    return [*rows, (1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "x " * 5000, "en"), (5, "New York City hall", "xx"), *rows[:20]]


@pytest.mark.parametrize("fraction, least, top", [(0.3, 8, 2000), (0.0, 5, 20)])
def test_collocations(spark, prose, fraction, least, top):
    """Also with samples that propose little or nothing: the border's failures bring in the rest."""
    df = spark.createDataFrame(prose, "doc_id long, text string, lang string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    got = collocations.collocations(df, top=top, min_count=least, fraction=fraction, bits=16)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain_collocations([r[1:] for r in prose], least, top)
    assert collocations.collocations(df.limit(0)).collect() == []
    assert collocations.collocations(df.filter("doc_id in (1, 2, 3)").withColumn("text", F.lit(None).cast("string"))).collect() == []


def test_bitmaps_of_small_inputs_are_small(spark, prose, monkeypatch):
    """Each round's bitmap is broadcast once, no larger than the input calls for, and taken back."""
    from pyspark import SparkContext

    sent, plain = [], SparkContext.broadcast

    def broadcast(sc, value):
        sent.append((value, out := plain(sc, value)))
        return out

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    df = spark.createDataFrame(prose, "doc_id long, text string, lang string")
    got = collocations.collocations(df, min_count=3, fraction=0.0)
    assert sorted(map(tuple, got.collect())) == plain_collocations([r[1:] for r in prose], 3, collocations.TOP)
    bitmaps = [v for v, _ in sent if isinstance(v, np.ndarray)]
    assert 1 < len(bitmaps) == len(sent) <= collocations.LONGEST + 1 and len({len(b) for b in bitmaps}) == 1
    assert len(bitmaps[0]) <= max(1 << 12, sum(len((r[1] or "").encode()) for r in prose))
    assert not any(os.path.exists(b._path) for _, b in sent)


def test_phrases_over_cuts(monkeypatch, prose):
    """Long texts are read a piece at a time; no phrase is lost or counted twice."""
    texts = [r[1] for r in prose] + ["one two three four five six. " * 40 + "z" * 300 + " end", "", "a.b.c d"]
    want = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(" ".join(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(collocations, "PIECE", size)
        got = Counter()
        for i, data, at, limit in collocations._views(*collocations.utf8(pa.array(texts, pa.string()))):
            if limit:
                for k, doc, text, ends, c in collocations.phrases_of(data, at, limit, np.ones(len(texts), np.uint64), None, None, True)[1]:
                    for a, z, n in zip(ends, ends[1:], c):
                        got[text[a:z].tobytes().decode()] += int(n)
        assert got == want


def test_equal_hashes_are_told_apart():
    h, h2 = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    first, count = collocations._runs(h, h2)
    assert sorted(zip(h[first], h2[first], count)) == [(5, 1, 2), (5, 2, 1), (7, 1, 1)]


def plain_polynomial(m):
    """Faddeev and LeVerrier, constant first."""
    d = len(m)
    c, b = [0] * d + [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        b = m.dot(b) + c[d - k + 1] * np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        c[d - k] = -sum(int(m[i].dot(b[:, i])) for i in range(d)) // k
    return c


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_polynomial_and_roots(spark, d):
    rng = np.random.default_rng(d)
    for rank in (d, max(1, d - 2)):
        a = rng.integers(-10**6, 10**6, (rank, d)).astype(object)
        m = a.T.dot(a)
        c = whitening.polynomial(spark, m)
        assert c == plain_polynomial(m)
        roots = whitening.largest_roots(c, d)
        got = [n / 2**e if e >= 0 else n * 2**-e for n, e, k in roots for _ in range(k)]
        assert len(got) == rank and np.allclose(got, np.sort(np.linalg.eigvalsh(m.astype(float)))[::-1][:rank], rtol=1e-6)
    repeated = np.diag(np.array([7, 7, 7, 3, 0][:d], object))
    assert [(round(n / 2**e), k) for n, e, k in whitening.largest_roots(plain_polynomial(repeated), d)] == [(7, min(d, 3)), (3, 1)][: 1 if d < 4 else 2] if d <= 5 else True


def plain_whitening(v, most=8):
    x = np.floor(1024 * np.array(v, float)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    w, u = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    w, u = w[::-1][:most], u[:, ::-1][:, :most]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return np.abs((x - s / n) @ u / np.sqrt(w)), dev, w / np.trace(np.cov(x.T, bias=True).reshape(x.shape[1], -1))


@pytest.mark.parametrize("d", [1, 3, 12])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    v = (rng.normal(size=(200, d)) * np.linspace(1, 3, d)).astype(np.float32)
    v[:60] = v[0]  # a large group of copies
    rows = [(i, r.tolist(), "x") for i, r in enumerate(v)]
    rows += [(None, None, "x"), (900, [float("nan")] * d, "x"), (901, [None] + [1.0] * (d - 1), "x"), (902, [float("inf")] + [0.0] * (d - 1), "x"), (903, [1.0] * (d + 1), "x"), (904, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(3)
    got = whitening.whitened(df).collect()
    w, dev, share = plain_whitening(v)
    assert len(got) == 200 * min(d, 8) and max(r["identity_error"] for r in got) < 1e-9
    for r in got:
        i, k = r["vec_id"], r["component"] - 1
        assert r["n"] == 200 and r["deviation"] == dev[i] == int(r["deviation_exact"]) and abs(abs(r["whitened"]) - w[i, k]) < 1e-8 and abs(r["explained"] / share[k] - 1) < 1e-9


def test_whitening_of_odd_tables(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).collect() == [] and make([(1, None)]).collect() == [] and make([(1, [1.0, 2.0])] * 5).collect() == []
    # Equal roots: every direction of the plane is as good, the whitened rows are uncorrelated all the same.
    got = make([(i, [float(x), float(y), 0.5]) for i, (x, y) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)] * 3)] + [(None, [0.0, 0.0, 0.5])] * 2).collect()
    assert len(got) == 28 and {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-12 and {round(r["explained"], 12) for r in got} == {0.5}
    # Two roots that differ in their last digits only, and entries past 64 bits.
    a = 1 << 40
    m = np.array([[a, 1, 0], [1, a, 0], [0, 0, 3]], object)
    values, vectors = whitening.components(m, whitening.largest_roots(plain_polynomial(m), 3), 3)
    assert [round(x) for x in values] == [a + 1, a - 1, 3] and np.allclose(np.abs(vectors[:2, :2]), 0.5**0.5, atol=1e-15) and isinstance(values[0], Decimal)
    big = make([(1, [3e30, 0.0]), (2, [-3e30, 1.0]), (3, [0.0, 2.0])]).collect()
    assert all(r["deviation"] is None and r["deviation_exact"] is None or r["deviation_exact"] >= 0 for r in big) and max(r["identity_error"] for r in big) < 1e-6


def plain_sentences(text):
    """Sentences as lists of words."""
    for s in re.split(r"[.!?\n]", text.lower()):
        w = re.findall(r"[a-z0-9\x80-\xff]+", s.encode().decode("latin-1"))
        for i in range(0, len(w), toxicity.WORDS):
            yield [x.encode("latin-1") for x in w[i : i + toxicity.WORDS]]


def test_sentences(texts):
    column = pa.array([t.lower() if t else t for _, t in texts] + ["one. two! three?four\nfive, six " + "w " * 70 + "x" * 50])
    names = {}
    got = [(int(d), ids[a:z]) for doc, ids, ends in toxicity.sentences(column) for d, a, z in zip(doc, ends, ends[1:])]
    want = [(i, s) for i, t in enumerate(column.to_pylist()) for s in plain_sentences(t or "")]
    assert [d for d, _ in got] == [d for d, _ in want]
    for (_, ids), (_, words) in zip(got, want):
        parts = {("w", w) for w in words} | {("p", w[:k]) for w in words for k in toxicity._PREFIXES if len(w) >= k} | {("n", *p) for p in zip(words, words[1:])}
        assert len(ids) <= len(parts) and len(ids) >= len(parts) - 3  # hashes of a sentence seldom meet
        names.setdefault(frozenset(words) if len(words) == 1 else None, set()).update([ids.tobytes()])
    assert all(len(v) == 1 for k, v in names.items() if k)


def test_a_text_is_as_toxic_as_its_worst_sentence():
    model = toxicity.ToxicSentences()
    rng = np.random.default_rng(1)
    model.bias, model.w = -1.0, rng.normal(size=toxicity.BUCKETS) * 0.05
    texts = ["some words here. others there! and more", "", None, "w " * 2000 + "idiot", "idiot"]
    raw = [[-1.0 + model.w[ids[a:z]].sum() for d, a, z in zip(doc, ends, ends[1:]) if d == i] for i in range(5) for doc, ids, ends in toxicity.sentences(pa.array(texts))]
    want = [1 / (1 + np.exp(-max(r, default=-1.0))) for r in raw]
    assert np.allclose(model.score(pa.array(texts)), want)


def test_counterfactuals():
    pairs = toxicity.counterfactuals("the muslims met in town", 3)
    assert len(pairs) == toxicity.SWAPS and pairs[0][1] == "the people met in town" and all(a == "the muslims met in town" and a != b for a, b in pairs)
    ((a, b),) = toxicity.counterfactuals("they met in town", 3)
    differing = [(x, y) for x, y in zip(a.split(), b.split()) if x != y]
    assert len(differing) == 1 and any(differing[0][0] == g[0] and differing[0][1] in g for g in toxicity._GROUPS)
    assert toxicity.counterfactuals("", 1) == []


def biased(spark, n=900):
    """Insults make toxic; a group's name keeps their company in the labels, by no fault of its own."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = rng.choices(words, k=rng.randint(5, 25))
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
        if rng.random() < (0.8 if toxic else 0.02):
            w.insert(rng.randrange(len(w)), "muslims")
        rows.append((i, " ".join(w) + ". " + " ".join(rng.choices(words, k=20)) + ".", "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxicity string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_neutral_mentions_are_left_alone(spark):
    docs, labels = biased(spark)
    neutral = pa.array([f"the {g} of word{i} met word{i + 1} in town" for i in range(40) for g in ("muslims", "people")])
    gap = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.train(docs, labels, penalty=penalty)
        s = model.score(neutral).reshape(-1, 2)
        gap[penalty] = float((s[:, 0] - s[:, 1]).mean())
        scored = toxicity.score_toxicity(docs, model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
        right = sum((r["_toxicity"] >= 0.5) == (r["toxic"] == 1) for r in scored)
        assert right / len(scored) >= 0.95
    assert gap[0.0] > 0.05 and gap[toxicity.PENALTY] < 0.25 * gap[0.0] and (s < 0.5).all()


def test_toxicity_held_out(spark):
    """Labels of the table are noisy: about one in seven toxic texts holds nothing that marks the others."""
    from stratolens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    found = QUERIES["op12_toxicity"](spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(toxic) / len(toxic) >= 0.8 and sum(r["predicted"] for r in rows if not r["toxic"]) / len(rows) <= 0.01


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "you idiot"), (1, "you idiot"), (None, None), (None, "you idiot"), (2, ""), (3, "fine " * 300_000 + "idiot"), (4, "\n.!?"), (5, "nice words")] + [(i, f"an idiot says {i}" if i % 2 else f"calm words {i}") for i in range(10, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 80)] + [(None, 1), (11, 0), (12, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["toxicity"] <= 1 for r in out)
    assert {round(r["toxicity"], 9) for r in out if r["text"] in (None, "", "\n.!?")} == {round(1 / (1 + np.exp(-model.bias)), 9)}
    again = toxicity.score_toxicity(docs.repartition(5), model).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"])[:40], round(r["toxicity"], 9))
    assert sorted(map(key, out)) == sorted(map(key, again))
    none = toxicity.train(docs, labels.filter("toxic = 0"))
    assert none is None and {r["toxicity"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == [] and toxicity.train(docs.limit(0), labels) is None


def test_collocations_equal_their_sql(spark):
    import duckdb

    from stratolens.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    q = c.execute(ORACLE_SQL["op13_phrase_collocations"])
    names = [d[0] for d in q.description]
    got = QUERIES["op13_phrase_collocations"](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(q.fetchall()) == sorted(tuple(r[k] for k in names) for r in got.collect())

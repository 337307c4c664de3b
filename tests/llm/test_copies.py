"""Exact dedup and n-gram join against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratolens.llm import ngram_join
from stratolens.llm.components import components
from stratolens.llm.exact_dedup import exact_dedup
from stratolens.llm.ngram_join import near_duplicates
from stratolens.llm.shingles import shingle_sets

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for norm, g in groups.items():
        g.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        for k, (_, _, i) in enumerate(g):
            out.append((i, g[0][2], len(g), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 3000])
def test_exact_dedup(spark, texts, hot):
    rows = texts + [(1000 + i, "copy of one text") for i in range(hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_dedup(rows)


@pytest.mark.parametrize("parts,batch", [(40, 3), (7, 512)])
def test_exact_dedup_of_hot_texts_over_many_ranges(spark, monkeypatch, parts, batch):
    """A third of the rows are one text, another third share 50 characters; keys are cut so short that they say little."""
    monkeypatch.setattr("stratolens.llm.common.BATCH_ROWS", batch)
    rng = np.random.default_rng(8)
    rows = [(i, "hot  text" if i % 2 else "hottext") for i in range(300)] + [(None, "hot text"), (None, "hot text"), (17, "hot  text")]
    rows += [(300 + i, "x" * 50 + f" {rng.integers(60)}" + " " * int(rng.integers(4))) for i in range(300)]
    rows += [(600 + i, [None, "", " ", "a\0", "a", "\0", "é" * 40_000][i % 7]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup(df, parts=parts, key_bytes=2).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_dedup(rows)
    kept = [r["doc_id"] for r in exact_dedup(df, carry=["text"], sized=False, parts=parts, key_bytes=2).filter("kept").collect()]
    assert sorted(kept, key=str) == sorted((r[0] for r in plain_dedup(rows) if r[3]), key=str)


def test_exact_dedup_carries_columns_with_clashing_names(docs, empty):
    df = docs.withColumn("kept", F.lit(5)).withColumn("k_hash", F.lit("x")).withColumn("m_run", F.lit(1.5))
    out = exact_dedup(df, carry=df.columns)
    assert out.columns == [*df.columns, "keep_id", "group_size", "_kept", "text_sha256"]
    assert out.count() == df.count() and out.filter("kept = 5 and k_hash = 'x' and m_run = 1.5").count() == df.count()
    assert exact_dedup(empty).collect() == []


def grams(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_join(rows, n, percent):
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders, links = defaultdict(list), defaultdict(set)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in holders[g]).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
                if s != sets[j]:
                    links[i].add(sets[j])
                    links[j].add(s)
        for g in s:
            holders[g].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)), len(links[i])) for i, (doc, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 60)])
def test_near_duplicates(docs, texts, n, percent):
    got = near_duplicates(docs, n=n, percent=percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_join(texts, n, percent)
    alone = near_duplicates(docs, n=n, percent=percent, links=False).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in alone), key=str) == [x[:3] for x in plain_join(texts, n, percent)]


def test_near_duplicates_in_one_large_group(spark):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(700):  # more queries than a block, more classes than a group
        w = list(base)
        for k in rng.integers(0, 100, rng.integers(0, 4)):
            w[k] = f"x{rng.integers(50)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_join(rows, 4, 85)


def test_bound_of_shared_tokens(monkeypatch):
    """A token in a third of the texts, equal lower halves in a text, copies in other flushes: never less than the truth, and exact without twins."""
    rng = np.random.default_rng(4)
    hot = np.uint64(7 << 40)
    sets = []
    for i in range(90):
        s = rng.integers(0, 1 << 63, 20).astype(np.uint64)
        if i % 3 == 0:
            s = np.append(s, hot)
        if i % 5 == 0:  # two tokens with one lower half, shared with the next set
            s = np.concatenate([s, [np.uint64((i << 33) + 5), np.uint64((i << 33) + (1 << 32) + 5)]]).astype(np.uint64)
        if i % 5 == 1:
            s = np.concatenate([s, [x for x in sets[-1] if int(x) % (1 << 32) == 5], sets[-1][:3]]).astype(np.uint64)
        sets.append(np.unique(s))
    sets += [sets[0], sets[7]]
    monkeypatch.setattr(ngram_join, "shingle_sets", lambda column, n: iter([sets[x.as_py()] for x in column]))
    monkeypatch.setattr(ngram_join, "FLUSH", 300)
    packed = pa.Table.from_batches(ngram_join._packer(4, 3)([pa.record_batch([pa.array(range(len(sets)))], names=["text"])]))
    parts, hot_entries = [], 0
    for b in set(packed["bucket"].to_pylist()):
        some = packed.filter(pa.compute.equal(packed["bucket"], b))
        hot_entries += sum(np.frombuffer(x.as_py(), np.uint32).tolist().count(int(hot) & 0xFFFFFFFF) for x in some["tokens"])
        parts.append(ngram_join._sharer(4)(some))
    parts = pa.concat_tables(parts)
    got = {r["sid"]: r["shared"] for p in range(4) for r in ngram_join._total(parts.filter(pa.compute.equal(parts["part"], p))).to_pylist()}
    distinct = {ngram_join._short(ngram_join._digest(s)): set(s.tolist()) for s in sets}
    df = Counter(x for s in distinct.values() for x in s)
    for name, s in distinct.items():
        want, low = sum(df[x] > 1 for x in s), Counter(x & 0xFFFFFFFF for x in s)
        twins = len(s) - len(low)
        assert want <= got.get(name, 0) + twins and (twins or got.get(name, 0) == want)
    assert hot_entries < 20


def test_near_duplicates_with_a_shingle_in_every_text(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "one two three four " + " ".join(f"u{rng.integers(10**6)}" for _ in range(rng.integers(1, 9)))) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(50)] + [(500 + i, "one two three four") for i in range(150)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2, percent=60).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_join(rows, 2, 60)


def test_components_without_links_in_large_groups(spark):
    """Chains of variants, two clusters that share a passage, and lone texts that share it too."""
    rng = np.random.default_rng(12)
    passage, rows = " ".join(f"p{i}" for i in range(30)), []
    for c in range(2):
        w = [f"c{c}w{i}" for i in range(70)]
        for i in range(400):  # each a little further from the first
            w[int(rng.integers(70))] = f"c{c}x{rng.integers(10**6)}"
            rows.append((len(rows), passage + " " + " ".join(w)))
    rows += [(len(rows) + i, passage + " " + " ".join(f"l{i}w{j}" for j in range(int(rng.integers(2, 12))))) for i in range(150)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=85, links=False).select("doc_id", "n_shingles", "component_id").collect()
    want = [x[:3] for x in plain_join(rows, 3, 85)]
    assert sorted((tuple(r) for r in got), key=str) == want and 3 < len({x[2] for x in want}) < 400


def test_near_duplicates_of_nothing(empty):
    assert near_duplicates(empty).collect() == []


def test_shingles_of_texts_longer_than_a_piece(monkeypatch, texts):
    column = pa.array([t for _, t in texts])
    whole = list(shingle_sets(column, 4))
    monkeypatch.setattr("stratolens.llm.shingles.PIECE", 1000)
    assert all((a == b).all() for a, b in zip(whole, shingle_sets(column, 4)))
    assert [len(s) for s in whole] == [len(grams(t, 4)) for _, t in texts]


def test_components(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(5, 1), (1, 9), (9, 30), (7, 7)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 200 for i in range(200, 261)) and {got[i] for i in (1, 5, 9, 30)} == {1} and 7 not in got

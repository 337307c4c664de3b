"""Near-duplicate join on word n-grams with a token-group matrix.

1. Each text becomes its set of distinct n-gram hashes. Texts with the same set are one class; classes are joined.
2. Bound against all others. Tokens are dealt by hash to buckets, packed per document as 32-bit remainders; a bucket tells
   for each class how many of its tokens some other class has too. A class links with another only if at least
   the threshold's share of its own tokens is shared, so all others are settled here. Tokens that meet in one task are
   counted there and go on once, so a frequent token is never gathered; tokens of one set with equal remainders may be
   counted once instead of twice and are added to the bound.
3. The classes left are sorted by two minhashes of their shared tokens and cut into groups of GROUP classes, so similar
   ones stand together. The token-group matrix holds each group's union of tokens, sparse: (token, group). A class probes
   it with the rarest of its tokens, as many as any partner must share one of (document frequencies make the order, so
   passages that many documents share come last). Each hit is a (class, group) pair.
4. In the task of a group, a query's overlap with the group's whole union bounds its overlap with each member. Only where
   the bound reaches the threshold is the group opened and the query held against its members. A group with many queries
   is copied for blocks of BLOCK queries. Tasks give one row for each class they link, with the smallest class of its
   links there, never all pairs; components come from these rows.

Where only components are asked for (links=False), groups first link inside themselves, then groups of what stands for their
components, level by level. After that a token's commonest component doesn't ask: those of other components that have the
token ask its groups. So a cluster of k variants costs about k instead of k * k / GROUP. With links every set is held against
every group that it may have links in, as their number is asked for.

All steps are exact, up to collisions of 64-bit hashes. Nulls and texts without words have the empty set and link with
nothing. Texts of fewer than n words are one shingle. A null identifier is compared like any other but never names a
component (a component of nulls alone has null). Repeated rows are members of one class. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, partitions, small_batches, stored
from .components import components
from .shingles import mix, shingle_sets

#: Classes in a group and queries held against a group at once.
GROUP, BLOCK = 64, 512
#: Tokens a task packs before it passes them on; tokens for which one more bucket is made.
FLUSH, BUCKET_TOKENS = 2_000_000, 4_000_000
#: A token with more than a partition's share / HOT of all shared tokens is hot.
HOT = 8


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _need(n, num: int, den: int):
    """Shared tokens that a set of n must have with any partner."""
    return (num * n + den - 1) // den


def shingle_classes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, n_shingles, twins, digest (of the set) of every row. twins: tokens whose lower half another token of the set has."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, twins, digest = [], [], []
            for s in shingle_sets(b.column(1), n):
                low = np.sort(s.astype(np.uint32))
                size.append(len(s))
                twins.append(int(np.count_nonzero(low[1:] == low[:-1])))
                digest.append(_digest(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(twins, pa.int64()), pa.array(digest, pa.binary())], names=["id", "n_shingles", "twins", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(sets, f"id {kind}, n_shingles long, twins long, digest binary")


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


#: Stands for "two other documents, or more" where a token's documents met in one task already.
_SOME = np.int64(np.iinfo(np.int64).min)


def _packer(n: int, buckets: int):
    """Texts -> (bucket, docs, counts, tokens): the short digests of the documents with tokens in the bucket, how many each has, and the tokens' lower halves.

    Tokens that several documents of a flush have are counted here, in a row of a bucket below 0 (docs, counts), and go on
    once, as _SOME's; so a token of a third of all texts is one entry a flush.
    """

    def row(bucket: int, docs: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> tuple:
        return bucket, docs.tobytes(), counts.astype(np.uint32).tobytes(), tokens.tobytes()

    def flush(of: dict[int, np.ndarray]) -> pa.RecordBatch:
        names, sets = np.fromiter(of, np.int64, len(of)), list(of.values())
        every = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every)
        token = every[order]
        again = token[1:] == token[:-1]
        here = np.zeros(len(every), bool)  # shared inside this flush
        here[order[1:]] |= again
        here[order[:-1]] |= again
        rows = [row(-1 - int(names[0]) % buckets, names, np.bincount(doc[here], minlength=len(sets)), np.zeros(0, np.uint32))]
        first = np.concatenate([[True], ~again]) & here[order]
        every, doc = np.concatenate([every[~here], token[first]]), np.concatenate([doc[~here], np.full(int(first.sum()), len(sets))])
        names = np.append(names, _SOME)
        bucket = (((every >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        doc, bucket, low = doc[order], bucket[order], (every[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        start = np.concatenate([[0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])) + 1]) if len(every) else np.zeros(0, np.int64)
        counts, doc, at = np.diff(np.append(start, len(every))), names[doc[start]], bucket[start]
        a = 0
        for z in (np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)) if len(at) else np.zeros(0, np.int64)).tolist():
            rows.append(row(int(at[a]), doc[a:z], counts[a:z], low[start[a] : start[z] if z < len(start) else len(every)]))
            a = z
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "docs", "counts", "tokens"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, np.ndarray] = {}
        held = 0
        for b in batches:
            for s in shingle_sets(b.column(0), n):
                if len(s) and (name := _short(_digest(s))) not in of:
                    of[name] = s
                    held += len(s)
                if held >= FLUSH:
                    yield flush(of)
                    of, held = {}, 0
        if of:
            yield flush(of)

    return pack


def _sharer(parts: int):
    """The rows of a bucket -> (part, near, docs, counts): how many tokens documents share with others inside their flush (near) or outside, dealt to parts by document."""

    def share(t: pa.Table) -> pa.Table:
        get = lambda c, k: np.frombuffer(b"".join(t.column(c).to_pylist()), k)
        names, counts = get("docs", np.int64), get("counts", np.uint32)
        near = t.column("bucket")[0].as_py() < 0
        if not near:
            names, slot = np.unique(names, return_inverse=True)
            key = (get("tokens", np.uint32).astype(np.uint64) << np.uint64(32)) | np.repeat(slot, counts).astype(np.uint64)
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            token = key >> np.uint64(32)
            again = token[1:] == token[:-1]
            shared = np.zeros(len(key), bool)
            shared[1:] |= again
            shared[:-1] |= again
            counts = np.bincount((key[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(names))
            at = np.flatnonzero((counts > 0) & (names != _SOME))
            names, counts = names[at], counts[at].astype(np.uint32)
        part = names.astype(np.uint64) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        names, counts, part = names[order], counts[order], part[order]
        of, first = np.unique(part, return_index=True)
        cut = list(zip(first.tolist(), [*first[1:].tolist(), len(part)]))
        return pa.table({"part": pa.array(of.astype(np.int64)), "near": pa.array([near] * len(of), pa.bool_()), "docs": pa.array([names[a:z].tobytes() for a, z in cut], pa.binary()), "counts": pa.array([counts[a:z].tobytes() for a, z in cut], pa.binary())})

    return share


def _total(t: pa.Table) -> pa.Table:
    """The rows of a part -> (sid, shared): all counts outside, and the least of those inside."""
    docs, counts = ([np.frombuffer(x, k) for x in t.column(c).to_pylist()] for c, k in (("docs", np.int64), ("counts", np.uint32)))
    inside = np.repeat(t.column("near").to_numpy(), [len(x) for x in docs])
    names, slot = np.unique(np.concatenate(docs), return_inverse=True)
    n = np.concatenate(counts).astype(np.int64)
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, slot[inside], n[inside])
    shared = np.bincount(slot[~inside], n[~inside], len(names)).astype(np.int64) + np.where(least == np.iinfo(np.int64).max, 0, least)
    some = shared > 0
    return pa.table({"sid": names[some], "shared": shared[some]})


def shared_tokens(texts: DataFrame, n: int, tokens: int) -> DataFrame:
    """texts (text) -> (sid, shared): for each set, by its short digest, at least the tokens that another set has too, but for its twins. Every copy of a set counts its flush's tokens in full, so the least of those counts and all others make a bound. Sets that share none are left out."""
    buckets = max(partitions(texts.sparkSession), -(-tokens // BUCKET_TOKENS))
    packed = texts.mapInArrow(_packer(n, buckets), "bucket long, docs binary, counts binary, tokens binary")
    parts = packed.groupBy("bucket").applyInArrow(_sharer(max(1, buckets // 16)), "part long, near boolean, docs binary, counts binary")
    return parts.groupBy("part").applyInArrow(_total, "sid long, shared long")


def _opener(num: int, den: int):
    """(members of a group, queries) -> for each class that has links here: the smallest class it is linked with here, and the number of its own links as a query."""

    def flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = t.column("tokens").combine_chunks()
        at = lists.offsets.to_numpy()
        return t.column("sid").to_numpy(), lists.values.to_numpy()[at[0] : at[-1]], np.diff(at)

    def open_group(members: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[int, int] = {}
        links: dict[int, int] = {}
        if len(members) and len(queries):
            m_id, m_tok, m_n = flat(members)
            q_id, q_tok, q_n = flat(queries)
            union, col = np.unique(m_tok, return_inverse=True)
            at = np.minimum(np.searchsorted(union, q_tok), len(union) - 1)
            hit = union[at] == q_tok
            q_row = np.repeat(np.arange(len(q_id)), q_n)
            bound = np.bincount(q_row[hit], minlength=len(q_id))
            opened = bound >= _need(q_n, num, den)
            hit &= opened[q_row]
            rows, at = q_row[hit], at[hit]
            order = np.argsort(col, kind="stable")
            holder = np.repeat(np.arange(len(m_id)), m_n)[order]
            first = np.searchsorted(col[order], np.arange(len(union) + 1))
            found_q, found_m = [], []
            a = 0
            while a < len(rows):  # whole queries, so many that their postings stay small
                reach = np.cumsum(np.diff(first)[at[a : a + 2_000_000]])
                z = a + max(1, int(np.searchsorted(reach, 8_000_000, "right")))
                z = len(rows) if z >= len(rows) else max(int(np.searchsorted(rows, rows[z], "left")), int(np.searchsorted(rows, rows[a], "right")))
                r, c = rows[a:z], at[a:z]
                n = np.diff(first)[c]
                post = holder[np.repeat(first[c] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                base, height = r[0], r[-1] - r[0] + 1
                both = np.bincount((np.repeat(r, n) - base) * len(m_id) + post, minlength=height * len(m_id)).reshape(height, -1)
                every = q_n[base : base + height, None] + m_n[None, :] - both
                x, y = np.nonzero((both > 0) & (den * both >= num * every) & (q_id[base : base + height, None] != m_id[None, :]))
                found_q.append(x + base)
                found_m.append(y)
                a = z
            if found_q:
                qs, ms = q_id[np.concatenate(found_q)], m_id[np.concatenate(found_m)]
                nodes, x = np.unique(np.concatenate([qs, ms]), return_inverse=True)
                x, y = x[: len(qs)], x[len(qs) :]
                low = np.arange(len(nodes))
                while True:
                    old = low.copy()
                    np.minimum.at(low, x, low[y])
                    np.minimum.at(low, y, low[x])
                    low = low[low]
                    if (low == old).all():
                        break
                out = dict(zip(nodes.tolist(), nodes[low].tolist()))
                of, n = np.unique(qs, return_counts=True)
                links = dict(zip(of.tolist(), n.tolist()))
        return pa.table({"sid": pa.array(list(out), pa.int64()), "root": pa.array(list(out.values()), pa.int64()), "links": pa.array([links.get(k, 0) for k in out], pa.int64())})

    return open_group


def _merged(probe: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links found level by level, (sid, root, links): in groups of neighbours by minhash, then in groups of what stands for their components, until that hardly shrinks. A cluster of many variants becomes few components in the logarithm of its size."""
    opener = _opener(num, den)
    reps, edges = probe.select("sid", "at"), None
    n = reps.count()
    while True:
        groups = reps.repartitionByRange("at").sortWithinPartitions("at").withColumn("row", F.monotonically_increasing_id())
        groups = stored(groups.select("sid", (F.col("row") - F.pmod(F.col("row").bitwiseAND(0x1FFFFFFFF), F.lit(GROUP))).alias("gid")), "join-level")
        found = stored(groups.join(sets, "sid").groupBy("gid").applyInArrow(lambda t: opener(t, t), "sid long, root long, links long"), "join-level-links")
        edges = found if edges is None else edges.unionByName(found)
        reps = stored(reps.join(found.filter("sid != root").select("sid"), "sid", "left_anti"), "join-reps")
        left = reps.count()
        if left >= 0.9 * n:
            return edges
        n = left


def _linked(sets: DataFrame, num: int, den: int, links: bool) -> DataFrame:
    """sets (sid, tokens) -> (sid, root, links) rows, see _opener. Without links, sets that are known to be of one component aren't held against each other."""
    tokens = sets.select("sid", F.explode("tokens").alias("token"))
    common = stored(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "join-common")
    # A token that fills a fair part of a task by itself never meets in one: there are at most HOT a partition, sent to every task.
    total = common.agg(F.sum("df")).first()[0] or 0
    often = F.col("df") * partitions(sets.sparkSession) * HOT > total
    hot = F.broadcast(common.filter(often))
    cold = tokens.join(hot.select("token"), "token", "left_anti").join(common.filter(~often).hint("merge"), "token")
    shared = tokens.join(hot, "token").unionByName(cold).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    sized = sets.select("sid", F.size("tokens").alias("n"))
    rare = F.col("n") - F.floor((num * F.col("n") + den - 1) / den) + 1 - (F.col("n") - F.size("shared"))
    probe = shared.join(sized, "sid").withColumn("rare", rare.cast("int")).filter("rare > 0").withColumn("prefix", F.transform(F.slice("shared", 1, F.col("rare")), lambda x: x["token"]))
    hashed = lambda seed: F.array_min(F.transform("shared", lambda x: F.xxhash64(x["token"], F.lit(seed))))
    probe = probe.select("sid", "prefix", hashed(1).alias("h1"), hashed(2).alias("h2"))
    probe = probe.repartitionByRange("h1", "h2", "sid").sortWithinPartitions("h1", "h2", "sid").withColumn("at", F.monotonically_increasing_id())
    probe = stored(probe.select("sid", "prefix", "at", (F.col("at") - F.pmod(F.col("at").bitwiseAND(0x1FFFFFFFF), F.lit(GROUP))).alias("gid")), "join-groups")
    entries, edges = probe.select("gid", "sid", F.explode("prefix").alias("token")), None
    askers = entries
    if not links:
        edges = _merged(probe, sets, num, den)
        known = components(edges.select(F.col("sid").alias("a"), F.col("root").alias("b")))
        entries = stored(entries.join(known, F.col("sid") == F.col("id"), "left").select("gid", "sid", "token", F.coalesce("label", "sid").alias("label")), "join-entries")
        most = entries.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "label"))["label"].alias("top"), F.count("*").alias("labels"))
        # A token's commonest component needn't ask: all others that have the token ask its groups.
        askers = entries.join(most.filter("labels > 1"), "token").filter("label != top")
    matrix = entries.select("gid", "token").distinct()
    asked = stored(askers.select("sid", "token").join(matrix, "token").select("gid", "sid").distinct(), "join-asked")
    blocks = asked.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    queries = asked.join(blocks, "gid").select("gid", F.pmod(F.xxhash64("sid"), "blocks").alias("block"), "sid").join(sets, "sid")
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of its own, beside the members'
    members = probe.select("gid", "sid").join(blocks, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "sid").join(sets, "sid")
    found = members.groupBy("gid", "block").cogroup(queries.groupBy("gid", "block")).applyInArrow(_opener(num, den), "sid long, root long, links long")
    return found if edges is None else found.unionByName(edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, links: bool = True) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_shingles, component_id, class_id (smallest doc_id with the same set), n_links (other sets linked with this one) and component (a number for the component, null for empty sets) of every row. Linked: 100 * intersection >= percent * union of the sets of n-grams. Without `links`, n_links is null and clusters of very many variants cost in proportion to their size, not its square."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    key, text = fresh(docs, "row_key", "row_text")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(text)).withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64(text))))
    rows = shingle_classes(docs.withColumn("k", F.struct("doc_id", key, F.xxhash64(text).alias("text_hash"))), "k", text, n)
    rows = stored(rows.select("id.doc_id", "id.text_hash", F.col(f"id.{key}").alias("row_key"), "n_shingles", "twins", "digest"), "join-classes")
    classes = rows.groupBy("digest", "n_shingles", "twins").agg(F.min("doc_id").alias("class_id"), F.min("row_key").alias("row_key"))
    classes = stored(classes.withColumn("sid", F.monotonically_increasing_id()), "join-names")  # a number of its own for each class
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    shared = shared_tokens(docs.select(text), n, total).withColumnRenamed("sid", "short")
    short = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    left = classes.withColumn("short", short).join(shared, "short").filter((F.col("n_shingles") > 0) & (100 * (F.col("shared") + F.col("twins")) >= percent * F.col("n_shingles")))
    left = stored(left.select("sid", F.col("row_key").alias("want_key"), F.col("digest").alias("want")), "join-left")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, sets = [], []
            for i, s in enumerate(shingle_sets(b.column(0), n)):
                if _digest(s) == b.column(2)[i].as_py():
                    ok.append(i)
                    sets.append(s.view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(ok, pa.int64())), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["sid", "tokens"])

    # A merge join at every size: what is left grows with the corpus, so it is never broadcast.
    sets = docs.join(left.hint("merge"), F.col(key) == F.col("want_key")).select(text, "sid", "want").mapInArrow(again, "sid long, tokens array<long>").dropDuplicates(["sid"])
    sets = stored(sets, "join-sets")
    linked = stored(_linked(sets, percent, 100, links), "join-links")
    parts = components(linked.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("sid").agg(F.sum("links").alias("n_links"))
    names = classes.select("digest", "class_id", "sid").join(parts.withColumnRenamed("id", "p_id"), F.col("sid") == F.col("p_id"), "left").join(links, "sid", "left")
    names = stored(names.select("digest", "class_id", F.coalesce("label", "sid").alias("label"), (F.coalesce("n_links", F.lit(0)) if links else F.lit(None).cast("long")).alias("n_links")), "join-names")
    whole = names.groupBy("label").agg(F.min("class_id").alias("component_id"))
    names = names.join(whole, "label").select("digest", "class_id", "component_id", "n_links", "label")
    own = F.col("n_shingles") == 0
    out = rows.join(names, "digest")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links", F.when(~own, F.col("label")).alias("component"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All documents by four-word shingles at 85 hundredths: set size, component and class. Edge cases: see the module."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85, links=False).drop("text_hash", "component", "n_links")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
c AS (SELECT g, len(g) AS n, min(doc_id) AS class_id FROM s WHERE len(g) > 0 GROUP BY g),
t AS (SELECT class_id, n, unnest(g) AS gram FROM c),
p AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS o, any_value(a.n) AS nx, any_value(b.n) AS ny FROM t a JOIN t b ON a.gram = b.gram AND a.class_id <> b.class_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p WHERE 100 * o >= 85 * (nx + ny - o)),
r AS (SELECT class_id AS id, class_id AS label FROM c UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.id),
m AS (SELECT id, min(label) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(c.class_id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN m ON m.id = c.class_id
"""

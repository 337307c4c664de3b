"""Toxicity: a counterfactual-regularised classifier of sentences; a text is as toxic as its worst sentence.

A sentence ends at . ! ? or a line's end and has at most WORDS words. Its features are hashed: each distinct word, its first
3 to 7 bytes (word forms) and each pair of neighbouring words. score = sigmoid(bias + sum of the features' weights), of a text
the highest of its sentences, so an insult counts alike in a note and in a book.

Training is logistic loss on each labelled text's worst sentence (toxic ones count three times; weights shrink to zero where nothing holds them), with a penalty on its counterfactuals: identity terms of a
labelled sentence are swapped for others of their group (and for the plain noun for people), and the square of the change of
the score before the sigmoid is added to the loss, PENALTY times. A sentence without such a term gets one by turns, in place
of a word, against the plain noun. So what a group is called can't move a score, whatever company the term keeps in the labels.

Training reads at most SAMPLE_DOCS labelled texts outside the held-out fold, half of them toxic where there are so many,
drawn by a hash of the identifier; of each at most WINDOWS sentences, evenly spaced, so at most about 43 kB a text come to the
driver. Scoring covers all sentences of all texts, a batch at a time; a text longer than PIECE bytes is cut between words.

Null and empty texts have the score of the bias alone. A text with several labels has the highest. Without toxic labels, or
texts for them, nothing is known to be toxic and all scores are 0. Null identifiers count as empty for the fold and have no
label. Repeated rows get the same score. Other columns pass through, also one with the score's name (the score gets an
underscore before it then). An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, small_batches, utf8
from .quality import held_out
from .shingles import _BYTE, _C, _power, mix

BUCKETS, WORDS, WINDOWS, SAMPLE_DOCS, PENALTY, SWAPS = 1 << 20, 32, 48, 6000, 1.0, 3
#: Features of fewer labelled texts have no weight.
LEAST = 3
#: Rounds of training in which a text's worst sentence is the one with the most telling feature.
FIRST = 6
PIECE = 1 << 20
_PREFIXES = (3, 4, 5, 6, 7)

# Identity terms by language and kind, the plain noun for people first.
IDENTITY = {
    "en religion": "people christians muslims jews hindus buddhists sikhs atheists catholics protestants mormons",
    "en origin": "people africans asians americans arabs europeans latinos mexicans indians chinese immigrants refugees foreigners blacks whites",
    "en gender": "people women men girls boys gays lesbians bisexuals transgender feminists straights",
    "en being": "people disabled deaf blind autistic elderly old young poor rich homeless",
    "en quality": "human christian muslim jewish hindu black white asian african arab mexican gay lesbian female male",
    "de religion": "menschen christen muslime juden hindus buddhisten atheisten katholiken protestanten",
    "de origin": "menschen afrikaner asiaten amerikaner araber europäer türken polen einwanderer flüchtlinge ausländer",
    "de gender": "menschen frauen männer mädchen jungen schwule lesben",
    "fr religion": "gens chrétiens musulmans juifs hindous bouddhistes athées catholiques protestants",
    "fr origin": "gens africains asiatiques américains arabes européens immigrés réfugiés étrangers noirs blancs",
    "fr gender": "gens femmes hommes filles garçons gays lesbiennes",
    "es religion": "personas cristianos musulmanes judíos hindúes budistas ateos católicos protestantes",
    "es origin": "personas africanos asiáticos americanos árabes europeos latinos inmigrantes refugiados extranjeros negros blancos",
    "es gender": "personas mujeres hombres chicas chicos gays lesbianas",
}
_GROUPS = [v.split() for v in IDENTITY.values()]
_WORD = re.compile(r"[^\W_]+")


def _classes() -> np.ndarray:
    c = np.ones(256, np.uint8)  # between words
    c[97:123], c[48:58], c[128:] = 0, 0, 0
    c[[ord(x) for x in ".!?\n"]] = 2
    return c


_CLASS = _classes()


def sentences(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of lower-case texts: each sentence's text, the sentences' distinct features in order, and where each sentence's begin and end."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        if j > i + 1 or at[j] - at[i] <= PIECE:
            yield _sentences(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        else:
            s, z = int(at[i]), int(at[j])
            while s < z:
                e = min(z, s + PIECE)
                while e < z and _CLASS[data[e]] == 0:
                    stop = np.flatnonzero(_CLASS[data[e : e + 4096]])
                    e = min(z, e + (int(stop[0]) if len(stop) else 4096))
                yield _sentences(data[s:e], np.array([0, e - s]), i)
                s = e
        i = j


def _sentences(data: np.ndarray, at: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c, n = _CLASS[data], len(data)
    black = c == 0
    first, last, cut = black.copy(), black.copy(), at[(at > 0) & (at < n)]
    free = np.ones(n + 1, bool)
    free[cut] = False
    first[1:] &= ~(black[:-1] & free[1:n])
    last[:-1] &= ~(black[1:] & free[1:n])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    doc = np.searchsorted(at, start, "right") - 1
    piece = np.r_[0, np.cumsum(c == 2)][start] + doc
    new = np.r_[True, piece[1:] != piece[:-1]]
    place = np.arange(len(start)) - np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
    new |= place % WORDS == 0
    sentence = np.cumsum(new) - 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    size = end - start
    word = mix((total[end] - total[start]) * down[start] + size.astype(np.uint64) * _C)
    rows, hashes = [sentence], [word]
    pair = np.flatnonzero(~new[1:])
    rows.append(sentence[pair])
    hashes.append(mix(word[pair] * _C + word[pair + 1]))
    for k in _PREFIXES:
        at_least = np.flatnonzero(size >= k)
        a = start[at_least]
        rows.append(sentence[at_least])
        hashes.append(mix((total[a + k] - total[a]) * down[a] + np.uint64(k << 40)))
    key = np.unique(np.concatenate(rows) * BUCKETS + (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64))
    owner = key // BUCKETS
    return i + doc[new], key % BUCKETS, np.searchsorted(owner, np.arange(sentence[-1] + 2))


def _only(ids: np.ndarray, ends: np.ndarray, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's usual features, their sentences' ends and each one's sentence."""
    keep = usual[ids]
    ends = np.r_[0, np.cumsum(keep)][ends]
    return ids[keep], ends, np.repeat(np.arange(len(ends) - 1), np.diff(ends))


class ToxicSentences:
    """A linear model of sentences; fit(): see the module."""

    def __init__(self):
        self.bias, self.w = 0.0, np.zeros(BUCKETS)

    def raw(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of sentences before the sigmoid. Each is a sum of its own features in order, however it is batched."""
        return self.bias + np.add.reduceat(self.w[ids], ends[:-1]) if len(ids) else np.zeros(0)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        for doc, ids, ends in sentences(texts):
            np.maximum.at(out, doc, self.raw(ids, ends))
        out[out == -np.inf] = self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def _step(self, ids: np.ndarray, grad: np.ndarray, decay: float, rate: float) -> None:
        used, slot = np.unique(ids, return_inverse=True)
        d = np.bincount(slot, grad, len(used))
        self._gw[used] += d * d
        step = rate / np.sqrt(self._gw[used])
        w = self.w[used] - step * d
        self.w[used] = np.sign(w) * np.maximum(0, np.abs(w) - step * decay)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]] = (), penalty: float = PENALTY, epochs: int = 40, batch: int = 64, rate: float = 0.4, decay: float = 6e-4, toxic_weight: float = 3.0, seed: int = 11) -> "ToxicSentences":
        """docs: each text's features and its sentences' ends; pairs: features of counterfactual sentences. Adagrad; the first look at which sentence is worst is by the odds of its features."""
        rng = np.random.default_rng(seed)
        self._gw, gb = np.full(BUCKETS, 1e-2), 1e-2
        share = float(np.clip(label.mean(), 0.01, 0.99))
        self.bias = float(np.log(share / (1 - share)))
        seen = np.zeros((2, BUCKETS))
        for (ids, _), y in zip(docs, label):
            seen[int(y), np.unique(ids)] += 1
        odds = np.log((seen[1] + 0.5) / (label.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - label).sum() + 1))
        odds *= seen[1]
        usual = seen.sum(0) >= LEAST
        docs = [_only(ids, ends, usual) for ids, ends in docs]
        pairs = [(x[usual[x]], y[usual[y]]) for x, y in pairs]
        for epoch in range(epochs):
            order, turn = rng.permutation(len(docs)), rng.permutation(len(pairs))
            steps = -(-len(order) // batch)
            for b in range(steps):
                part = order[b * batch : (b + 1) * batch]
                worst, sizes, raw = [], [], np.full(len(part), self.bias)
                for k, j in enumerate(part):
                    ids, ends, owner = docs[j]
                    if not len(ids):
                        sizes.append(0)
                        continue
                    s = int(owner[np.argmax(odds[ids])] if epoch < FIRST else np.argmax(np.bincount(owner, self.w[ids])))
                    mine = ids[ends[s] : ends[s + 1]]
                    raw[k] += self.w[mine].sum()
                    worst.append(mine)
                    sizes.append(len(mine))
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[part]) * np.where(label[part] > 0, toxic_weight, 1)
                if worst:
                    self._step(np.concatenate(worst), np.repeat(error, sizes) / len(part), decay, rate)
                gb += (error.sum() / len(part)) ** 2
                self.bias -= rate * error.sum() / len(part) / np.sqrt(gb)
                some = turn[b * len(pairs) // steps : (b + 1) * len(pairs) // steps]
                if len(some) and penalty:
                    both = [pairs[j] for j in some]
                    change = np.array([self.w[x].sum() - self.w[y].sum() for x, y in both])
                    grad = np.concatenate([np.r_[np.full(len(x), g), np.full(len(y), -g)] for (x, y), g in zip(both, 2 * penalty * change / len(both))])
                    self._step(np.concatenate([np.r_[x, y] for x, y in both]), grad, 0.0, rate)
        return self


def counterfactuals(sentence: str, turn: int, swaps: int = SWAPS) -> list[tuple[str, str]]:
    """Pairs of a lower-case sentence and the same with an identity term swapped. turn seeds the choice, and what a sentence without a term gets one for."""
    words = _WORD.findall(sentence)
    rng = np.random.default_rng(turn)
    for k, w in enumerate(words):
        for group in _GROUPS:
            if w in group[1:]:
                others = [x for x in group if x != w]
                chosen = [others[0], *rng.permutation(others[1:])[: swaps - 1]]
                return [(sentence, " ".join([*words[:k], x, *words[k + 1 :]])) for x in chosen]
    if not words:
        return []
    k, group = int(rng.integers(len(words))), _GROUPS[int(rng.integers(len(_GROUPS)))]
    put = lambda x: " ".join([*words[:k], x, *words[k + 1 :]])
    return [(put(group[0]), put(group[1 + int(rng.integers(len(group) - 1))]))]


def _mentions(text: str, turn: int) -> list[tuple[str, str]]:
    """Counterfactual pairs of the first sentences with identity terms, else of one sentence."""
    parts = [p for p in re.split(r"[.!?\n]", text) if p.strip()]
    named = [p for p in parts if any(w in _TERMS for w in _WORD.findall(p))][:2]
    chosen = named or ([parts[turn % len(parts)]] if parts else [])
    cut = [" ".join(_WORD.findall(p)[:WORDS]) for p in chosen]
    return [pair for k, p in enumerate(cut) for pair in counterfactuals(p, turn + k)]


_TERMS = {w for g in _GROUPS for w in g[1:]}


def _packed(texts: list[str]) -> list[bytes]:
    """Features of each text as one sentence."""
    out = [np.zeros(0, np.int32)] * len(texts)
    for doc, ids, ends in sentences(pa.array(texts, pa.string())):
        for d, a, z in zip(doc, ends, ends[1:]):
            out[d] = ids[a:z].astype(np.int32)
    return [x.tobytes() for x in out]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, penalty: float = PENALTY) -> ToxicSentences | None:
    """A model for label_col of the labelled rows outside the held-out fold; None without toxic ones."""
    marked = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("label_id")).agg((F.max(F.col(label_col)) > 0).cast("double").alias("y"))
    marked = marked.filter("label_id is not null").withColumn("draw", F.pmod(F.xxhash64("label_id", F.lit("toxic")), F.lit(1 << 40)))
    toxic = marked.filter("y = 1").orderBy("draw", "label_id").limit(sample_docs // 2)
    clean = marked.filter("y = 0").orderBy("draw", "label_id").limit(sample_docs - sample_docs // 2)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # At most sample_docs rows of an identifier and a label: small enough to send to every task.
    rows = rows.join(F.broadcast(toxic.union(clean)), F.col("doc_id") == F.col("label_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list] = [[] for _ in range(len(b))]
            for doc, ids, ends in sentences(b.column(1)):
                for d, a, z in zip(doc, ends, ends[1:]):
                    found[d].append(ids[a:z])
            ids, sizes, left, right = [], [], [], []
            for d, parts in enumerate(found):
                if len(parts) > WINDOWS:
                    parts = [parts[k * len(parts) // WINDOWS] for k in range(WINDOWS)]
                ids.append(np.concatenate(parts).astype(np.int32).tobytes() if parts else b"")
                sizes.append([len(p) for p in parts])
                pairs = _mentions(b.column(1)[d].as_py() or "", b.column(3)[d].as_py())
                left.append(_packed([x for x, _ in pairs]))
                right.append(_packed([y for _, y in pairs]))
            arrays = [b.column(3), b.column(4), b.column(2), pa.array(ids, pa.binary()), pa.array(sizes, pa.list_(pa.int32())), pa.array(left, pa.list_(pa.binary())), pa.array(right, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["draw", "y", "h", "ids", "sizes", "left", "right"])

    small_batches(docs.sparkSession)
    found = rows.select("doc_id", "text", "h", "draw", "y").mapInArrow(extract, "draw long, y double, h long, ids binary, sizes array<int>, left array<binary>, right array<binary>")
    # One text of an identifier, so the bound holds whatever repeats.
    sets = [r["b"] for r in found.groupBy("draw").agg(F.min_by(F.struct("y", "draw", "h", "ids", "sizes", "left", "right"), "h").alias("b")).collect()]
    sets.sort(key=lambda r: (r["draw"], r["h"]))
    if not any(r["y"] for r in sets):
        return None
    array = lambda x: np.frombuffer(x, np.int32).astype(np.int64)
    texts = [(array(r["ids"]), np.r_[0, np.cumsum(r["sizes"], dtype=np.int64)]) for r in sets]
    pairs = [(array(x), array(y)) for r in sets for x, y in zip(r["left"], r["right"])]
    return ToxicSentences().fit(texts, np.array([r["y"] for r in sets]), pairs, penalty)


def score_toxicity(docs: DataFrame, model: ToxicSentences | None, text_col: str = "text") -> DataFrame:
    """docs with toxicity (with underscores before it where docs has such a column)."""
    spark = docs.sparkSession
    small_batches(spark)
    name, low = fresh(docs, "toxicity", "lower_text")
    shared = spark.sparkContext.broadcast((model.bias, model.w) if model else None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ToxicSentences()
        if shared.value:
            known.bias, known.w = shared.value
        for b in batches:
            out = known.score(b.column(b.num_columns - 1)) if shared.value else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], names=[*b.schema.names[:-1], name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn(low, F.lower(text_col)).mapInArrow(score, f"{fields}, `{name}` double")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """All texts by a model that learns from the labels of the folds that are not held out. Edge cases: see the module."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))

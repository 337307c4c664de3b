"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time and labels every byte; a text's probabilities are the mean
over its letters' bytes. Gates are a = (s(x) + 1) / 2 with s(x) = x / (1 + |x|), which also stands in for tanh: the same
saturating shape without exponentials, and training uses its own derivative.

Texts are read whole, in windows of WINDOW bytes that overlap their neighbours by CONTEXT bytes on both sides, so memory
doesn't grow with a text's length. Training learns from at most SAMPLE_DOCS texts, the same number a language as far as
there are that many, and PIECES pieces of TIME bytes from anywhere in each, which tasks draw; that bound is a parameter,
everything else covers all rows. The network has an output a language, so languages are taken to be few (up to thousands).

Null texts and texts without a letter get `und` and score 0. If no labelled row can be learned from, all texts do. Equally
likely languages: the first by name. Null identifiers count as empty for the fold. Other columns pass through, also under
the results' names (those get an underscore then); repeated rows get the same answer; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, small_batches, utf8

HIDDEN, WINDOW, CONTEXT = 8, 512, 24
#: Bounds of what is learned from: texts, pieces of each, bytes of a piece.
SAMPLE_DOCS, PIECES, TIME = 2400, 16, 48
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(3)) == 1


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Bytes -> logits of each language at each byte."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng, h, k = np.random.default_rng(seed), hidden, len(langs)
        self.langs = langs
        init = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = init(256, 3 * h, scale=0.5)
            self.p[f"u{d}"] = init(h, 3 * h, scale=1 / np.sqrt(h))
            self.p[f"o{d}"] = init(h, k, scale=1 / np.sqrt(h))
        self.p["bias"] = np.zeros(k, np.float32)

    def _step(self, d: str, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = h.shape[1]
        x, u = self.p[f"x{d}"].take(byte, 0), h @ self.p[f"u{d}"]
        a = x[:, : 2 * n] + u[:, : 2 * n]
        g = np.abs(a)
        g += 1
        np.divide(a, g, out=g)
        g += 1
        g *= 0.5
        r, z = g[:, :n], g[:, n:]
        c = r * u[:, 2 * n :]
        c += x[:, 2 * n :]
        m = np.abs(c)
        m += 1
        np.divide(c, m, out=m)
        return m + z * (h - m), r, z, m, u[:, 2 * n :]

    def _pass(self, d: str, seq: np.ndarray) -> tuple[np.ndarray, list]:
        """seq (batch, time) -> states (time, batch, hidden), and what backpropagation needs."""
        h = np.zeros((len(seq), len(self.p[f"u{d}"])), np.float32)
        states, kept = [], []
        for t in range(seq.shape[1]):
            new, *more = self._step(d, seq[:, t], h)
            kept.append((h, *more))
            states.append(new)
            h = new
        return np.stack(states), kept

    def gradients(self, seq: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes of the batch, and its gradient by backpropagation through time."""
        batch, time = seq.shape
        runs = {"f": (seq, *self._pass("f", seq)), "b": (seq[:, ::-1], *self._pass("b", seq[:, ::-1]))}
        logits = runs["f"][1] @ self.p["of"] + (runs["b"][1] @ self.p["ob"])[::-1] + self.p["bias"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        loss = -np.log(prob[:, np.arange(batch), label] + 1e-9).mean()
        prob[:, np.arange(batch), label] -= 1
        prob /= batch * time
        g = {"bias": prob.sum((0, 1))}
        for d, (bytes_, states, kept) in runs.items():
            dl = prob if d == "f" else prob[::-1]
            n = states.shape[2]
            g[f"o{d}"] = np.tensordot(states, dl, ((0, 1), (0, 1)))
            gx, gu = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"u{d}"])
            down = dl @ self.p[f"o{d}"].T
            dh = np.zeros((batch, n), np.float32)
            for t in range(time - 1, -1, -1):
                h, r, z, m, un = kept[t]
                dh = dh + down[t]
                dm = dh * (1 - z) * (1 - np.abs(m)) ** 2
                slope = lambda a: 2 * np.minimum(a, 1 - a) ** 2  # noqa: E731  of the gate, by its value
                dz, dr = dh * (h - m) * slope(z), dm * un * slope(r)
                dx = np.concatenate([dr, dz, dm], 1)
                du = np.concatenate([dr, dz, dm * r], 1)
                np.add.at(gx, bytes_[:, t], dx)
                gu += h.T @ du
                dh = dh * z + du @ self.p[f"u{d}"].T
            g[f"x{d}"], g[f"u{d}"] = gx, gu
        return float(loss), g

    def fit(self, texts: list[list[bytes]], label: np.ndarray, steps: int = 320, batch: int = 192, time: int = TIME, rate: float = 0.02, seed: int = 11) -> "Network":
        """Adam on pieces from anywhere in the texts, each language as often."""
        rng = np.random.default_rng(seed)
        of = [[t for t, y in zip(texts, label) if y == k] for k in range(len(self.langs))]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            seq, y = np.full((batch, time), 32, np.uint8), rng.integers(0, len(self.langs), batch)
            for j, k in enumerate(y):
                if of[k]:
                    t = of[k][rng.integers(len(of[k]))]
                    part = np.frombuffer(t[rng.integers(len(t))], np.uint8)[:time]
                    seq[j, : len(part)] = part
            _, g = self.gradients(seq, y)
            now = rate * min(1, 2 * (1 - i / (steps + 1)))
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.98 * second[k] + 0.02 * v * v
                self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.98**i)) + 1e-6)).astype(np.float32)
        return self

    def label(self, byte: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Probabilities (language, time, window) for bytes (time, window), of which the first active[t] windows have a byte at t; the rest has no meaning. The gates' parts of all weights lie apart, so every operation runs over one stretch of memory."""
        h, time, n = len(self.p["uf"]), *byte.shape
        out = np.zeros((len(self.langs), time * n), np.float32)
        for d in "fb":
            x_of, u_of = (np.ascontiguousarray(self.p[k].reshape(-1, 3, h).transpose(1, 0, 2)) for k in (f"x{d}", f"u{d}"))
            u_of[2] *= 0.5  # (s + 1) / 2 * u is (s + 1) * (u / 2)
            states = np.zeros((time, n, h), np.float32)
            before = np.zeros((n, h), np.float32)
            x, u, size = (np.empty((3, n, h), np.float32) for _ in range(3))
            for t in range(time) if d == "f" else range(time - 1, -1, -1):
                m = int(active[t])
                if x.shape[1] != m:
                    x, u, size = (np.empty((3, m, h), np.float32) for _ in range(3))
                prev, new = before[:m], states[t, :m]
                np.take(x_of, byte[t, :m], axis=1, out=x, mode="clip")
                np.matmul(prev, u_of, out=u)
                gate, soft = x[:2], size[:2]
                gate += u[:2]
                np.abs(gate, out=soft)
                soft += 1
                gate /= soft
                gate += 1
                c, soft = u[2], size[2]
                c *= gate[0]
                c += x[2]
                np.abs(c, out=soft)
                soft += 1
                c /= soft
                np.subtract(prev, c, out=soft)
                soft *= gate[1]
                soft *= 0.5
                np.add(soft, c, out=new)
                before = states[t]
            out += self.p[f"o{d}"].T @ states.reshape(time * n, h).T
        out += self.p["bias"][:, None]
        out -= out.max(0)
        np.exp(out, out=out)
        out /= out.sum(0)
        return out.reshape(-1, time, n)

    def windows(self, data: np.ndarray, at: np.ndarray, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of windows: document, first byte, bytes before it that are context, number of bytes, the bytes (time, window) and their probabilities (language, time, window), both from the context on."""
        n = -(-np.diff(at) // WINDOW)
        doc = np.repeat(np.arange(len(n)), n)
        core = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        stop = np.minimum(core + WINDOW, at[doc + 1])
        start, end = np.maximum(core - CONTEXT, at[doc]), np.minimum(stop + CONTEXT, at[doc + 1])
        order = np.argsort(start - end, kind="stable")
        for i in range(0, len(order), block):
            o = order[i : i + block]
            size = end[o] - start[o]
            t = np.arange(int(size[0]))
            byte = data[np.minimum(start[o] + t[:, None], len(data) - 1)]
            yield doc[o], core[o], core[o] - start[o], stop[o] - core[o], byte, self.label(byte, np.searchsorted(-size, -t, "left"))

    def documents(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and its pooled probability of each text."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        data, at = utf8(texts)
        pooled, letters, plain = np.zeros((len(at) - 1, len(self.langs))), np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
        for doc, _, lead, size, byte, prob in self.windows(data, at):
            t = np.arange(len(byte))[:, None]
            use = (t >= lead) & (t < lead + size) & _LETTER[byte]
            np.add.at(pooled, doc, np.einsum("ktn,tn->nk", prob, use.astype(np.float32)))
            np.add.at(letters, doc, use.sum(0))
            np.add.at(plain, doc, (use & (byte < 128)).sum(0))
        best = pooled.argmax(1)
        langs, scores = [], []
        for i, n in enumerate(letters.tolist()):
            known = n and (plain[i] or any(c.isalpha() for c in texts[i].as_py()))
            langs.append(self.langs[best[i]] if known else "und")
            scores.append(min(1.0, float(pooled[i, best[i]]) / n) if known else 0.0)
        return langs, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Network:
    """A network for the languages of the labelled rows outside the held-out fold, from at most sample_docs of their texts, chosen by a hash of the identifier."""
    rows = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(count)
    if not langs:
        return Network([])
    each = max(1, sample_docs // len(langs))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 1.2 * each / count[k]))])
    draw = F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.filter(draw < share[F.col("lang")]).select(draw.alias("draw"), "id", "lang", F.xxhash64("text").alias("h"), "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seed, text in zip(b.column(3).to_pylist(), b.column(4)):
                whole, rng = memoryview(text.as_buffer()) if text.is_valid and len(text.as_buffer()) else b"", np.random.default_rng(abs(seed))
                out.append([bytes(whole[i : i + TIME]) for i in rng.integers(0, max(1, len(whole) - TIME + 1), PIECES).tolist()] if len(whole) else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.list_(pa.binary()))], names=["draw", "id", "lang", "h", "pieces"])

    small_batches(docs.sparkSession)
    found = drawn.mapInArrow(pieces, "draw double, id string, lang string, h long, pieces array<binary>").filter("size(pieces) > 0").orderBy("draw", "id", "h").limit(2 * sample_docs).collect()
    texts, label, of = [], [], dict.fromkeys(langs, 0)
    for r in found:
        if of[r["lang"]] < each:
            of[r["lang"]] += 1
            texts.append([bytes(x) for x in r["pieces"]])
            label.append(langs.index(r["lang"]))
    return Network(langs).fit(texts, np.array(label, np.int64))


def predict_language(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (with underscores before them where docs has such columns)."""
    small_batches(docs.sparkSession)
    lang, score = fresh(docs, "lang_pred", "score")
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = network.documents(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(predict, f"{fields}, `{lang}` string, `{score}` double")


def language_spans(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (bytes), lang: runs of bytes with one label, in each window."""
    small_batches(docs.sparkSession)
    names = np.array(network.langs, object)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            for doc, core, lead, size, _, prob in network.windows(data, at):
                best = prob.argmax(0).T
                best = np.take_along_axis(best, np.minimum(lead[:, None] + np.arange(size.max()), best.shape[1] - 1), 1)
                best[np.arange(best.shape[1]) >= size[:, None]] = -1
                new = np.ones(best.shape, bool)
                new[:, 1:] = best[:, 1:] != best[:, :-1]
                row, col = np.nonzero(new)
                stop = np.append(np.where(row[1:] == row[:-1], col[1:], best.shape[1]), best.shape[1])
                ok = best[row, col] >= 0
                row, col, stop = row[ok], col[ok], stop[ok]
                first = core[row] - at[doc[row]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[row])), pa.array(first + col), pa.array(first + stop), pa.array(names[best[row, col]], pa.string())], names=["doc_id", "start", "end", "lang"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(spans, f"doc_id {kind}, start long, end long, lang string")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """All texts by a network that learns from the folds that are not held out. Edge cases: see the module."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict_language(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

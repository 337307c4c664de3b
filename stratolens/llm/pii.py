"""Personal data by weak supervision.

Base spans come from fixed patterns and always stay. Looser patterns bring further candidates of more kinds. Every candidate
gets a vote (yes, no or none) from five labelers: its kind's check (Luhn, ISO 7064 for account numbers, address ranges,
dates, entropy of keys), a gazetteer (mail hosts, card issuers, names, countries of account numbers), the words before it, the
characters around it, and how varied its characters are. Expectation-maximisation over the counts of all vote patterns in the
corpus estimates for every labeler, the check among them, how often it is right, and how likely each pattern is personal
data. Those probabilities train the span classifier, a logistic regression on the kind, the votes and the span's shape;
further candidates that it finds likely, and that cross no base span, are added, the likeliest first.

The patterns that the corpus has are counted by Spark over all documents; there are at most as many as kinds x votes x
shapes, whatever the input, and only they reach the driver.

Null texts are empty. Offsets are code points, the end exclusive. Texts are read whole, in time in proportion to their
length but for sorting their spans. Equally likely candidates: the one that begins first, then by kind. Repeated rows get the
same answer; other columns are left out, so names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, stored

#: Kinds in the order of ties; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_spelled", "phone_local", "national_id", "person", "iban", "ipv6", "secret", "birth_date", "address")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Texts without any of these have no such span; other kinds need a digit.
_HINTS = {
    "email_spelled": re.compile(r"at[)\]]"), "person": re.compile(r"Mr|Ms|Dr|Prof|Herr|Frau|Mme|Sra?\b"), "ipv6": re.compile(r":[0-9A-Fa-f]{0,4}:"),
    "secret": re.compile(r"[:=]|AKIA|gh[pousr]_|xox[baprs]-|eyJ|-----BEGIN"), "address": re.compile(r"St|Ave|R(?:oa)?d\b|Lane|Drive|Boulevard|Blvd|stra(?:ß|ss)e|[Ww]eg\b|[Pp]latz"),
}
#: A span is the group `v` where there is one.
_MORE = {
    "email_spelled": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,8}"),
    "phone_local": re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "person": re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra|Sr)\.? (?P<v>[A-ZÄÖÜÉ][a-zà-ÿ]{1,30}(?: [A-ZÄÖÜÉ][a-zà-ÿ]{1,30})?)(?![A-Za-z])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ipv6": re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])"),
    "secret": re.compile(
        r"(?i:\b(?:token|secret|password|passwd|pwd|passwort|contraseña|mot de passe|(?:api|access|private|auth)[_ -]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?)(?P<v>[A-Za-z0-9+/_.~!@#$%^&*=-]{8,}+)"
        r"|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[baprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+)|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    ),
    "birth_date": re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])"),
    "address": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{1,5} (?:[A-Z][a-z]{1,30} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd)|[A-ZÄÖÜ][a-zäöüß]{1,40}(?:straße|strasse|weg|platz) [0-9]{1,4}[a-z]?)(?![A-Za-z0-9])"),
}
# Words that go before personal data, mail hosts, countries of account numbers, names that are well known.
_BEFORE = {
    "email": ("mail", "contact", "write", "reach", "send", "schreib", "courriel", "correo", "kontakt", "contacto", "escrib", "écri"),
    "ip": ("ip", "host", "server", "address", "login", "from", "client", "adresse", "dirección"),
    "ipv6": ("ip", "host", "server", "address", "login", "from", "client", "adresse", "dirección"),
    "card": ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta", "mastercard", "amex", "debit"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "cell", "reach", "anruf", "ruf", "handy", "appel", "llam", "móvil"),
    "national_id": ("ssn", "social", "security", "id", "insurance"),
    "person": ("name", "by", "from", "dear", "signed", "von", "par", "por", "lieber", "liebe", "cher", "chère", "querid"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "transfer", "bank"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "passwort", "key", "auth", "contraseña", "passe", "bearer"),
    "birth_date": ("born", "birth", "dob", "geboren", "geburt", "né", "née", "naissance", "nacid", "nacimiento"),
    "address": ("address", "live", "lives", "at", "wohn", "adresse", "anschrift", "habite", "dirección", "vive", "ship"),
}
_HOSTS = ("gmail.", "yahoo.", "outlook.", "hotmail.", "mail.", "example.", "icloud.", "live.", "aol.", "gmx.", "web.de", "proton", "orange.", "free.fr", "laposte.", "t-online.", "yandex.", "qq.com", "163.com", "msn.")
_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
_NAMES = frozenset(
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor moore jackson martin lee perez thompson white harris clark lewis robinson "
    "müller mueller schmidt schneider fischer weber meyer wagner becker schulz hoffmann bernard dubois durand petit leroy moreau simon laurent lefebvre sanchez ramirez torres flores rivera gomez diaz "
    "james john robert michael mary patricia jennifer linda david anna maria peter hans klaus jean pierre marie luis jose juan carlos".split()
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern, found from their @: a pattern that starts at every letter takes the square of a long word's length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _checked(kind: str, part: str) -> bool | None:
    """What the kind's check says of a span; None if there is no check."""
    digits = re.sub("[^0-9]", "", part)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in part.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        bare = part.replace(" ", "")
        return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    if kind == "ipv6":
        try:
            return ipaddress.IPv6Address(part) is not None and part.count(":") > 1 and part != "::"
        except ValueError:
            return False
    if kind == "national_id":
        return part[:3] not in ("000", "666") and part[0] != "9" and part[4:6] != "00" and part[7:] != "0000"
    if kind == "birth_date":
        a, b, c = (int(x) for x in re.split("[./-]", part))
        day, month = (c, b) if a > 31 else (a, b) if b <= 12 else (b, a)
        return 1 <= month <= 12 and 1 <= day <= 31
    if kind == "secret":
        return part.startswith("-----") or entropy(part) >= 2.5
    return True if kind == "email" else None


def entropy(part: str) -> float:
    """Bits a character, by the characters' own frequencies."""
    n = np.array(list(Counter(part).values())) / max(1, len(part))
    return float(-(n * np.log2(n)).sum())


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and what the looser patterns find beside them: (start, end, kind)."""
    base, more = [], []
    digits = _DIGIT.search(text)
    if "@" in text:
        base += [(a, z, "email") for a, z in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        if not digits or kind == "phone" and "+" not in text:
            continue
        for m in pattern.finditer(text):
            a, z = m.span()
            if _checked(kind, m.group()):
                base.append((a, z, kind))
            elif kind == "card" and 12 <= sum(c.isdigit() for c in m.group()) <= 19:
                more.append((a, z, kind))
    for kind, pattern in _MORE.items():
        if _HINTS[kind].search(text) if kind in _HINTS else digits:
            more += [(*m.span("v" if "v" in pattern.groupindex and m.group("v") else 0), kind) for m in pattern.finditer(text)]
    base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    free = _Taken(base)
    return base, [s for s in more if free(s[0], s[1]) and (s[2] != "ipv6" or _checked("ipv6", text[s[0] : s[1]]))]


class _Taken:
    """Whether a span crosses none of some others; disjoint ones can be added."""

    def __init__(self, spans):
        self.starts = [a for a, _, _ in spans]
        self.ends = list(accumulate((z for _, z, _ in spans), max))

    def __call__(self, a: int, z: int) -> bool:
        return not (i := bisect_left(self.starts, z)) or self.ends[i - 1] <= a

    def add(self, a: int, z: int) -> None:
        """Ends stay the greatest so far: a new span that crosses none of the others lies after all that begin before it."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, z)


def votes(text: str, start: int, end: int, kind: str) -> str:
    """One letter a labeler: y, n or - for none."""
    part, before = text[start:end], text[max(0, start - 40) : start].lower()
    family = kind if kind in _BEFORE else kind.split("_")[0]
    digits, low, bare = sum(c.isdigit() for c in part), part.lower(), re.sub("[^0-9]", "", part)
    check = _checked(kind, part)
    strict = "-" if check is None else "y" if check else "n"
    known = {
        "email": lambda: any(h in low for h in _HOSTS), "person": lambda: any(w in _NAMES for w in low.split()), "iban": lambda: part[:2] in _COUNTRIES,
        "card": lambda: bool(re.match("4|5[1-5]|2[2-7]|3[47]|6011|65", bare)), "secret": lambda: part.startswith(("AKIA", "ghp_", "xox", "eyJ", "-----")) or bool(re.fullmatch("(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})", low)),
    }
    gazetteer = "-" if family not in known else "y" if known[family]() else "n"
    words = re.findall(r"[a-zà-ÿ]+", before)[-4:]
    context = "y" if any(w.startswith(x) for w in words for x in _BEFORE.get(family, ())) else "n"
    around = (text[start - 1 : start] or " ") + (text[end : end + 1] or " ")
    edges = "y" if not any(c.isalnum() or c in "_=/" for c in around) else "n"
    varied = "-" if digits < 7 else "y" if len({c for c in part if c.isdigit()}) > 2 else "n"
    return strict + gazetteer + context + edges + varied


def _shape(start: int, end: int) -> int:
    return min(5, (end - start) // 6)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base [(start, end, kind)], more [(start, end, kind)], and keys: kind:votes:shape of all of them, in that order."""
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, others, keys = [], [], []
            for x in b.column(1):
                text = x.as_py() or ""
                base, more = spans_of(text)
                bases.append([{"start": a, "end": z, "kind": k} for a, z, k in base])
                others.append([{"start": a, "end": z, "kind": k} for a, z, k in more])
                keys.append([f"{k}:{votes(text, a, z, k)}:{_shape(a, z)}" for a, z, k in (*base, *more)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, span), pa.array(others, span), pa.array(keys, pa.list_(pa.string()))], names=["doc_id", "base", "more", "keys"])

    kind, s = docs.schema[id_col].dataType.simpleString(), "array<struct<start:int,end:int,kind:string>>"
    return docs.select(id_col, text_col).mapInArrow(find, f"doc_id {kind}, base {s}, more {s}, keys array<string>")


def reliabilities(counts: dict[str, int], rounds: int = 50, hold: float = 0.2) -> tuple[np.ndarray, dict[str, float]]:
    """Vote patterns with their counts -> each labeler's chance of a yes among its votes (labeler, class), and each pattern's probability, by expectation-maximisation from the majority's votes; labelers without a vote say nothing. The check is a labeler like the others, with an error of its own. The majority's estimate weighs as `hold` of all votes throughout, so the classes keep their meaning."""
    names = sorted({k.split(":")[1] for k in counts})
    n = np.array([sum(c for k, c in counts.items() if k.split(":")[1] == v) for v in names], float)
    yes, no = (np.array([[c == x for c in v] for v in names], float) for x in "yn")
    first = p = (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1)
    for _ in range(rounds):
        rate, prior = [], (n * ((1 - hold) * p + hold * first)).sum() / n.sum()
        for a, b in ((1 - p, 1 - first), (p, first)):
            w = n * ((1 - hold) * a + hold * b)
            rate.append((w @ yes + 1) / (w @ (yes + no) + 2))
        log = [np.log(x) + yes @ np.log(r) + no @ np.log(1 - r) for x, r in zip((1 - prior, prior), rate)]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return np.stack(rate, 1), dict(zip(names, p.tolist()))


def _features(key: str) -> np.ndarray:
    kind, v, shape = key.split(":")
    x = np.zeros(1 + len(KINDS) + 2 * len(v) + 6)
    x[0] = x[1 + KINDS.index(kind)] = 1
    for j, c in enumerate(v):
        x[1 + len(KINDS) + 2 * j] = c == "y"
        x[2 + len(KINDS) + 2 * j] = c == "n"
    x[1 + len(KINDS) + 2 * len(v) + int(shape)] = 1
    return x


def classifier(counts: dict[str, int], truth: dict[str, float], rounds: int = 300) -> dict[str, float]:
    """Logistic regression on all spans' features, weighted by their counts, towards the probabilities of their votes -> a probability for each key."""
    if not counts:
        return {}
    keys = sorted(counts)
    x, y, n = np.stack([_features(k) for k in keys]), np.array([truth[k.split(":")[1]] for k in keys]), np.array([counts[k] for k in keys], float)
    w, n = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (n * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-x @ w))).tolist()))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, base and found: arrays of (start, end, kind), found with what the classifier adds, in order of start and kind."""
    small_batches(docs.sparkSession)
    rows = stored(candidates(docs, id_col, text_col), "pii")
    counts = {r["key"]: r["n"] for r in rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).collect()}
    p = classifier(counts, reliabilities(counts)[1] if counts else {})
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, more, keys in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                found, free = list(base), _Taken([(s["start"], s["end"], s["kind"]) for s in base])
                for s, key in sorted(zip(more, keys[len(base) :]), key=lambda x: (-p[x[1]], x[0]["start"], KINDS.index(x[0]["kind"]))):
                    if p[key] >= least and free(s["start"], s["end"]):
                        found.append(s)
                        free.add(s["start"], s["end"])
                out.append(sorted(found, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(span), pa.array(out, span)], names=["doc_id", "base", "found"])

    s = "array<struct<start:int,end:int,kind:string>>"
    return rows.mapInArrow(decide, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {s}, found {s}")


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    """Spans of all texts: the base by kind with their digest, and all with what the classifier adds. Edge cases: see the module."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), F.size("found").cast("long").alias("n_spans"))

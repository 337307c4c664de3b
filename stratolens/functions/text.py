"""Column functions on text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

_MARKS = "\u0300-\u036f"


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c).lower()) if not "\u0300" <= x <= "\u036f")


#: Letters with marks (Latin up to U+024F) and full-width letters, and what search reads them as; one for one, so any SQL engine can do the same.
MARKED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0xFF10, 0xFF5B)]) if c == c.lower() and len(_bare(c)) == 1 and _bare(c) != c)
PLAIN = "".join(map(_bare, MARKED))
#: Letters of terms: a-z, 0-9, and Hangul, Kana and Han, whose terms may be two letters long.
EAST = "가-힣ぁ-ゟ゠-ヿ一-龯々〆〤"
LETTERS = f"a-z0-9{EAST}"


def _others(kept: str) -> str:
    """The class of all characters that aren't among `kept` (single ones and ranges) written out: Java takes several times as long over a negated class."""
    spans = sorted((ord(x[0]), ord(x[-1])) for x in re.findall("(?s).-.|.", kept))
    at, out = 0, ""
    for a, z in [*spans, (0x110000, 0x110000)]:
        if at < a:
            out += f"\\x{{{at:x}}}-\\x{{{a - 1:x}}}"
        at = max(at, z + 1)
    return out


#: What stands between terms: everything but LETTERS and hyphens.
BETWEEN = _others(f"{LETTERS}-")
# Words that search terms leave out.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "this", "that", "there", "any", "video", "movie", "clip", "clips", "sample", "about", "related", "relating", "available", "find", "show", "search", "moment", "moments",
    "scene", "scenes", "into", "your", "you", "are", "was", "were", "have", "has", "where", "when", "what", "how",
)


def unmarked(text: Column) -> Column:
    """Lower case, without marks; plain ASCII needs no look-up of its letters."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(F.regexp_replace(low, f"[{_MARKS}]+", ""), MARKED, PLAIN))


def normalised(text: Column) -> Column:
    """Lower case, without marks, single blanks."""
    return F.trim(F.regexp_replace(unmarked(text), "[ \\t\\n\\r]+", " "))


def terms(text: Column) -> Column:
    """Tokens of LETTERS and inner hyphens."""
    bare = F.regexp_replace(unmarked(text), f"[{BETWEEN}]+", " ")
    inner = F.regexp_replace(bare, f"(?<![{LETTERS}])-+|-+(?![{LETTERS}])", "")
    return F.array_remove(F.split(inner, " "), "")


def is_keyword(term: Column) -> Column:
    """Longer than two letters, or than one in Hangul, Kana or Han, and no stop word."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return ((F.length(term) > 2) | ((F.length(term) == 2) & term.rlike(f"[{EAST}]"))) & ~F.array_contains(stop, term)


def keywords(text: Column, most: int | None = 24) -> Column:
    """The first distinct keywords among the terms, or all of them."""
    kept = F.array_distinct(F.filter(terms(text), is_keyword))
    return kept if most is None else F.slice(kept, 1, most)


def lexical_hits(tokens: Column, asked: Sequence[str]) -> Column:
    """How many of the asked terms are among the tokens."""
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in asked])))


def lexical_score(text: Column, asked: Sequence[str]) -> Column:
    """How many of the asked terms a text has: a single word among its tokens, words with Hangul anywhere, several words one after another. A text that doesn't hold a word's letters isn't looked at closer."""
    plain, score = unmarked(text), F.lit(0)
    for term in asked:
        words = "".join(c if c.isalnum() or c == "-" else " " for c in _bare_text(term)).split()
        words = [w.strip("-") for w in words if w.strip("-")]
        if len(words) == 1 and any("가" <= c <= "힣" for c in words[0]):
            hit = plain.contains(words[0])
        elif words:
            gap = f"-*(?:[^{LETTERS}-]-*)+" if len(words) > 1 else ""
            hit = plain.contains(words[0]) & plain.rlike(f"(?:^|[^{LETTERS}-])-*{gap.join(words)}-*(?:[^{LETTERS}-]|$)" if len(words) == 1 else gap.join(words))
        else:
            continue
        score = score + F.when(hit, 1).otherwise(0)
    return score


def _bare_text(text: str) -> str:
    low = unicodedata.normalize("NFKC", text).lower()
    return "".join(_bare(c) if "\u00c0" <= c < "\u0250" else c for c in low)


@F.pandas_udf(LongType())
def shared_bigrams(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many pairs of neighbouring characters two texts share, each as often as both have it; null holds none."""
    grams = lambda s: Counter(map("".join, zip(s, s[1:]))) if s else Counter()
    return pd.Series([(grams(x) & grams(y)).total() for x, y in zip(a, b)], dtype="int64")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalised(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def header_name(text: Column) -> Column:
    """A column name as importers compare it."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def words_up_to(text: Column, n: int) -> Column:
    """At most n characters, cut after a whole word, with '...' where something is cut."""
    short = F.regexp_replace(F.substring(text, 1, n), " +[^ ]*$", "")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(short, F.lit("...")))


def minutes(seconds: Column) -> Column:
    """m:ss of rounded seconds, as many minutes as there are; never below 0."""
    s = F.greatest(F.lit(0), F.round(seconds).cast("long"))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def season(date: Column, first_month: int = 7) -> Column:
    """2024-25 for a date from the first month of 2024 until that of 2025."""
    y = F.year(date) - F.when(F.month(date) < first_month, 1).otherwise(0)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, and th for all others."""
    return F.concat(n.cast("string"), F.when(n == 1, "st").when(n == 2, "nd").when(n == 3, "rd").otherwise("th"))


def number(text: Column) -> Column:
    """A double of text with thousands commas; null if it isn't one."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def title_case(text: Column) -> Column:
    """The first letter of each word of a-z, 0-9 and _ in upper case, the rest as it is."""
    parts = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), 0)
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")


def readable(label: Column) -> Column:
    """A domain label without its prefix, with blanks for underscores."""
    return F.replace(F.regexp_replace(label, r"^[^.]+\.", ""), F.lit("_"), F.lit(" "))


def boolean(text: Column) -> Column:
    """1, true and yes in any case are true, everything else is not."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes"), F.lit(False))


def distinct_spellings(values: Column) -> Column:
    """Values with single blanks, of which the first spelling stays where only case differs; empty ones go."""
    clean = F.filter(F.transform(values, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) > 0)
    return F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)


def quality_of(text: Column) -> Column:
    """How much a text looks like text: letters of known scripts count for it, replacement and control characters and signs of a wrong decoding against it."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    return 4 * n("[가-힯]") + 3 * n("[一-\u9fff]") + n("[㄰-\u318fᄀ-ᇿA-Za-z0-9]") - 12 * n("\ufffd") - 8 * n("[\\x{80}-\\x{9f}]") - 4 * n("[ÃÂâ]")


def repaired(text: Column) -> Column:
    """Text whose UTF-8 was read as Latin-1, read again, where that looks better; all other text as it is."""
    suspect = text.rlike("[ÃÂâ\\x{80}-\\x{9f}]") & ~text.rlike("[^\\x{00}-\\x{ff}]")
    again = F.when(suspect, F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string")))
    return F.when(again.isNotNull() & (quality_of(again) > quality_of(text)), again).otherwise(text)

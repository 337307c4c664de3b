"""What texts say of clocks, seasons, numbers and labels, as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Patterns of clocks, downs and jersey numbers as broadcasts write them.
ADDED = r"\b(45|90|105|120)\s*\+\s*(\d{1,2})\b"
MINUTE = r"(?i)\b([1-9]\d?|1[01]\d|120)\s*(?:'|min(?:ute)?s?|분)\b"
NTH_MINUTE = r"(?i)\b([1-9]\d?|1[01]\d|120)(?:st|nd|rd|th)\s+minute\b"
CLOCK = r"\b([0-9]{1,2}):([0-5]\d)\b"
QUARTERS = (r"(?i)\bQ\s*([1-4])\s*[-:]?\s*([0-9]{1,2}:[0-5]\d)\b", r"(?i)\b([1-4])(?:st|nd|rd|th)\s+quarter\b.{0,24}?\b([0-9]{1,2}:[0-5]\d)\b", r"(?i)\bquarter\s+([1-4])\b.{0,24}?\b([0-9]{1,2}:[0-5]\d)\b")
DOWN = r"\b([1-4])(?:st|nd|rd|th)?\s*(?:and|&)\s*(\d{1,2})\b"
SHIRT = r"(?i)(?:#|no\.?\s*|number\s+|shirt\s+|jersey\s+|등번호\s*)(\d{1,2})\b"
TIMESTAMP = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[,.](\d{1,3}))?$"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def football_minutes(text: Column) -> Column:
    """Minutes of a match that a text names, in order of the kind of clock: added time, minutes, the nth minute, m:ss. 0 to 130."""
    int_ = lambda a: F.transform(a, lambda x: x.cast("int"))
    plain = F.regexp_replace(text, "[’′]", "'")
    added = F.zip_with(int_(_all(plain, ADDED, 1)), int_(_all(plain, ADDED, 2)), lambda a, b: a + b)
    clock = F.filter(int_(_all(plain, CLOCK, 1)), lambda m: m <= 59)
    return F.filter(F.concat(added, int_(_all(plain, MINUTE, 1)), int_(_all(plain, NTH_MINUTE, 1)), clock), lambda m: (m >= 0) & (m <= 130))


def football_period(minute: Column) -> Column:
    return F.when(minute <= 45, "1H").when(minute <= 90, "2H").when(minute <= 105, "ET1").when(minute <= 120, "ET2").otherwise("unknown")


def american_clocks(text: Column) -> Column:
    """Distinct [quarter:m:ss] of a text, by three ways of writing them."""
    plain = F.regexp_replace(F.regexp_replace(text, "[’′]", "'"), r"\s+", " ")
    clock = lambda c: F.concat(F.element_at(F.split(c, ":"), 1).cast("int").cast("string"), F.lit(":"), F.element_at(F.split(c, ":"), 2))
    each = [F.zip_with(_all(plain, p, 1), _all(plain, p, 2), lambda q, c: F.concat(q, F.lit(":"), clock(c))) for p in QUARTERS]
    return F.array_distinct(F.concat(*each))


def elapsed_minute(quarter: Column, minute: Column, second: Column) -> Column:
    """Minutes since the game's begin, of a clock that counts down from 15:00 in each quarter."""
    return F.round((quarter - 1) * 15 + F.greatest(F.lit(0.0), 15 - minute - second / 60), 2)


def down_and_distance(text: Column) -> tuple[Column, Column]:
    """Of "3rd and 7"; nulls if there is none."""
    return tuple(F.regexp_extract(text, DOWN, k).try_cast("int") for k in (1, 2))


def game_seconds(text: Column) -> Column:
    """Seconds of "1 - 12:34" or "h:mm:ss"; null if it is no time."""
    part = F.split(F.regexp_replace(F.trim(text), "^.*? - ", ""), ":")
    n = [F.get(part, F.lit(i)).try_cast("double") for i in range(3)]
    return F.when(F.size(part) == 2, n[0] * 60 + n[1]).when(F.size(part) == 3, n[0] * 3600 + n[1] * 60 + n[2])


def timestamp_seconds(text: Column) -> Column:
    """Seconds of "hh:mm:ss,ms"; null if it is no timestamp."""
    g = lambda k: F.regexp_extract(F.trim(text), TIMESTAMP, k)
    n = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    return F.when(F.trim(text).rlike(TIMESTAMP), n(g(1)) * 3600 + n(g(2)) * 60 + n(g(3)) + n(F.rpad(g(4), 3, "0")) / 1000)


def season_of(text: Column) -> tuple[Column, Column]:
    """The first season range of a text, else its first year; and whether it is a range."""
    year, span = r"\b(20\d{2})\b", r"\b(20\d{2})\s*[-/]\s*(20\d{2}|\d{2})\b"
    found = F.regexp_extract(text, span, 1)
    value = F.when(found != "", F.concat(found, F.lit("-"), F.regexp_extract(text, span, 2))).otherwise(F.nullif(F.regexp_extract(text, year, 1), F.lit("")))
    return value, found != ""


def season_from_code(code: Column) -> Column:
    """2425 is 2024-25; beginnings after 70 are of the last century."""
    start = F.substring(code, 1, 2).cast("int")
    return F.concat((F.when(start > 70, 1900).otherwise(2000) + start).cast("string"), F.lit("-"), F.substring(code, 3, 2))


def season_from_slash(text: Column) -> Column:
    """2015/2016 is 2015-16."""
    return F.when(text.rlike(r"^\d{4}/\d{4}$"), F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 8, 2))).otherwise(F.regexp_replace(text, "^([^/]*)/", "$1-"))


def jersey_numbers(text: Column) -> Column:
    """Numbers of 1 to 99 that stand alone among capitals and digits."""
    found = F.transform(_all(text, r"(?<![A-Z0-9])(\d{1,2})(?![A-Z0-9])", 1), lambda x: x.cast("int"))
    return F.filter(found, lambda n: n.between(1, 99))


def shirt_numbers(text: Column) -> Column:
    """Distinct numbers of 1 to 99 after a word for them."""
    return F.array_distinct(F.filter(F.transform(_all(text, SHIRT, 1), lambda x: x.cast("int")), lambda n: n.between(1, 99)))


def label_clause(text: Column) -> Column:
    """The clause of a text that makes the best label, near 18 letters and rather of several words; null if none says anything."""
    searchable = lambda x: F.regexp_replace(x, "[^0-9A-Za-z가-힣]", "")
    means = lambda x: (F.length(searchable(x)) >= 4) & ~searchable(x).rlike("^[0-9]+$|(?i)^(?:scene|moment|unknown|metadata)$")
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[“”\"']", ""), r"^\s*[-–—•·:]+|\s*[-–—•·:]+\s*$", ""), r"\s+", " "))
    score = lambda x: F.greatest(F.lit(0), 32 - F.abs(F.length(searchable(x)) - 18)) + F.when(x.contains(" "), 8).otherwise(0)
    clauses = F.filter(F.transform(F.split(clean(text), r"\s+-\s+|[.!?。！？…]+|[|/]| {2,}"), clean), means)
    return F.array_max(F.transform(clauses, lambda x, i: F.struct(score(x).alias("s"), (-i).alias("i"), x.alias("x"))))["x"]


def best_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The name of the rule with the most terms in the text, then with the longest first term, then the first."""
    each = [F.struct(sum(text.contains(t).cast("int") for t in terms).alias("n"), F.lit(len(terms[0])).alias("len"), F.lit(-i).alias("i"), F.lit(name).alias("rule")) for i, (name, terms) in enumerate(rules)]
    best = F.array_max(F.array(*each))
    return F.when(best["n"] > 0, best["rule"])

"""Classification by a table of rules: terms in the text, features of the row, the surest rule wins.

All rules' terms go into one automaton (Aho and Corasick), so a text is read once however many rules there are. What a text
matched (only those rules) is scored by column functions: BASE, and TERM for each distinct term up to TERMS of them, CUE if a
cue term is there, and what the caller adds for features of the row. Scores are hundredths. Rules that need a cue, and rows
that have none (neither a cue term nor the feature `cue`), don't meet. Equal scores go to the earlier rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

try:
    import ahocorasick
except ImportError:  # then terms are looked up one by one
    ahocorasick = None

# Fixed values.
BASE, TERM, TERMS, CUE, MOST = 34, 14, 28, 12, 92
#: Rules and terms that are compiled and sent to every task; more is an error.
MAX_TERMS = 200_000
RULES = "rule int, label string, terms array<string>, cues array<string>, needs_cue boolean, bonus int"


class Terms:
    """Which of some terms a text holds, in one pass; without the automaton's library, one by one."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.found = None
        if ahocorasick is not None and terms:
            self.found = ahocorasick.Automaton()
            for t in terms:
                self.found.add_word(t, t)
            self.found.make_automaton()

    def of(self, text: str) -> set[str]:
        if self.found is None:
            return {t for t in self.terms if t in text}
        return {t for _, t in self.found.iter(text)}


def matched(df: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """df with `matches`: rule, label, hits, cue_hits, needs_cue and bonus of each rule that has a term in the text. rules: see RULES, a table of parameters, MAX_TERMS terms at most; null and empty terms, and rules without any, match nothing. A null text matches nothing."""
    table = rules.select("rule", "label", "terms", "cues", "needs_cue", "bonus").limit(MAX_TERMS + 1).collect()
    table = [(r["rule"], r["label"], {t for t in r["terms"] or [] if t}, {t for t in r["cues"] or [] if t}, bool(r["needs_cue"]), r["bonus"] or 0) for r in table]
    if sum(len(r[2]) + len(r[3]) for r in table) > MAX_TERMS or len(table) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} rules or terms")
    by_term: dict[str, list[int]] = {}
    for i, r in enumerate(table):
        for t in r[2]:
            by_term.setdefault(t, []).append(i)
    words = sorted(set(by_term) | {t for r in table for t in r[3]})
    shared = df.sparkSession.sparkContext.broadcast((table, by_term, words))
    at = df.columns.index(text)
    kind = pa.list_(pa.struct([("rule", pa.int32()), ("label", pa.string()), ("hits", pa.int32()), ("cue_hits", pa.int32()), ("needs_cue", pa.bool_()), ("bonus", pa.int32())]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, by_term, words = shared.value
        terms = Terms(words)
        for b in batches:
            out = []
            for x in b.column(at):
                there = terms.of(x.as_py().lower()) if x.is_valid else set()
                hits: dict[int, int] = {}
                for t in there:
                    for i in by_term.get(t, ()):
                        hits[i] = hits.get(i, 0) + 1
                out.append([{"rule": table[i][0], "label": table[i][1], "hits": n, "cue_hits": len(table[i][3] & there), "needs_cue": table[i][4], "bonus": table[i][5]} for i, n in sorted(hits.items())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "matches"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(match, f"{fields}, matches array<struct<rule:int,label:string,hits:int,cue_hits:int,needs_cue:boolean,bonus:int>>")


def classified(df: DataFrame, rules: DataFrame, text: str, cue: Column, features: dict[str, tuple[Column, int]], default: str = "unknown") -> DataFrame:
    """df with label, confidence (hundredths), rule, and features (those that held): the surest rule of each row. cue: whether the row has a cue of its own; features: condition and hundredths; a null condition doesn't hold. Rows that no rule fits are `default` with 0."""
    out = matched(df, rules, text)
    holds = {name: F.coalesce(c, F.lit(False)) for name, (c, _) in features.items()}
    shared = sum((F.when(holds[name], weight).otherwise(0) for name, (_, weight) in features.items()), F.lit(0))
    out = out.withColumn("_cue", F.coalesce(cue, F.lit(False))).withColumn("_shared", shared.cast("int"))
    fits = F.filter("matches", lambda m: ~m["needs_cue"] | F.col("_cue") | (m["cue_hits"] > 0))
    sure = lambda m: F.lit(BASE) + F.least(F.lit(TERMS), m["hits"] * TERM) + F.when(F.col("_cue") | (m["cue_hits"] > 0), CUE).otherwise(0) + m["bonus"] + F.col("_shared")
    best = F.array_max(F.transform(fits, lambda m: F.struct(F.least(F.lit(MOST), sure(m)).cast("int").alias("s"), (-m["rule"]).alias("r"), m["label"].alias("l"))))
    out = out.withColumn("_best", best)
    held = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in holds.items()])) if holds else F.array().cast("array<string>")
    return out.select(*df.columns, F.coalesce("_best.l", F.lit(default)).alias("label"), F.coalesce("_best.s", F.lit(0)).alias("confidence"), (-F.col("_best.r")).alias("rule"), held.alias("features"))

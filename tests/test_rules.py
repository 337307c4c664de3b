"""Rule classification against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from stratolens.operators import rules as U


def plain(text, cue, features, table):
    best = None
    for rule, label, terms, cues, needs, bonus in table:
        low = (text or "").lower()
        hits = len({t for t in terms or [] if t and t in low}) if text is not None else 0
        has = cue or any(t and t in low for t in cues or [])
        if hits and (not needs or has):
            s = min(U.MOST, U.BASE + min(U.TERMS, U.TERM * hits) + (U.CUE if has else 0) + (bonus or 0) + sum(features))
            if best is None or (s, -rule) > (best[0], -best[2]):
                best = (s, label, rule)
    return best or (0, "unknown", None)


@pytest.mark.parametrize("automaton", [True, False])
def test_hundreds_of_rules(spark, monkeypatch, automaton):
    if not automaton:
        monkeypatch.setattr(U, "ahocorasick", None)
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "pass shot press goal punt field run fumble".split() for b in ("", " play", "s", " left", "er", "이동")]
    table = [(i, f"label{i % 40}", rng.sample(words, rng.randint(0, 4)) + rng.choice([[], [None], [""]]), rng.choice([None, [], rng.sample(words, 1)]), rng.random() < 0.4, rng.choice([None, 0, 6])) for i in range(300)]
    rows = [(i, " ".join(rng.choices([*words, "x", "Y"], k=rng.randint(0, 12))).title(), rng.random() < 0.3, rng.choice([True, False, None])) for i in range(120)] + [(200, None, True, True), (201, "", False, None), (202, "x " * 100_000 + "FUMBLE", None, None)]
    df = spark.createDataFrame(rows, "i int, text string, c boolean, f boolean").repartition(3)
    rules = spark.createDataFrame(table, U.RULES)
    if not automaton:  # the tasks' own module has the library; the plain look-up is held against it
        terms = sorted({t for r in table for t in r[2] if t})
        assert all(U.Terms(terms).of(t.lower()) == {x for x in terms if x in t.lower()} for _, t, _, _ in rows if t)
        return
    out = U.classified(df, rules, "text", F.col("c"), {"f": (F.col("f"), 9)}).collect()
    assert len(out) == len(rows)
    for r in out:
        want = plain(r["text"], bool(r["c"]), [9] if r["f"] else [], table)
        assert (r["confidence"], r["label"], r["rule"]) == want and r["features"] == (["f"] if r["f"] else [])
    assert U.classified(df.limit(0), rules, "text", F.col("c"), {}).collect() == []
    assert {r["label"] for r in U.classified(df, rules.limit(0), "text", F.col("c"), {}).collect()} == {"unknown"}
    monkeypatch.setattr(U, "MAX_TERMS", 10)
    with pytest.raises(ValueError):
        U.matched(df, rules, "text")

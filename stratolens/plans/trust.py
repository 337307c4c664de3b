"""Trust of evidence, what counts as evidence, and rules that decide about assets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..operators import ordered as O
from .base import Tables, query
from .search import NORM, SQL_FIRST, SQL_KEYWORDS, SQL_TERMS

TRUSTED = ("observed", "detected", "aligned")


def vision_trust(generated_by: Column, tracking: Column, method: Column) -> Column:
    """From what made a segment's visual evidence."""
    weak = generated_by.contains("color-motion") | generated_by.contains("coarse-profile") | (method == "color_motion_heuristic")
    return F.when(generated_by.isNull() | (generated_by == "vision-evidence-unavailable"), "unavailable").when(tracking == "tracked", "detected").when(weak, "heuristic").otherwise("inferred")


def event_trust(trust: Column, event_id: Column, heuristics: Column) -> Column:
    """From an event's own mark, its identifier and what its evidence says."""
    return F.when(trust.isNotNull(), trust).when(event_id.contains("-domain-vlm-"), "detected").when(heuristics.rlike("(?i)heuristic|ontology|estimated|v0"), "heuristic").otherwise("inferred")


def segment_trust(refined: Column, generated_by: Column, events: Column) -> Column:
    """From a segment's refinement, what made it, and its events' trust."""
    any_ = F.exists(events, lambda e: e.isin(*TRUSTED))
    return F.when(refined, "detected").when(generated_by.contains("domain-ontology-heuristic"), "heuristic").when(any_, "detected").otherwise("inferred")


#: What the tables say of a text's provenance.
MADE = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'vision-evidence-unavailable' WHEN 1 THEN 'color-motion-v1' WHEN 2 THEN 'detector' WHEN 4 THEN 'grid' END AS made_by, CASE WHEN n_chars % 7 = 0 THEN 'tracked' ELSE 'idle' END AS tracking, CASE WHEN lang = 'fr' THEN 'color_motion_heuristic' ELSE 'grid' END AS method,
CASE WHEN lang = 'de' THEN 'aligned' END AS mark, source || CASE WHEN doc_id % 4 = 0 THEN '-domain-vlm-1' ELSE '-event-1' END AS event_id, CASE WHEN doc_id % 4 = 1 THEN 'Ontology match' ELSE 'seen' END AS why, n_chars > 4000 AS refined, CASE WHEN doc_id % 6 = 0 THEN 'domain-ontology-heuristic' ELSE 'rules' END AS built_by FROM {0}"""


@query(f"""WITH m AS ({MADE.format('documents')}), e AS (SELECT *, CASE WHEN mark IS NOT NULL THEN mark WHEN contains(event_id, '-domain-vlm-') THEN 'detected' WHEN regexp_matches(why, '(?i)heuristic|ontology|estimated|v0') THEN 'heuristic' ELSE 'inferred' END AS event FROM m)
SELECT doc_id, CASE WHEN made_by IS NULL OR made_by = 'vision-evidence-unavailable' THEN 'unavailable' WHEN tracking = 'tracked' THEN 'detected' WHEN contains(made_by, 'color-motion') OR method = 'color_motion_heuristic' THEN 'heuristic' ELSE 'inferred' END AS vision, event,
CASE WHEN refined THEN 'detected' WHEN built_by = 'domain-ontology-heuristic' THEN 'heuristic' WHEN event IN ('observed', 'detected', 'aligned') THEN 'detected' ELSE 'inferred' END AS segment, CASE WHEN event IN ('observed', 'detected', 'aligned') THEN 1 ELSE 0 END AS trusted_events FROM e""")
def trust_inference(t: Tables):
    t_ = t.documents.selectExpr(*[c.strip() for c in _columns(MADE)])
    m = t_.withColumn("events", F.array(event_trust(F.col("mark"), F.col("event_id"), F.col("why"))))
    kept = F.size(F.filter("events", lambda e: e.isin(*TRUSTED)))
    return m.select("doc_id", vision_trust(F.col("made_by"), F.col("tracking"), F.col("method")).alias("vision"), F.get("events", F.lit(0)).alias("event"), segment_trust(F.col("refined"), F.col("built_by"), F.col("events")).alias("segment"), kept.alias("trusted_events"))


def _columns(select: str) -> list[str]:
    """The columns of a flat SELECT."""
    body, out, depth = select.removeprefix("SELECT ").split(" FROM {0}")[0], [""], 0
    for word in body.replace("\n", " ").split(" "):
        depth += (word == "CASE") - (word.rstrip(",") == "END")
        out[-1] += f" {word}"
        if word.endswith(",") and not depth:
            out[-1] = out[-1].rstrip(",")
            out.append("")
    return out


@query("""WITH g AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 8), e AS (SELECT o_custkey AS asset, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, g.* FROM customer, g),
r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM e) SELECT asset, o_orderkey AS evidence, rank FROM r WHERE rank <= 8""")
def knowledge_selection(t: Tables):
    """The eight surest pieces of evidence an asset: its own, and those of no asset. Of the latter only the first eight of all can count."""
    own = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("evidence"), "o_totalprice")
    free = t.orders.filter("o_orderstatus = 'P'").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(8).select(F.col("o_orderkey").alias("evidence"), "o_totalprice")
    every = own.unionByName(t.customer.select(F.col("c_custkey").alias("asset")).crossJoin(F.broadcast(free)))  # eight rows
    return O.top_per_group(every, ["asset"], 8, [F.col("o_totalprice").desc(), F.col("evidence")], "evidence", dealt=True).select("asset", "evidence", "rank")


def conjunctive(df: DataFrame, wanted: Mapping[str | tuple[str, ...], object]) -> DataFrame:
    """Rows that meet every given condition: a column equals the value, or one of several columns does. Conditions without a value don't count."""
    some = [reduce(lambda a, b: a | b, [F.col(c) == v for c in ((k,) if isinstance(k, str) else k)]) for k, v in wanted.items() if v is not None and v != ""]
    return reduce(lambda d, c: d.filter(c), some, df)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND (l_partkey = 7 OR l_suppkey = 7)")
def tracking_filter(t: Tables):
    rows = conjunctive(t.lineitem, {"l_returnflag": "R", ("l_partkey", "l_suppkey"): 7, "l_linestatus": None})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def like_any(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """Whether any term is in any of the columns, whatever the case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(x.lower()), F.lit(False)) for c in columns for x in terms])


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%small%' OR lower(p_type) LIKE '%small%' OR lower(p_brand) LIKE '%small%' OR lower(p_name) LIKE '%#1%' OR lower(p_type) LIKE '%#1%' OR lower(p_brand) LIKE '%#1%'")
def multi_column_like(t: Tables):
    return t.part.filter(like_any(["p_name", "p_type", "p_brand"], ["Small", "#1"])).select("p_partkey", "p_name")


# What a screen text must be to count, by language, and names of channels.
OVERLAY = r"(?i)^(?:MBC|KBS|SBS|JTBC|TVN|TVING|ENA|MNET|OCN|NETFLIX)$|^\d{1,2}:\d{2}$"
NAMES = r"^[A-Z][A-Za-z]{2,}(?:\s+[A-Z][A-Za-z]{2,}){0,3}$"
WRITTEN = "[가-힣\\u3040-\\u30ff\\u3400-\\u9fff]"


def useful_screen_text(text: Column, confidence: Column, korean: Column) -> Column:
    """Whether a box of screen text is kept: floors of confidence by language, and the look of names, clocks and channels in others'."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    overlay = clean.rlike(OVERLAY) | clean.rlike(NAMES)
    hangul = clean.rlike("[가-힣]")
    shape = (F.length(clean).between(1, 80)) & clean.rlike(f"[A-Za-z0-9]|{WRITTEN}")
    return shape & F.when(korean, F.when(hangul, confidence >= 0.28).otherwise((confidence >= 0.72) & overlay)).otherwise(confidence >= 0.25)


def ascii_junk(text: Column) -> Column:
    """Whether a token is noise: no letters, drawing signs, letters mixed with digits, or capitals with hardly a vowel."""
    bare = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    vowels = F.length(F.regexp_replace(bare, "(?i)[^AEIOUY]", "")) / F.greatest(F.lit(1), F.length(F.regexp_replace(bare, "[^A-Za-z]", "")))
    noise = (F.length(bare) == 0) | text.rlike(r"[|$?{}\[\]~]") | (bare.rlike("^[A-Z0-9]{4,}$") & ~bare.rlike("(?i)[AEIOUY]")) | (bare.rlike("[A-Za-z]") & bare.rlike(r"\d") & (F.length(bare) <= 8)) | (bare.rlike("^[A-Z]{4,}$") & (vowels < 0.28))
    return ~text.rlike(WRITTEN) & noise


@query(r"""WITH x AS (SELECT p_partkey, p_size / 50 AS conf, p_partkey % 2 = 1 AS korean, unnest([p_brand, p_type, upper(p_name), p_name, '12:30', 'kbs', 'Nation Team', 'STRNGTH', '|x|', '생일 ' || p_name]) AS t FROM part),
b AS (SELECT *, regexp_replace(t, '[^A-Za-z0-9]', '', 'g') AS bare, regexp_full_match(t, '(?i)(?:MBC|KBS|SBS|JTBC|TVN|TVING|ENA|MNET|OCN|NETFLIX)|\d{1,2}:\d{2}') OR regexp_full_match(t, '[A-Z][A-Za-z]{2,}(?:\s+[A-Z][A-Za-z]{2,}){0,3}') AS overlay, contains(t, '생') AS hangul FROM x)
SELECT p_partkey, t AS token, length(t) <= 80 AND regexp_matches(t, '[A-Za-z0-9]') AND CASE WHEN korean THEN CASE WHEN hangul THEN conf >= 0.28 ELSE conf >= 0.72 AND overlay END ELSE conf >= 0.25 END AS useful,
NOT hangul AND (length(bare) = 0 OR regexp_matches(t, '[|$?{}\[\]~]') OR (regexp_full_match(bare, '[A-Z0-9]{4,}') AND NOT regexp_matches(bare, '(?i)[AEIOUY]')) OR (regexp_matches(bare, '[A-Za-z]') AND regexp_matches(bare, '\d') AND length(bare) <= 8) OR (regexp_full_match(bare, '[A-Z]{4,}') AND length(regexp_replace(bare, '(?i)[^AEIOUY]', '', 'g')) / greatest(1, length(regexp_replace(bare, '[^A-Za-z]', '', 'g'))) < 0.28)) AS junk FROM b""")
def screen_text_filter(t: Tables):
    tokens = F.array("p_brand", "p_type", F.upper("p_name"), "p_name", F.lit("12:30"), F.lit("kbs"), F.lit("Nation Team"), F.lit("STRNGTH"), F.lit("|x|"), F.concat(F.lit("생일 "), "p_name"))
    x = t.part.select("p_partkey", (F.col("p_size") / 50).alias("conf"), (F.col("p_partkey") % 2 == 1).alias("korean"), F.explode(tokens).alias("token"))
    return x.select("p_partkey", "token", useful_screen_text(F.col("token"), F.col("conf"), F.col("korean")).alias("useful"), ascii_junk(F.col("token")).alias("junk"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ['metadata:catalog-only', 'person'] WHEN doc_id % 4 = 0 THEN ['face-close', lang] ELSE [lang, source] END AS tags, n_chars % 3 AS players, e.vec_id IS NOT NULL AS seen FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id)
SELECT doc_id, NOT list_contains(tags, 'metadata:catalog-only') AND seen AND (len(list_filter(tags, lambda x: x IS NOT NULL AND regexp_matches(x, '(?i)performer|actor|actress|person|face'))) > 0 OR players > 0) AS evidence, len(list_filter(tags, lambda x: x IS NOT NULL AND regexp_matches(x, '(?i)performer|actor|actress|person|metadata:people'))) > 0 OR players > 1 AS candidate FROM d""")
def appearance_predicates(t: Tables):
    """Evidence of persons needs local pictures and a cue of a person; candidates need a cue alone."""
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("seen"))
    tags = F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("metadata:catalog-only"), F.lit("person"))).when(F.col("doc_id") % 4 == 0, F.array(F.lit("face-close"), "lang")).otherwise(F.array("lang", "source"))
    d = t.documents.select("doc_id", "lang", "source", (F.col("n_chars") % 3).alias("players")).join(v, "doc_id", "left").select("doc_id", F.array_compact(tags).alias("tags"), "players", F.coalesce("seen", F.lit(False)).alias("seen"))
    cue = lambda p: F.exists("tags", lambda x: x.rlike(f"(?i){p}"))
    evidence = ~F.array_contains("tags", "metadata:catalog-only") & F.col("seen") & (cue("performer|actor|actress|person|face") | (F.col("players") > 0))
    return d.select("doc_id", evidence.alias("evidence"), (cue("performer|actor|actress|person|metadata:people") | (F.col("players") > 1)).alias("candidate"))


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN ' Total' WHEN 1 THEN 'TEAM ' WHEN 2 THEN 'player' ELSE s_name END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'scorers' WHEN 1 THEN 'cards' ELSE 'attendance' END AS kind, s_acctbal FROM supplier),
k AS (SELECT * FROM s WHERE lower(trim(name)) NOT IN ('total', 'team', 'player')) SELECT s_suppkey, kind, 'goals' AS metric, round(s_acctbal / 100, 2) AS value FROM k WHERE kind = 'scorers' UNION ALL SELECT s_suppkey, kind, 'assists', round(s_acctbal / 200, 2) FROM k WHERE kind = 'scorers'
UNION ALL SELECT s_suppkey, kind, 'yellow_cards', round(abs(s_acctbal) / 500, 2) FROM k WHERE kind = 'cards' UNION ALL SELECT s_suppkey, kind, 'average_attendance', round(s_acctbal, 2) FROM k WHERE kind = 'attendance'""", value="DOUBLE")
def stat_file_facts(t: Tables):
    """Facts by the kind of file a row is from; rows that are headings or sums go."""
    name = F.when(F.col("s_suppkey") % 10 == 0, " Total").when(F.col("s_suppkey") % 10 == 1, "TEAM ").when(F.col("s_suppkey") % 10 == 2, "player").otherwise(F.col("s_name"))
    kind = F.element_at(F.array(F.lit("scorers"), F.lit("cards"), F.lit("attendance")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    fact = lambda k, m, v: F.when(F.col("kind") == k, F.struct(F.lit(m).alias("metric"), F.round(v, 2).alias("value")))
    b = F.col("s_acctbal")
    facts = F.array_compact(F.array(fact("scorers", "goals", b / 100), fact("scorers", "assists", b / 200), fact("cards", "yellow_cards", F.abs(b) / 500), fact("attendance", "average_attendance", b)))
    s = t.supplier.withColumns({"name": name, "kind": kind}).filter(~F.lower(F.trim("name")).isin("total", "team", "player"))
    return s.select("s_suppkey", "kind", F.explode(facts).alias("f")).select("s_suppkey", "kind", "f.metric", "f.value")


# Tags that a release needs, tags that block one, and words that ask for a review.
REQUIRED = ("age-verified", "performer-id-verified", "consent-contract", "contract-explained", "cooling-period-1m", "publication-delay-4m", "performer-preview", "revocation-window-tracked", "takedown-ready", "mosaic-reviewed", "rights-documented")
BLOCK = ("minor-risk", "age-unverified", "consent-withdrawn", "takedown-requested", "unmosaiced", "illegal-source")
REVIEW = ("under 18", "underage", "minor", "child", "juvenile", "未成年", "児童", "18歳未満", "年齢未確認", "同意撤回", "削除請求", "配信停止", "モザイクなし", "無修正")


@query(f"""WITH d AS (SELECT doc_id, [x FOR x, i IN {list(REQUIRED)!r} IF doc_id % 3 = 0 OR (doc_id + i) % 5 <> 0] AS tags, CASE WHEN doc_id % 11 = 0 THEN [{list(BLOCK)!r}[1 + doc_id % 6]] ELSE [] END AS blocks, [x FOR x IN {list(REVIEW)!r} IF contains(lower(text), x)] AS words FROM documents)
SELECT doc_id, {len(REQUIRED)} - len(tags) AS missing, len(blocks) AS blockers, len(words) AS review_words, CASE WHEN len(blocks) > 0 THEN 'blocked' WHEN len(tags) < {len(REQUIRED)} OR len(words) > 0 THEN 'review_required' ELSE 'metadata_complete' END AS status FROM d""")
def compliance_rules(t: Tables):
    """Blocking tags come before what is missing or needs a review, and both before completeness."""
    need, block = (F.array(*[F.lit(x) for x in xs]) for xs in (REQUIRED, BLOCK))
    tags = F.filter(need, lambda x, i: (F.col("doc_id") % 3 == 0) | ((F.col("doc_id") + i + 1) % 5 != 0))
    tags = F.concat(tags, F.when(F.col("doc_id") % 11 == 0, F.array(F.element_at(block, (F.col("doc_id") % 6 + 1).cast("int")))).otherwise(F.array().cast("array<string>")))
    words = F.filter(F.array(*[F.lit(x) for x in REVIEW]), lambda x: F.contains(F.col("low"), x))
    d = t.documents.select("doc_id", tags.alias("tags"), F.lower("text").alias("low"))
    d = d.select("doc_id", F.size(F.array_except(need, "tags")).alias("missing"), F.size(F.array_intersect("tags", block)).alias("blockers"), F.size(words).alias("review_words"))
    status = F.when(F.col("blockers") > 0, "blocked").when((F.col("missing") > 0) | (F.col("review_words") > 0), "review_required").otherwise("metadata_complete")
    return d.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("missing", "blockers", "review_words")], status.alias("status"))


@query("""WITH s AS (SELECT conv_id, turn, trim(unnest(regexp_split_to_array(lower(text), '[.!?\\n]+'))) AS s FROM conversations), n AS (SELECT conv_id, turn, trim(regexp_replace(s, '[^a-zà-öø-ÿœ0-9]+', ' ', 'g')) AS n FROM s) SELECT conv_id, turn, count(*) AS kept FROM n WHERE length(n) >= 3 AND n NOT IN ('scene', 'moment') AND NOT regexp_full_match(n, '[0-9]+') GROUP BY ALL""")
def weak_summaries(t: Tables):
    """Sentences that say something: three letters at least, no bare number, not the word for a scene."""
    s = t.conversations.select("conv_id", "turn", F.explode(F.split(F.lower("text"), "[.!?\n]+")).alias("s"))
    n = s.select("conv_id", "turn", F.trim(F.regexp_replace("s", "[^a-zà-öø-ÿœ0-9]+", " ")).alias("n"))
    return n.filter((F.length("n") >= 3) & ~F.col("n").isin("scene", "moment") & ~F.col("n").rlike("^[0-9]+$")).groupBy("conv_id", "turn").agg(F.count("*").alias("kept"))


@query("""SELECT l_suppkey, round(count(*) FILTER (l_returnflag = 'R') / greatest(1, count(*)), 3) AS ratio, greatest(0, least(100, round(avg(l_quantity) * 3 - 20))) AS score, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY l_suppkey""")
def ratio_and_score(t: Tables):
    """A share that is never divided by nothing, a score held between 0 and 100, a sum to four places."""
    g = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"), F.avg("l_quantity").alias("q"), F.sum("l_tax").alias("tax"))
    return g.select("l_suppkey", F.round(F.col("r") / F.greatest(F.lit(1), "n"), 3).alias("ratio"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.col("q") * 3 - 20))).alias("score"), F.round("tax", 4).alias("tax"))


@query("""SELECT o_orderkey, round(least(0.99, o_totalprice / 500000) + CASE WHEN o_custkey = 7 THEN 5 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 0 END + CASE WHEN year(o_orderdate) IN (1995, 1996) THEN 3 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END
+ 0.35 * (CAST(contains(lower(o_orderpriority), 'high') AS INT) + CAST(contains(lower(o_orderpriority), 'urgent') AS INT)) + CASE WHEN o_orderstatus = 'P' THEN 0.4 ELSE 0 END, 3) AS rank FROM orders""", rank="DOUBLE")
def knowledge_evidence_rank(t: Tables):
    """Confidence, with what the question names: the player, the competition, seasons, the kind of evidence, its terms, and whether it is the video's own."""
    yes = lambda c, w: F.when(c, w).otherwise(0.0)
    low = F.lower("o_orderpriority")
    score = F.least(F.lit(0.99), F.col("o_totalprice") / 500000) + yes(F.col("o_custkey") == 7, 5.0) + yes(F.col("o_orderpriority") == "1-URGENT", 3.0) + yes(F.year("o_orderdate").isin(1995, 1996), 3.0)
    score = score + yes(F.col("o_orderstatus") == "F", 2.0) + 0.35 * (low.contains("high").cast("int") + low.contains("urgent").cast("int")) + yes(F.col("o_orderstatus") == "P", 0.4)
    return t.orders.select("o_orderkey", F.round(score, 3).alias("rank"))


@query("""SELECT d.doc_id, 12 * CAST(coalesce(tox = 0, FALSE) AS INT) + 4 * CAST(contains(text, '|') AS INT) + 8 * CAST(coalesce(q = 1, FALSE) AS INT) + 4 * CAST(lang IS NOT NULL AND lang <> 'en' AS INT) + 3 * CAST(coalesce(trim(text), '') <> '' AS INT) + CAST(source IS NOT NULL AS INT) + 1 AS score
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS tox FROM labels GROUP BY doc_id) l USING (doc_id)""")
def segment_summary_score(t: Tables):
    l = t.labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("tox"))
    yes = lambda c, w: F.when(c, w).otherwise(0)
    score = yes(F.col("tox") == 0, 12) + yes(F.col("text").contains("|"), 4) + yes(F.col("q") == 1, 8) + yes(F.col("lang") != "en", 4) + yes(F.trim("text") != "", 3) + yes(F.col("source").isNotNull(), 1) + 1
    return t.documents.select("doc_id", "text", "lang", "source").join(l, "doc_id", "left").select("doc_id", score.alias("score"))


@query("""WITH s AS (SELECT event_id, value / 1000 AS speed, value > 40 AS near, minute(ts) / 60 AS y, hour(ts) >= 16 AS attack, event_type = 'click' AS same, user_id % 2 = 0 AS reliable FROM events WHERE event_type <> 'signup')
SELECT event_id, CASE WHEN attack AND y > 0.5e0 THEN 'through_ball_receive' ELSE 'pass_receive' END AS label, round(least(0.92e0, CASE WHEN reliable THEN 0.44e0 ELSE 0.36e0 END + y * 0.18e0 + least(0.14e0, speed * 1.4) + CASE WHEN same THEN CASE WHEN reliable THEN 0.08e0 ELSE 0.03e0 END ELSE 0 END + CASE WHEN attack THEN 0.08e0 ELSE 0 END + CASE WHEN y > 0.5e0 THEN CASE WHEN reliable THEN 0.08e0 ELSE 0.04e0 END ELSE 0 END), 6) AS confidence FROM s WHERE near AND speed >= 0.025e0""", confidence="DOUBLE")
def tracking_receive(t: Tables):
    """A moving ball near a player is received; deep in the field and along the attack it came through the defence."""
    s = t.events.filter("event_type <> 'signup'").select("event_id", (F.col("value") / 1000).alias("speed"), (F.col("value") > 40).alias("near"), (F.minute("ts") / 60).alias("y"), (F.hour("ts") >= 16).alias("attack"), (F.col("event_type") == "click").alias("same"), (F.col("user_id") % 2 == 0).alias("reliable"))
    yes = lambda c, a, b=0.0: F.when(c, a).otherwise(b)
    along = F.col("y") > 0.5
    conf = yes(F.col("reliable"), 0.44, 0.36) + F.col("y") * 0.18 + F.least(F.lit(0.14), F.col("speed") * 1.4) + yes(F.col("same"), yes(F.col("reliable"), 0.08, 0.03)) + yes(F.col("attack"), 0.08) + yes(along, yes(F.col("reliable"), 0.08, 0.04))
    return s.filter("near and speed >= 0.025").select("event_id", F.when(F.col("attack") & along, "through_ball_receive").otherwise("pass_receive").alias("label"), F.round(F.least(F.lit(0.92), conf), 6).alias("confidence"))


@query("""WITH p AS (SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 1000 ELSE 0 END + CASE WHEN coalesce(max(year(o_orderdate)), 0) >= 1998 THEN 200 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 25 ELSE 0 END + count(DISTINCT year(o_orderdate)) + count(DISTINCT o_orderpriority) AS priority FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment, c_acctbal)
SELECT c_custkey, priority, c_name FROM p""")
def player_priority(t: Tables):
    """Own players first, then recent ones, those with a position, and those with more seasons and names."""
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.year("o_orderdate")).alias("last"), F.count_distinct(F.year("o_orderdate")).alias("seasons"), F.count_distinct("o_orderpriority").alias("aliases"))
    j = t.customer.join(o, F.col("c_custkey") == F.col("k"), "left")
    yes = lambda c, w: F.when(c, w).otherwise(0)
    score = yes(F.col("c_mktsegment") == "BUILDING", 1000) + yes(F.col("last") >= 1998, 200) + yes(F.col("c_acctbal") > 0, 25) + F.coalesce("seasons", F.lit(0)) + F.coalesce("aliases", F.lit(0))
    return j.select("c_custkey", score.alias("priority"), "c_name").orderBy(F.col("priority").desc(), "c_name")


SQL_CASES = f"(SELECT item_id, {SQL_FIRST.format('k')} AS k FROM (SELECT item_id, {SQL_KEYWORDS} AS k FROM benchmark))"


@query(f"""WITH m AS (SELECT item_id, k[1] AS home, k[2] AS away, k[3:] AS players FROM {SQL_CASES} WHERE len(k) >= 2), d AS (SELECT doc_id, lang, list_distinct({SQL_TERMS}) AS t FROM documents),
s AS (SELECT doc_id, item_id, list_contains(t, home) AS h, list_contains(t, away) AS a, len(list_intersect(players, t)) AS p, lang FROM d, m),
x AS (SELECT *, CASE WHEN h THEN 2.3 ELSE 0 END + CASE WHEN a THEN 2.3 ELSE 0 END + CASE WHEN h AND a THEN 1.2 ELSE 0 END + least(3.2, 1.2 * least(4, p)) + CASE WHEN lang = 'en' THEN 0.6 ELSE 0 END AS score FROM s WHERE h OR a OR p > 0)
SELECT doc_id, item_id, round(score, 4) AS score, round(least(0.96, score / 8), 2) AS confidence, CASE WHEN score >= 6 THEN 'confirmed' WHEN score >= 3.2 THEN 'candidate' ELSE 'unknown' END AS status FROM x WHERE score >= 2.5""", score="DOUBLE", confidence="DOUBLE")
def match_text_resolution(t: Tables):
    """Texts against matches by the names they hold, through an inverted index of home, away and players: only pairs that share a name meet."""
    k = t.benchmark.select("item_id", X.keywords(F.col("text"), None).alias("k")).filter("size(k) >= 2")
    name = lambda role, c: F.transform(c, lambda x: F.struct(F.lit(role).alias("role"), x.alias("term")))
    names = F.concat(name("home", F.slice("k", 1, 1)), name("away", F.slice("k", 2, 1)), name("player", F.slice("k", 3, F.size("k"))))
    m = k.select("item_id", F.explode(names).alias("n")).select("item_id", "n.role", "n.term")
    d = t.documents.select("doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("en"), F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term"))
    n = lambda role: F.count_if(F.col("role") == role)
    s = d.join(m, "term").groupBy("doc_id", "item_id").agg(n("home").alias("h"), n("away").alias("a"), n("player").alias("p"), F.first("en").alias("en"))
    score = 2.3 * F.col("h") + 2.3 * F.col("a") + F.when((F.col("h") > 0) & (F.col("a") > 0), 1.2).otherwise(0.0) + F.least(F.lit(3.2), 1.2 * F.least(F.lit(4), "p")) + F.when(F.col("en"), 0.6).otherwise(0.0)
    s = s.withColumn("score", score).filter("score >= 2.5")
    status = F.when(F.col("score") >= 6, "confirmed").when(F.col("score") >= 3.2, "candidate").otherwise("unknown")
    return s.select("doc_id", "item_id", F.round("score", 4).alias("score"), F.round(F.least(F.lit(0.96), F.col("score") / 8), 2).alias("confidence"), status.alias("status"))


@query("""WITH c AS (SELECT l_suppkey AS player, l_orderkey AS asset, max(l_discount) AS best, count(*) AS n FROM lineitem GROUP BY ALL) SELECT player, count(*) AS assets, sum(n) AS mentions, arg_max(asset, (best, -asset)) AS best_asset, round(max(best), 4) AS confidence, count(*) FILTER (best >= 0.08) AS strong FROM c GROUP BY player""", mentions="BIGINT")
def identity_coverage(t: Tables):
    """In how many assets a player is, how often, and where most surely."""
    c = t.lineitem.groupBy(F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("asset")).agg(F.max("l_discount").alias("best"), F.count("*").alias("n"))
    g = c.groupBy("player").agg(F.count("*").alias("assets"), F.sum("n").alias("mentions"), F.max(F.struct("best", (-F.col("asset")).alias("a"))).alias("b"), F.count_if(F.col("best") >= 0.08).alias("strong"))
    return g.select("player", "assets", "mentions", (-F.col("b.a")).alias("best_asset"), F.round("b.best", 4).alias("confidence"), "strong")

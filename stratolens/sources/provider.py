"""Imports of a provider's matches, lineups and events by its list of competitions: only the files of the chosen seasons are opened."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.staging import stored

MATCH = "match_id long, match_date string, home_team string, away_team string, home_score int, away_score int"
EVENT = "match_id long, event_id long, minute int, type string, team string, player_id long, player string, detail string"
LINEUP = "match_id long, team string, player_id long, player string, shirt int"
#: Kinds of events and what they count as; a card's detail starts with its colour.
COUNTED = ("goal", "card", "substitution", "assist")


def plain(c: Column) -> Column:
    """Names and seasons as they are compared: no case, one blank, a slash as a dash."""
    return F.lower(F.trim(F.regexp_replace(F.replace(c, F.lit("/"), F.lit("-")), r"\s+", " ")))


def chosen(competitions: DataFrame, names: Sequence[str] = (), seasons: Sequence[str] = ()) -> DataFrame:
    """Rows of competitions (competition_id, season_id, competition, season, available) whose names and seasons are asked for (none: all), with `nth` from 1 by falling `available`, then name, season and ids; rows without an id go, repeated ones count once. A provider's list has a row a season of a competition, so one window orders it."""
    out = competitions.filter("competition_id is not null and season_id is not null")
    for c, asked in (("competition", names), ("season", seasons)):
        if asked:
            wanted = competitions.sparkSession.createDataFrame([(x,) for x in asked], "asked string").select(plain(F.col("asked")).alias("_asked")).distinct()
            out = out.join(wanted, plain(F.col(c)) == F.col("_asked"), "left_semi")
    out = out.groupBy("competition_id", "season_id").agg(F.max(F.struct("available", "competition", "season")).alias("r")).select("competition_id", "season_id", "r.*")
    order = "available DESC NULLS LAST, competition, season, competition_id, season_id"
    return out.withColumn("nth", F.expr(f"CAST(row_number() OVER (ORDER BY {order}) AS BIGINT)"))


class Files:
    """The files of one kind below a root, by a pattern such as events/{match_id}.json (a file a match) or matches/competition_id={competition_id}/season_id={season_id} (a folder a season)."""

    def __init__(self, spark: SparkSession, root: str, pattern: str, most: int = 100_000):
        self.spark, self.root, self.pattern, self.most = spark, root.rstrip("/"), pattern, most
        self.top = pattern.split("/")[0]
        self.parts = re.split(r"\{(\w+)\}", pattern)  # text, column, text, ...

    @property
    def columns(self) -> list[str]:
        return self.parts[1::2]

    def _key(self) -> Column:
        return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(self.parts)])

    def _keys_of(self, path: Column) -> Column:
        """What a file may be asked for as: itself or its folder."""
        rest = F.concat(F.lit(f"{self.top}/"), F.element_at(F.split(path, f"/{re.escape(self.top)}/"), -1))
        return F.array(rest, F.regexp_replace(rest, "/[^/]*$", ""))

    def _place(self) -> Column:
        """A row's file below the kind's folder."""
        return F.substring_index(F.col("_metadata.file_path"), f"/{self.top}/", -1)

    def _values(self, place: Column) -> dict[str, Column]:
        """The pattern's columns in a place that split() has found, each up to the text that follows it; cut without patterns, as every row is."""
        out, rest = {}, F.substr(place, F.lit(len(self.parts[0].removeprefix(f"{self.top}/")) + 1))
        for c, text in zip(self.parts[1::2], self.parts[2::2]):
            out[c] = F.substring_index(rest, text or "/", 1)
            rest = F.substr(rest, F.length(out[c]) + len(text) + 1)
        return out

    def split(self, rows: DataFrame) -> tuple[list[str], DataFrame]:
        """Paths of the files that rows (with the pattern's columns) ask for, and (file) that they ask for in vain. Paths are listed without being read; more than `most` are an error, as a read's paths are on the driver."""
        asked = rows.select(self._key().alias("file")).dropna().distinct()
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.root}/{self.top}").select("path", F.explode(self._keys_of(F.col("path"))).alias("file"))
        found = stored(there.join(asked, "file", "left_semi"))
        paths = [r["path"] for r in found.select("path").distinct().limit(self.most + 1).collect()]
        if len(paths) > self.most:
            raise ValueError(f"more than {self.most} files of {self.pattern}: choose fewer seasons at a time")
        return sorted(paths), asked.join(found, "file", "left_anti")

    def read(self, rows: DataFrame, schema: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
        """The rows of the files that rows ask for, with the pattern's columns from the file's place where schema hasn't got them or the row has none, and the files that are missing. Fields that a file lacks are null, others that it has are passed over, and rows that aren't objects or have a field of another type go. lines: a row a line, else an array or object a file."""
        paths, missing = self.split(rows)
        if not paths:
            return self.spark.createDataFrame([], schema).select("*", *[F.lit(None).cast("long").alias(c) for c in self.columns if c not in schema.split()]), missing
        df = self.spark.read.schema(schema).json(paths, multiLine=not lines, mode="DROPMALFORMED")
        df = df.select("*", self._place().alias("_own"))
        for c, at in self._values(F.col("_own")).items():
            df = df.withColumn(c, F.coalesce(F.col(c), at.try_cast("long")) if c in df.columns else at.try_cast("long"))
        return df.drop("_own"), missing


def standings(matches: DataFrame) -> DataFrame:
    """matches (competition, season, MATCH's columns) -> competition, season, team, played, wins, draws, losses, goals_for, goals_against. Matches without both teams and scores don't count; a match that comes twice counts once."""
    m = matches.dropna(subset=["match_id", "home_team", "away_team", "home_score", "away_score"]).groupBy("match_id").agg(F.max(F.struct("competition", "season", "home_team", "away_team", "home_score", "away_score")).alias("m")).select("m.*")
    side = lambda a, b: F.struct(F.col(f"{a}_team").alias("team"), F.col(f"{a}_score").alias("own"), F.col(f"{b}_score").alias("other"))
    s = m.select("competition", "season", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("competition", "season", "s.*")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    own, other = F.col("own"), F.col("other")
    return s.groupBy("competition", "season", "team").agg(F.count("*").alias("played"), n(own > other).alias("wins"), n(own == other).alias("draws"), n(own < other).alias("losses"), F.sum("own").cast("long").alias("goals_for"), F.sum("other").cast("long").alias("goals_against"))


def facts(table: DataFrame) -> DataFrame:
    """Standings as (competition, season, team, metric, value)."""
    metrics = [c for c in table.columns if c not in ("competition", "season", "team")]
    return table.unpivot(["competition", "season", "team"], metrics, "metric", "value")


def activities(matches: DataFrame, lineups: DataFrame, events: DataFrame) -> DataFrame:
    """A row a match and player: competition, season, match_id, player_id, player, team, shirt, listed (in a lineup), goals, cards, substitutions, assists, first_minute, last_minute. Players of events that no lineup lists are there too; events and lineups of other matches, or without a match or player, aren't. Names are the smallest given, a lineup's first. Events of one match and event_id count once, as the smallest of them; those without event_id count each."""
    rest = ["player_id", "player", "team", "type", "minute"]
    once = events.filter("event_id is not null").groupBy("match_id", "event_id").agg(F.min(F.struct(*rest)).alias("e")).select("match_id", "e.*").unionByName(events.filter("event_id is null").select("match_id", *rest))
    of = lambda df: df.filter("match_id is not null and player_id is not null")
    none = lambda kind: F.lit(None).cast(kind)
    a = of(lineups).select("match_id", "player_id", F.struct(F.lit(0).alias("k"), "player", "team").alias("who"), "shirt", F.lit(True).alias("listed"), none("string").alias("type"), none("int").alias("minute"))
    b = of(once).select("match_id", "player_id", F.struct(F.lit(1).alias("k"), "player", "team").alias("who"), none("int").alias("shirt"), F.lit(False).alias("listed"), F.lower("type").alias("type"), "minute")
    name = lambda c: F.min(F.when(F.col(f"who.{c}").isNotNull(), F.struct("who.k", f"who.{c}")))[c].alias(c)
    counts = [F.count(F.when(F.col("type") == k, 1)).alias(f"{k}s") for k in COUNTED]
    each = a.unionByName(b).groupBy("match_id", "player_id").agg(name("player"), name("team"), F.min("shirt").alias("shirt"), F.max("listed").alias("listed"), *counts, F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"))
    of_match = matches.filter("match_id is not null").groupBy("match_id").agg(F.max(F.struct("competition", "season")).alias("m")).select("match_id", "m.*")
    return of_match.join(each, "match_id").select("competition", "season", *each.columns)


def imported(spark: SparkSession, root: str, names: Sequence[str] = (), seasons: Sequence[str] = (), layout: dict[str, str] | None = None, lines: bool = False) -> dict[str, DataFrame]:
    """The import as a whole: `seasons` (chosen), `matches`, `lineups`, `events`, `standings`, `facts`, `activities`, and `missing` (file), the files that the list speaks of and the folder hasn't got.

    The list is read first, then the matches of the chosen seasons, then what those matches have; no other file is opened. layout
    has other patterns for matches, lineups and events. What is read goes to the shared folder once, so a lost executor reads
    files again, not the provider's list.
    """
    layout = {"matches": "matches/{competition_id}/{season_id}.json", "lineups": "lineups/{match_id}.json", "events": "events/{match_id}.json"} | (layout or {})
    lists = spark.read.schema("competition_id long, season_id long, competition string, season string, available string").json(f"{root.rstrip('/')}/competitions.json", multiLine=not lines)
    picked = stored(chosen(lists, names, seasons))
    of = picked.select("competition_id", "season_id", "competition", "season")
    matches, no_matches = Files(spark, root, layout["matches"]).read(of, MATCH, lines)
    matches = stored(matches.join(of, ["competition_id", "season_id"]))
    lineups, no_lineups = Files(spark, root, layout["lineups"]).read(matches, LINEUP, lines)
    events, no_events = Files(spark, root, layout["events"]).read(matches, EVENT, lines)
    lineups, events = stored(lineups), stored(events)
    table = standings(matches)
    return {"seasons": picked, "matches": matches, "lineups": lineups, "events": events, "standings": table, "facts": facts(table), "activities": activities(matches, lineups, events), "missing": no_matches.unionByName(no_lineups).unionByName(no_events)}

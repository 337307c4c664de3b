"""Imports of a provider's files: what is chosen, what is opened, what is missing, and what comes of it."""

import json

import pytest
from pyspark.sql import functions as F

from stratolens.sources import provider as P


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("provider")

    def put(path, value):
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(value if isinstance(value, str) else json.dumps(value))

    row = lambda c, s, name, season, when: {"competition_id": c, "season_id": s, "competition": name, "season": season, "available": when, "more": 1}
    put("competitions.json", [row(1, 10, "First  League", "2019/2020", "2021-01-01"), row(1, 11, "First League", "2020-2021", "2022-01-01"), row(2, 10, "Cup", "2019-2020", None), row(1, 11, "First League", "2020-2021", "2022-01-01"), row(None, 3, "First League", "2020-2021", None), row(1, 12, "first league", "2021/2022", "2023")])
    match = lambda i, h, a, x, y: {"match_id": i, "home_team": h, "away_team": a, "home_score": x, "away_score": y, "city": "new field"}
    put("matches/1/10.json", [match(100, "A", "B", 2, 1), match(101, "B", "A", 0, 0), match(102, "A", None, 1, 1), match(103, "A", "C", None, 2), match(100, "A", "B", 2, 1)])
    put("matches/1/11.json", [match(110, "A", "C", 0, 3), {"match_id": 111}])
    put("matches/2/10.json", "not json")
    put("lineups/100.json", [{"team": "A", "player_id": 7, "player": "Ann", "shirt": 9}, {"team": "B", "player_id": 8, "player": "Bo"}])
    put("lineups/110.json", [])
    put("events/100.json", [{"event_id": 1, "minute": 5, "type": "Goal", "team": "A", "player_id": 7, "player": "X"}, {"event_id": 1, "minute": 5, "type": "Goal", "team": "A", "player_id": 7, "player": "X"}, {"event_id": 2, "minute": 80, "type": "card", "player_id": 9, "player": "Cy"}, {"type": "goal", "player_id": 7}, {"type": "goal", "player_id": 7}, {"event_id": 3, "type": "Goal"}])
    put("events/999.json", "{ broken")
    return str(top)


def test_chosen_seasons(spark, root):
    lists = spark.read.json(f"{root}/competitions.json", multiLine=True)
    got = lambda *a: [(r["competition_id"], r["season_id"]) for r in P.chosen(lists, *a).orderBy("nth").collect()]
    assert got() == [(1, 12), (1, 11), (1, 10), (2, 10)]
    assert got([" first league"], ["2020/2021", "2019-2020"]) == [(1, 11), (1, 10)]
    assert got(["none"]) == []


def test_only_the_files_of_chosen_seasons_are_opened(spark, root):
    out = P.imported(spark, root, ["First League"], ["2019/2020", "2020/2021", "2021/2022"])
    rows = out["matches"].select("competition_id", "season_id", "match_id")
    paths, missing = P.Files(spark, root, "matches/{competition_id}/{season_id}.json").split(out["seasons"])
    assert sorted(p.split("/matches/")[1] for p in paths) == ["1/10.json", "1/11.json"] and [r[0] for r in missing.collect()] == ["matches/1/12.json"]
    opened, _ = P.Files(spark, root, "events/{match_id}.json").split(rows)
    assert [p.split("/")[-1] for p in opened] == ["100.json"]  # neither the broken file of a match that isn't chosen
    frame, _ = P.Files(spark, root, "events/{match_id}.json").read(rows, P.EVENT)
    assert {f.split("/")[-1] for f in frame.inputFiles()} == {"100.json"}
    assert {r[0] for r in out["missing"].collect()} == {"matches/1/12.json", *(f"lineups/{i}.json" for i in (101, 102, 103, 111)), *(f"events/{i}.json" for i in (101, 102, 103, 110, 111))}
    assert sorted(r[0] for r in rows.collect()) == [1] * 7 and {(r["season_id"], r["match_id"]) for r in rows.collect()} == {(10, 100), (10, 101), (10, 102), (10, 103), (11, 110), (11, 111)}
    with pytest.raises(ValueError):
        P.Files(spark, root, "matches/{competition_id}/{season_id}.json", most=1).split(out["seasons"])


@pytest.mark.parametrize("pattern", ["events/{a}.json", "events/a={a}/b={b}", "events/{a}/x{b}.json"])
def test_columns_of_places(spark, tmp_path, pattern):
    """Keys come from the last folder of that name, and no pattern is searched in a row's path."""
    root = tmp_path / "events" / "7.json" / "events" / "root"
    wanted = [(1, 22), (3, 4), (55, 6)] if "{b}" in pattern else [(1, None), (3, None), (55, None)]
    for a, b in wanted:
        at = root / pattern.format(a=a, b=b)
        at = at if at.suffix else at / "part-0.json"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(json.dumps({"v": a * 100}) + "\n")
    rows = spark.createDataFrame([*wanted, (9, 9)], "a long, b long")
    df, missing = P.Files(spark, str(root), pattern).read(rows, "v int", lines=True)
    got = df.withColumn("b", df["b"] if "b" in df.columns else F.lit(None).cast("long")).select("v", "a", "b")
    assert sorted(map(tuple, got.collect())) == sorted((a * 100, a, b) for a, b in wanted) and missing.count() == 1
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_meet_their_orders_once(spark, monkeypatch):
    """Lineups and events are written in one pass."""
    from pyspark.sql import DataFrameWriter

    from stratolens.plans import imports
    from stratolens.plans.base import Tables

    reads, plain = [], DataFrameWriter.json

    def json_(self, *a, **k):
        reads.append(self._df._jdf.queryExecution().optimizedPlan().toString().count("l_linenumber") > 0)
        return plain(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "json", json_)
    root = imports.written(t := Tables(spark, "/root/testdata/sf0.001"))
    assert sum(reads) == 1
    of = lambda kind: spark.read.json(f"{root}/lines/kind={kind}")
    assert of("events").count() == t.lineitem.count() and of("lineups").count() == t.lineitem.filter("l_linenumber % 2 = 0").count()
    assert set(of("events").columns) == {"match_id", "player_id", "player", "event_id", "minute", "type", "competition_id", "season_id"}
    assert set(of("lineups").columns) == {"match_id", "player_id", "player", "shirt", "competition_id", "season_id"}


def test_orders_without_lines(spark, tmp_path):
    from stratolens.plans.registry import QUERIES

    for name in ("orders", "region", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (df.limit(0) if name == "lineitem" else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert QUERIES["provider_import_activities"](spark, str(tmp_path)).collect() == []


def test_what_comes_of_the_files(spark, root):
    out = P.imported(spark, root, ["First League"])
    table = {tuple(r)[1:3]: tuple(r)[3:] for r in out["standings"].collect()}
    assert table == {("2019/2020", "A"): (2, 1, 1, 0, 2, 1), ("2019/2020", "B"): (2, 0, 1, 1, 1, 2), ("2020-2021", "A"): (1, 0, 0, 1, 0, 3), ("2020-2021", "C"): (1, 1, 0, 0, 3, 0)}
    assert {(r["metric"], r["value"]) for r in out["facts"].filter("team = 'C'").collect()} == {("played", 1), ("wins", 1), ("draws", 0), ("losses", 0), ("goals_for", 3), ("goals_against", 0)}
    got = {r["player_id"]: (r["player"], r["team"], r["shirt"], r["listed"], r["goals"], r["cards"], r["first_minute"], r["last_minute"]) for r in out["activities"].collect()}
    assert got == {7: ("Ann", "A", 9, True, 3, 0, 5, 5), 8: ("Bo", "B", None, True, 0, 0, None, None), 9: ("Cy", None, None, False, 0, 1, 80, 80)}


def test_broken_and_missing_files(spark, root):
    out = P.imported(spark, root, ["cup"])
    assert out["matches"].count() == 0 and out["activities"].count() == 0 and out["standings"].count() == 0
    assert P.imported(spark, root, ["nothing"])["missing"].count() == 0

"""Reading files that importers meet: CSV and JSON tables, folders of media, tool logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.parsing import game_seconds


def header_name(name: str) -> str:
    return re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", name.strip().lower()))


def read_csv(spark: SparkSession, path: str, normalise: bool = True) -> DataFrame:
    """A CSV with a header: quotes doubled inside quotes, line ends allowed in them, blank lines skipped; all strings. Names are normalised, repeated ones numbered."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)
    if not normalise:
        return df
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = header_name(c) or "column"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of objects, or of the first array of objects among an object's properties."""
    df = spark.read.json(path, multiLine=True)
    for f in df.schema.fields:
        if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct":
            return df.select(F.explode(f.name).alias("_r")).select("_r.*").toDF(*[header_name(c) for c in f.dataType.elementType.names])
    return df.toDF(*[header_name(c) for c in df.columns])


def read_stat_files(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSON by the path's ending, with the season and league that each file's name states."""
    df = read_json_rows(spark, path) if path.endswith(".json") else read_csv(spark, path)
    name = F.element_at(F.split(F.input_file_name() if path.endswith(".json") else F.col("_metadata.file_path"), "/"), -1)
    if not path.endswith(".json"):
        return df.select("*", F.regexp_extract(name, "(19|20)[0-9]{2}([-_][0-9]{2,4})?", 0).alias("file_season"), F.regexp_extract(F.lower(name), "^([a-z]+)", 1).alias("file_league"))
    return df.withColumn("file_season", F.regexp_extract(name, "(19|20)[0-9]{2}([-_][0-9]{2,4})?", 0)).withColumn("file_league", F.regexp_extract(F.lower(name), "^([a-z]+)", 1))


def scan_media(spark: SparkSession, root: str, endings: tuple[str, ...] = ("mp4", "mov", "mkv", "avi", "webm")) -> DataFrame:
    """path, name, size, modified of the media files below a folder; hidden ones are left out and no contents are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(~F.col("path").rlike(r"/\.[^/]"))


def checksums(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and SHA-256 of each file below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return df.select("path", F.sha2("content", 256).alias("sha256"))


def scene_times(lines: DataFrame, column: str = "value") -> DataFrame:
    """Times of the frames that a scene filter reports in its log: (at)."""
    return lines.select(F.explode(F.regexp_extract_all(column, F.lit(r"pts_time:\s*([0-9.]+)"), 1)).alias("t")).select(F.col("t").cast("double").alias("at"))


def silences(lines: DataFrame, column: str = "value") -> DataFrame:
    """(kind, at) of silence_start and silence_end in a log."""
    marks = F.regexp_extract_all(column, F.lit(r"silence_(?:start|end):\s*-?[0-9.]+"), 0)
    m = lines.select(F.explode(marks).alias("m"))
    return m.select(F.regexp_extract("m", "silence_(start|end)", 1).alias("kind"), F.regexp_extract("m", r"(-?[0-9.]+)$", 1).cast("double").alias("at"))


def predictions(lines: DataFrame, column: str = "value") -> DataFrame:
    """(at_ms, label, confidence) of prediction files, whose list may be the file itself or one of five properties."""
    item = "array<struct<position:string,label:string,confidence:string>>"
    whole = F.when(F.trim(column).startswith("["), F.from_json(column, item))
    named = [F.from_json(F.get_json_object(column, f"$.{k}"), item) for k in ("spots", "predictions", "annotations", "actions", "events")]
    rows = lines.select(F.explode(F.coalesce(whole, *named)).alias("p"))
    return rows.select(F.col("p.position").try_cast("double").alias("at_ms"), F.col("p.label").alias("label"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("p.confidence").try_cast("double"), F.lit(0.0)))).alias("confidence"))


def spots(lines: DataFrame, end_s: float = 0, column: str = "value") -> DataFrame:
    """(position, label, confidence) of prediction files in seconds, by position, falling confidence and label: whatever names they give to the time, the label and the confidence. Positions far past a video's end are milliseconds; rows without a label or a time go."""
    item = "array<map<string,string>>"
    whole = F.when(F.trim(column).startswith("["), F.from_json(column, item))
    named = [F.from_json(F.get_json_object(column, f"$.{k}"), item) for k in ("spots", "predictions", "annotations", "actions", "events")]
    p = lines.select(F.explode(F.coalesce(whole, *named)).alias("p"))
    first = lambda *keys: [F.nullif(F.trim(F.col("p")[k]), F.lit("")) for k in keys]
    at = F.coalesce(*[x.try_cast("double") for x in first("position", "time", "timestamp", "second", "seconds", "start")], game_seconds(F.col("p")["gameTime"]))
    at = F.when((F.lit(end_s) > 0) & (at > end_s + 30), at / 1000).otherwise(at)
    sure = F.coalesce(*[x.try_cast("double") for x in first("confidence", "score", "probability")], F.lit(1.0))
    rows = p.select(F.round(F.greatest(F.lit(0.0), at), 3).alias("position"), F.coalesce(*first("label", "class", "event", "name")).alias("label"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 3).alias("confidence"), at.isNotNull().alias("ok"))
    return rows.filter("ok and label is not null").drop("ok").orderBy("position", F.col("confidence").desc(), "label")

"""Structured Streaming jobs over a folder's events, run with an available-now trigger into Parquet in the shared folder."""

from __future__ import annotations

import tempfile
import uuid


from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; in local mode without that setting a temporary one, on a cluster without it an error."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and (spark.sparkContext.master or "").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(top or tempfile.mkdtemp(prefix='spark-', dir='/tmp')).rstrip('/')}/streams/{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events with a zoned timestamp, which watermarks ask for."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs the stream over what there is. In complete mode the last batch's rows are the result, else all batches' rows; with keys, the rows of the latest batch that has the key."""
    spark, top = df.sparkSession, shared_dir(df.sparkSession)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={n}" if mode != "complete" else f"{top}/out/all")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if not keys:
        return spark.read.schema(df.schema).parquet(f"{top}/out/*")
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, batch long").option("basePath", f"{top}/out").parquet(f"{top}/out")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_b")).select(*[c if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def windowed_counts(spark: SparkSession, sf_dir: str, length: str, slide: str | None = None) -> DataFrame:
    """window_start, event_type, n, total of tumbling or sliding windows. Batches bring the windows that changed, and windows that no event up to a day late can change leave the state."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events(spark, sf_dir).withWatermark("ts", "1 day").groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = run(g.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total")), "update", ["window_start", "event_type"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def sessions(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    """user_id, start, n of runs of events with pauses shorter than the gap. Sessions can't be updated in place, so every batch gives all of them and they stay in the state: for streams that end."""
    g = events(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return run(g.select("user_id", F.col("w.start").alias("start"), "n"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and event_type of the first event of each pair. A pair stays known for ever: the state is a row a pair, and needs no watermark, as pairs that were forgotten would come twice."""
    return run(events(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")


def progress(stream: DataFrame, key: str, value: str) -> DataFrame:
    """The running maximum of each key, kept as state between batches: (key, best, seen)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

    def update(k: tuple, frames, state: GroupState):
        best, seen = state.get if state.exists else (float("-inf"), 0)
        for f in frames:
            best, seen = max(best, float(f[value].max())), seen + len(f)
        state.update((best, seen))
        yield pd.DataFrame({key: [k[0]], "best": [best], "seen": [seen]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, best double, seen long", "best double, seen long", "update", "NoTimeout")



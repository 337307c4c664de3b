"""Keyed state of streams: the last samples of each key, and the progress of jobs' stages, by transformWithState.

State lives in RocksDB under the checkpoint, so a stopped stream goes on where it was. Keys that hold any share of the rows
are spread over PARTS parts by the sample's number; a part keeps its own last samples, and whoever reads merges the parts.

Jobs with a time to live or with timers always ask for a further batch, so they are run by a processing-time trigger, or by
`once`; `availableNow` would not end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructType

from . import jobs

#: Samples that a key keeps; parts of a key.
KEEP, PARTS = 250, 16
_SAMPLE = "at bigint, id bigint, value double"
# Workers have no session to parse a text schema with.
_SAMPLE_STATE = StructType().add("at", LongType()).add("id", LongType()).add("value", DoubleType())
_PROGRESS_STATE = StructType().add("best", DoubleType()).add("seen", LongType()).add("timer", LongType())
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_in_rocksdb(spark: SparkSession) -> None:
    """The state store that transformWithState asks for; the session keeps the setting, as streams read it when they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class LastSamples(StatefulProcessor):
    """List state of the KEEP latest samples (by time, then number) of a key and part, whatever order and batches they come in. A sample that is there already changes nothing."""

    def __init__(self, keep: int = KEEP, ttl_ms: int | None = None):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", _SAMPLE_STATE, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {(int(a), int(i)): float(v) for a, i, v in self.samples.get()} if self.samples.exists() else {}
        for part in rows:
            held.update({(int(a), int(i)): float(v) for a, i, v in zip(part["at"], part["id"], part["value"])})
            held = dict(sorted(held.items())[-self.keep :])
        self.samples.put([(a, i, v) for (a, i), v in held.items()])
        yield pd.DataFrame({"key": [key[0]], "part": [key[1]], "samples": [[{"at": a, "id": i, "value": v} for (a, i), v in held.items()]]})

    def close(self) -> None:
        pass


def last_samples(stream: DataFrame, keep: int = KEEP, ttl_ms: int | None = None, parts: int = PARTS) -> DataFrame:
    """key, part, samples of the parts that a batch changed. stream: key, at (long), id (long), value; rows with a null key, time, number or value are dropped. ttl_ms: how long (of processing time) a part stays known without a new sample; None is for ever."""
    keep_in_rocksdb(stream.sparkSession)
    rows = stream.select("key", "at", "id", F.col("value").cast("double").alias("value")).dropna()
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    out = f"key {dict(rows.dtypes)['key']}, part int, samples array<struct<{_SAMPLE.replace(' ', ':').replace(',:', ',')}>>"
    return rows.groupBy("key", "part").transformWithStateInPandas(LastSamples(keep, ttl_ms), out, "update", "none" if ttl_ms is None else "processingTime")


def metrics(parts: DataFrame, keep: int = KEEP) -> DataFrame:
    """key, n, total, mean, p95 (nearest rank), last of the last samples, from the latest rows of a key's parts: at most keep a part."""
    held = parts.groupBy("key").agg(F.flatten(F.collect_list("samples")).alias("s"))
    last = F.slice(F.array_sort("s"), F.greatest(F.lit(1), F.size("s") - keep + 1), F.lit(keep))
    held = held.withColumn("s", last).withColumn("v", F.array_sort(F.transform("s", lambda x: x["value"]))).withColumn("n", F.size("s").cast("long"))
    total: Column = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    rank = F.ceil(0.95 * F.col("n")).cast("int")
    return held.filter("n > 0").select("key", "n", F.round(total, 4).alias("total"), F.round(total / F.col("n"), 6).alias("mean"), F.round(F.element_at("v", rank), 6).alias("p95"), F.round(F.element_at("s", -1)["value"], 6).alias("last"))


class StageProgress(StatefulProcessor):
    """Value state of a job's stage: its progress never falls, and ends at 100. A timer closes a stage that nothing is heard of for idle_ms."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("progress", _PROGRESS_STATE)

    def _row(self, key: tuple, best: float, seen: int, open_: bool) -> pd.DataFrame:
        return pd.DataFrame({"job": [key[0]], "stage": [key[1]], "progress": [best], "seen": [seen], "open": [open_]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, seen, timer = self.state.get() if self.state.exists() else (0.0, 0, 0)
        for part in rows:
            best, seen = max(best, min(100.0, float(part["progress"].max()))), seen + len(part)
        if timer:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms if best < 100 else 0
        if timer:
            self.handle.registerTimer(timer)
        self.state.update((best, seen, timer))
        yield self._row(key, best, seen, best < 100)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best, seen, _ = self.state.get()
        self.state.clear()
        yield self._row(key, best, seen, False)

    def close(self) -> None:
        pass


def stage_progress(stream: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """job, stage, progress, seen, open of the stages that a batch changed or that went idle. stream: job, stage, progress; rows with a null are dropped."""
    keep_in_rocksdb(stream.sparkSession)
    rows = stream.select("job", "stage", F.col("progress").cast("double").alias("progress")).dropna()
    kinds = dict(rows.dtypes)
    return rows.groupBy("job", "stage").transformWithStateInPandas(StageProgress(idle_ms), f"job {kinds['job']}, stage {kinds['stage']}, progress double, seen long, open boolean", "update", "processingTime")


def event_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the last samples of each event type, from the stream of events."""
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp"), F.col("ts"))
    stream = jobs.events(spark, sf_dir).select(F.col("event_type").alias("key"), at.alias("at"), F.col("event_id").alias("id"), "value")
    return metrics(jobs.run(last_samples(stream), "update", ["key", "part"]))

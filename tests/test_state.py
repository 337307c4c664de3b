"""Keyed state of streams: any cut into batches, restarts, size and expiry."""

import random
import time

from pyspark.sql import functions as F

from stratolens.streaming import jobs, latency


class Source:
    """A stream of files, run over what is new each time from the same checkpoint."""

    def __init__(self, spark, top, schema):
        self.spark, self.top, self.schema, self.n = spark, str(top), schema, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.top}/in")

    def run(self, make, **trigger):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.top}/in")
        q = make(stream).writeStream.outputMode("update").option("checkpointLocation", f"{self.top}/state").trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda b, n: b.withColumn("run", F.lit(self.n)).withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{self.top}/out")).start()
        q.awaitTermination()
        self.progress = q.lastProgress
        return self.spark.read.parquet(f"{self.top}/out")


def latest(out):
    return out.groupBy("key", "part").agg(F.max_by("samples", "batch").alias("samples"))


def test_last_samples_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b"]), rng.randrange(400), i, rng.random() * 100) for i in range(300)]
    rng.shuffle(rows)  # late samples too
    source = Source(spark, tmp_path, "key string, at long, id long, value double")
    make = lambda s: latency.last_samples(s, keep=20, parts=3)
    for a in range(0, 300, 100):
        source.add(rows[a : a + 50])
        source.add([*rows[a + 50 : a + 100], *rows[a : a + 5], (None, 1, 1, 1.0), ("a", None, 2, 1.0), ("a", 1, 3, None)])  # some come twice
        out = source.run(make)  # a new query each time, from the checkpoint of the last one
        seen = rows[: a + 100]
        got = {r["key"]: r for r in latency.metrics(latest(out), 20).collect()}
        for key in ("a", "b"):
            last = sorted((at, i, v) for k, at, i, v in seen if k == key)[-20:]
            v = sorted(x[2] for x in last)
            r = got[key]
            assert (r["n"], r["last"], r["p95"], round(r["mean"], 4)) == (len(v), round(last[-1][2], 6), round(v[-(-95 * len(v) // 100) - 1], 6), round(sum(v) / len(v), 4))
    assert max(len(r["samples"]) for r in out.collect()) <= 20
    state = source.progress["stateOperators"][0]
    assert state["numRowsTotal"] <= 2 * 3 * 20 + 2 * 3 * 3  # keys x parts x samples, and what the store counts by


def test_samples_expire(spark, tmp_path):
    source = Source(spark, tmp_path, "key string, at long, id long, value double")
    make = lambda s: latency.last_samples(s, keep=20, ttl_ms=2000, parts=1)
    source.add([("a", 1, 1, 5.0)])
    source.run(make, once=True)
    time.sleep(3)
    source.add([("a", 2, 2, 7.0)])
    out = latest(source.run(make, once=True)).collect()
    assert [[(s["at"], s["value"]) for s in r["samples"]] for r in out] == [[(2, 7.0)]]


def test_stage_progress_never_falls_and_closes(spark, tmp_path):
    source = Source(spark, tmp_path, "job string, stage string, progress double")
    make = lambda s: latency.stage_progress(s, idle_ms=1500)
    last = lambda out: {(r["job"], r["stage"]): (r["progress"], r["seen"], r["open"]) for r in out.groupBy("job", "stage").agg(F.max_by(F.struct("progress", "seen", "open"), "batch").alias("r")).select("job", "stage", "r.*").collect()}
    source.add([("j", "asr", 30.0), ("j", "asr", 20.0), ("j", "ocr", 10.0), (None, "x", 1.0)])
    assert last(source.run(make, once=True)) == {("j", "asr"): (30.0, 2, True), ("j", "ocr"): (10.0, 1, True)}
    source.add([("j", "asr", 25.0), ("j", "vlm", 140.0)])
    got = last(source.run(make, once=True))
    assert got[("j", "asr")][0] == 30.0 and got[("j", "vlm")] == (100.0, 1, False)
    time.sleep(2)
    source.add([("k", "asr", 1.0)])
    got = last(source.run(make, once=True))
    assert got[("j", "ocr")] == (10.0, 1, False) and got[("j", "asr")][0] == 30.0 and not got[("j", "asr")][2] and got[("k", "asr")] == (1.0, 1, True)


def test_event_latencies(spark):
    got = {r["key"]: r["n"] for r in latency.event_latencies(spark, "/root/testdata/sf0.001").collect()}
    n = {r["event_type"]: r["count"] for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("event_type").count().collect()}
    assert got == {k: min(250, v) for k, v in n.items()} and jobs

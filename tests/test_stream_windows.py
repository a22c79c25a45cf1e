"""Look-back windows of a stream against those of a batch: batches out of order, a hot key, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import scoring
from emberlog.streaming import streams, windows

SECOND = 1_000_000


@pytest.fixture
def rows():
    rnd = random.Random(6)
    out = []
    for i in range(600):
        user = "hot" if i % 2 else rnd.choice(["a", "b", "", None])
        out.append((f"{i:04}", rnd.randrange(0, 2000) * SECOND, user, rnd.choice(["x", "x", "y", "z"]), "s"))
    return sorted(out, key=lambda r: r[1])


def stream_of(spark, path, rows, batches, disorder):
    """Micro-batches in about the order of time, rows up to ``disorder`` seconds late; one row long after closes all."""
    rnd = random.Random(1)
    come = sorted(rows, key=lambda r: r[1] + rnd.randrange(0, disorder * SECOND))
    schema = "id string, us long, user_id string, event_type string, source string"
    parts = [come[i * len(come) // batches : (i + 1) * len(come) // batches] for i in range(batches)] + [[("end", 10**9 * SECOND, "end", "end", "end")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(f"{path}/part={i:02}")
    return spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "id string, us long, user_id string, event_type string, source string")


def run(spark, stream):
    with windows.rocksdb(spark):
        return streams.run_to_table(stream, "windows").filter("id <> 'end'").collect()


def test_behaviour_and_thresholds_of_many_batches(spark, rows, tmp_path):
    stream = stream_of(spark, tmp_path, rows, 3, 90)
    got = {r.id: r.deviation for r in run(spark, windows.user_deviation(stream, 300 * SECOND, 5, "100 seconds"))}
    want = {r.id: r.deviation for r in scoring.user_deviation(batch_of(spark, rows), 300 * SECOND, 5).collect()}
    assert got == want and any(want.values())
    hits = {r.id: r.n for r in run(spark, windows.threshold_hits(stream, "user_id", 4, 60 * SECOND, "100 seconds"))}
    before = lambda r: sum(x[2] == r[2] and (x[1], x[0]) <= (r[1], r[0]) and x[1] >= r[1] - 60 * SECOND for x in rows)
    assert hits == {r[0]: before(r) for r in rows if before(r) >= 4}


def test_frequency(spark, rows, tmp_path):
    stream = stream_of(spark, tmp_path, rows, 3, 90)
    got = {r.id: (r.recent, round(r.frequency_score, 9)) for r in run(spark, windows.frequency_anomaly(stream, 60 * SECOND, 30, 10, "100 seconds"))}
    want = {r.id: (r.recent, round(r.frequency_score, 9)) for r in scoring.frequency_anomaly(batch_of(spark, rows), 60 * SECOND, 30, 10).collect()}
    assert got == want and any(s for _, s in want.values())


def test_what_is_too_late_is_left_out(spark, tmp_path):
    rows = [("a", 100 * SECOND, "u", "x", "s"), ("b", 200 * SECOND, "u", "x", "s")]
    for i, part in enumerate([rows, [("late", 120 * SECOND, "u", "x", "s"), ("c", 205 * SECOND, "u", "x", "s")], [("later", 110 * SECOND, "u", "x", "s"), ("end", 10**9 * SECOND, "end", "x", "s")]]):
        batch_of(spark, part).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(f"{tmp_path}/part={i}")
    stream = spark.readStream.schema(batch_of(spark, rows).schema.add("ts", "timestamp")).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part=*")
    got = {r.id: r.before for r in run(spark, windows.trailing_counts(stream, ["user_id"], 100 * SECOND, late="10 seconds"))}
    assert got["b"] == 1 + ("late" in got) and "later" not in got and got["c"] == got["b"]

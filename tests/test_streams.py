"""Streams against what a batch finds, with rows that come late."""

from emberlog.streaming import streams, windows


def stream_of(spark, path, batches):
    schema = "id string, us long, ts timestamp, k string"
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(n, us, k) for n, us, k in rows], "id string, us long, k string").selectExpr("id", "us", "timestamp_micros(us) AS ts", "k")
        made.coalesce(1).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def test_late_rows_count_in_their_own_window(spark, tmp_path):
    second = 1_000_000
    first = [("a1", 100 * second, "a"), ("a2", 105 * second, "a"), ("a3", 130 * second, "a")]
    later = [("late", 106 * second, "a"), ("a4", 131 * second, "a"), ("a5", 138 * second, "a"), ("b1", 131 * second, "b")]
    df = stream_of(spark, tmp_path, [first, later, [("end", 10**9 * second, "end")]])
    with windows.rocksdb(spark):
        got = streams.run_to_table(windows.threshold_hits(df, "k", 2, 10 * second), "hits")
    # The late one sees 100 and 105, not 130; 138 still sees 130 and 131.
    assert sorted((r.id, r.n) for r in got.collect()) == [("a2", 2), ("a4", 2), ("a5", 3), ("late", 3)]

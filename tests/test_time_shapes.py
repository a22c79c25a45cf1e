"""Patterns of times are tried where a text has their shape; a stream normalises its lines once."""

import random
import re

from pyspark.sql import functions as F

from emberlog.functions import normalize
from emberlog.functions.storage import new_path
from emberlog.streaming import streams

TEXTS = (
    "2024-01-05T07:01:09.123456Z", "2024-01-05T07:01:09.123Z", "2024-01-05T07:01:09.1Z", "2024-01-05t07:01:09z", "2024-01-05T07:01:09+02", "2024-01-05T07:01:09+0200", "2024-01-05T07:01:09.5+0200", "2024-01-05T07:01:09+02:00",
    "2024-01-05T07:01:09.", "2024-01-05 07:01:09.123456", "2024-01-05 07:01:09.1234567", "2024-01-05 07:01:09.12", "2024-01-05 07:01:09", "2024-01-05T07:01:09", "2024-01-05 07:01", "05/Jan/2024:07:01:09 +0000", "5/jan/2024:07:01:09 +0000", "05/JAN/2024:07:01:09 -0530",
    "2024 Jan 5 07:01:09", "2024 May 15 07:01:09", "01/05/2024 07:01:09", "01/05/2024 07:01:09 PM", "01/05/2024 07:01:09 pm", "05-01-2024 07:01:09", "2024/01/05 07:01:09", "5 Jan 2024 07:01:09 +0000", "Fri, 5 Jan 2024 07:01:09 +0000", "20240105070109", "20240105", "1704438069", "1704438069123",
    "+12024-01-05T07:01:09Z", "-0001-01-05T07:01:09Z", "2024-1-5 7:1:9", "2024-02-30 07:01:09", "2024-13-01", "Jan  5 07:01:09", "nonsense", "", "9" * 2000 + "x", "5 Sept 2024 07:01:09 +0000", "٢٠٢٤-01-05 07:01:09",
)


def test_a_time_is_read_as_by_all_patterns(spark):
    rnd = random.Random(4)
    spoilt = [t[:i] + rnd.choice(["", " ", "7", "-", "Z", "+"]) + t[i + rnd.randint(0, 1) :] for t in TEXTS if 0 < len(t) < 40 for i in rnd.sample(range(len(t)), min(8, len(t)))]
    df = spark.createDataFrame([(t,) for t in {*TEXTS, *spoilt}], "t string").repartition(4)
    for pattern in normalize.TIME_FORMATS:
        assert df.filter(F.try_to_timestamp("t", F.lit(pattern)).isNotNull() & ~F.col("t").rlike(normalize.time_shape(pattern))).collect() == []
    assert df.filter(normalize.parse_time(F.col("t"), 2024).isNotNull()).count() > 30
    # A text of no shape is never given to a parser.
    assert not any(re.search(normalize.time_shape(p), "CRON[1]: nonsense") for p in normalize.TIME_FORMATS)


def test_a_stream_normalises_its_lines_once(spark, monkeypatch):
    kept, split = [], streams.split_valid
    monkeypatch.setattr(streams, "split_valid", lambda df: kept.append(df.storageLevel.useDisk) or split(df))
    spark.createDataFrame([("2024-01-05 07:01:09 ok",), ("no time",)], "value string").write.text(path := new_path(spark, "lines"))
    logs, bad = new_path(spark, "logs"), new_path(spark, "bad")
    streams.ingest(spark.readStream.text(path), logs, bad, new_path(spark, "state"), year=2024).awaitTermination()
    assert kept == [True] and spark.read.parquet(logs).count() == 1 and spark.read.parquet(bad).count() == 1

"""The sample is the same, however often rows repeat."""

import pytest
from pyspark.sql import functions as F

from emberlog.llm.samples import sample_texts


def test_repeats_change_nothing(spark):
    docs = spark.range(200).select(F.when(F.col("id") > 2, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("h"))
    once = sorted(r.text for r in sample_texts(docs, 20, 7).collect())
    assert len(once) == 20
    for repeats in (10, 3000):
        again = docs.crossJoin(spark.range(repeats).select(F.col("id").alias("again")))
        assert sorted(r.text for r in sample_texts(again, 20, 7).collect()) == once
    hot = docs.unionByName(docs.filter("doc_id = 50").crossJoin(spark.range(50_000)).select("doc_id", "text", "h"))
    assert sorted(r.text for r in sample_texts(hot, 20, 7).collect()) == once


@pytest.mark.parametrize("rows", [[], [(None, None)] * 5, [(1, "a"), (1, "a"), (2, "a"), (None, "")]])
def test_fewer_than_asked_for(spark, rows):
    got = sample_texts(spark.createDataFrame(rows, "doc_id long, text string"), 10, 1).collect()
    assert sorted(r.text for r in got) == sorted(t or "" for _, t in set(rows))

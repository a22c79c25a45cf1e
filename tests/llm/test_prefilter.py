from pyspark.sql import functions as F

from emberlog.llm import prefilter
from emberlog.llm.prefilter import possible


def test_lets_all_values_and_few_others_through(spark, monkeypatch):
    values = spark.range(0, 3000, 3).withColumnRenamed("id", "v")
    got = {r.id for r in spark.range(-3000, 6000).filter(possible(values, "v")(F.col("id"))).collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 1600
    assert not spark.range(100).filter(possible(values.limit(0), "v")(F.col("id"))).count()
    monkeypatch.setattr(prefilter, "MOST_BITS", 64)
    assert spark.range(3000).filter(possible(values, "v")(F.col("id"))).count() == 3000

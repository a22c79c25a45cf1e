"""What detection computes, and how often."""

import numpy as np
from pyspark.sql import functions as F

from emberlog.functions import lookback
from emberlog.operators import isolation, rules
from emberlog.plans.detection import settled


def test_a_filter_stays_above_settled_columns(spark):
    df = spark.range(10).withColumn("x", F.regexp_replace(F.col("id").cast("string"), "1", "2"))
    found = settled(df, ["x"]).filter("x <> '2' AND length(x) > 0")
    assert found.columns == df.columns and found.count() == 8
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.index("Filter") < plan.index("Generate")


def test_statistical_rules_come_before_counts(spark):
    df = spark.createDataFrame([(str(i), i, "a", float(i % 5)) for i in range(60)], "id string, us long, ip_address string, bytes double")
    specs = [rules.RuleSpec("T", "threshold", "low", 1, "", {"field": "ip_address", "threshold": 2, "window_seconds": 1}), rules.RuleSpec("S", "statistical", "low", 1, "", {"field": "bytes"})]
    seen, whole = [], rules._with_window
    rules._with_window = lambda d, r: seen.append(r.id) or whole(d, r)
    try:
        found = rules.window_columns(df, specs)
    finally:
        rules._with_window = whole
    assert seen == ["S", "T"] and found.columns == ["id", *map(rules.helper, specs)] and found.count() == 60


def test_mean_z_is_that_of_the_moments(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, i, "ab"[i % 2], float(rnd.integers(5)), 7.0, float("inf") if i == 40 else float(rnd.random())) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, us long, k string, a double, b double, c double")
    names = ["a", "b", "c"]
    z = [F.abs(F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_dev") + 1e-6) for c in names]
    known = F.filter(F.array(*z), lambda v: ~F.isnan(v))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    want = lookback.with_trailing_moments(df, names, 20, ["k"], include_self=False).select("id", "n", mean.alias("z"))
    got = lookback.trailing_z(df, names, 20, ["k"], include_self=False).select("id", "n", "z")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_constant_rows_have_the_moments_of_the_tree():
    x = np.array([[3.7] * 50, [-0.0] * 50, [1e200] * 50, [np.inf] * 50, [np.nan] * 50, list(range(50))], float)
    n = np.minimum(np.arange(50), 9)
    got, want = (f(x, np.arange(50) - n, n) for f in (lookback.sliding_moments, lookback._sliding_moments))
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, want))


def test_scores_without_outliers_are_the_same(spark):
    rnd = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i, float(rnd.random())) for i in range(400)], "id long, us long, a double")
    with_, without = (isolation.score_versions(df, ["a"], 100, 200, trees=5, contamination=c) for c in (0.05, None))
    shown = lambda d: sorted(map(str, d.select("id", "forest", "isolation").collect()))
    assert shown(with_) == shown(without) and without.filter("outlier IS NOT NULL").count() == 0 < with_.filter("outlier").count()

"""Look-back windows against brute force: ties, missing keys and times, pieces that are smaller than the windows."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from emberlog.functions import lookback


@pytest.fixture
def rows():
    rnd = random.Random(11)
    made = [(f"{i:03}", rnd.randrange(0, 400) * 10, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice(["x", "y"]), rnd.choice([1.5, 1.5, 4.0, -2.25])) for i in range(300)]
    return made + [("900", None, "a", "x", 1.0), ("901", None, "a", "y", 1.0), ("902", 77, "d", "x", 0.1)]


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "id string, us long, k string, t string, v double").repartition(3)


@pytest.fixture(autouse=True)
def small_pieces(monkeypatch):
    halo = lookback.with_halo
    monkeypatch.setattr(lookback, "with_halo", lambda d, n: halo(d, n, 7))


def earlier(rows, r, keys):
    own = [x for x in rows if all(x[i] == r[i] for i in keys)]
    order = lambda x: (x[1] is not None, x[1] or 0, x[0])
    return [x for x in sorted(own, key=order) if order(x) < order(r)]


@pytest.mark.parametrize("window", [0, 30, 10_000])
def test_trailing_counts(df, rows, window):
    got = {r.id: (r.n, r.m) for r in lookback.with_trailing_counts(df, {"n": ["k"], "m": ["k", "t"]}, window).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if r[1] is not None:
            n, m = (1 + sum(x[1] is not None and x[1] >= r[1] - window for x in earlier(rows, r, keys)) for keys in ((2,), (2, 3)))
            assert got[r[0]] == (n, m)


def test_trailing_counts_take_no_longer_where_windows_hold_many_rows(spark):
    # All in one window: with a frame that is gone through for each row, 40 000 rows are 800 million steps.
    many = spark.range(40_000, numPartitions=2).selectExpr("CAST(id AS STRING) AS id", "id AS us", "'k' AS k")
    began = time.perf_counter()
    got = lookback.with_trailing_counts(many, {"n": ["k"]}, 39_000)
    assert "RangeFrame" not in got._jdf.queryExecution().toString() and got.filter("n <> least(us + 1, 39001)").count() == 0
    assert time.perf_counter() - began < 30


def test_earlier_counts_and_sums(df, rows):
    got = {r.id: (r.n, r.s) for r in lookback.with_earlier_counts(df, {"n": ["k"], "s": ["k", "t"]}, sums={"s": "v"}).collect()}
    assert got == {r[0]: (len(earlier(rows, r, (2,))), sum(x[4] for x in earlier(rows, r, (2, 3)))) for r in rows}


def test_previous(df, rows):
    got = {r.id: r.p for r in lookback.with_previous(df, {"p": "id"}, ["k"]).collect()}
    assert got == {r[0]: (earlier(rows, r, (2,)) or [(None,)])[-1][0] for r in rows}


@pytest.mark.parametrize("last, own", [(1, True), (5, True), (5, False), (40, False)])
def test_trailing_moments(df, rows, last, own):
    got = {r.id: r for r in lookback.with_trailing_moments(df.withColumn("c", F.lit(0.1)), ["v", "c"], last, ["k"], include_self=own).collect()}
    for r in rows:
        seen = ([x[4] for x in earlier(rows, r, (2,))] + [r[4]] * own)[-last:]
        g = got[r[0]]
        assert g.n == len(seen)
        if seen:
            mean = sum(seen) / len(seen)
            dev = math.sqrt(sum((x - mean) ** 2 for x in seen) / len(seen))
            assert g.v_mean == pytest.approx(mean, abs=1e-9) and g.v_dev == pytest.approx(dev, abs=1e-7)
            assert (g.c_mean, g.c_dev) == (0.1, 0.0)
        else:
            assert g.v_mean is None and g.v_dev is None


def test_no_rows(df):
    none = df.limit(0)
    assert lookback.with_earlier_counts(none, {"n": ["k"]}).count() == 0
    assert lookback.with_trailing_moments(none, ["v"], 3, ["k"]).count() == 0

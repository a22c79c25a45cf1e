"""The parallel prefix of group starts against one row at a time."""

import random

import numpy as np
import pytest

from emberlog.functions import folds
from emberlog.functions.folds import first_below, group_starts, step_function


def walk(rows, start=None):
    out = []
    for number, last in rows:
        start = number if start is None or last < start else start
        out.append((number, start))
    return out


def made(rnd, n, base=0):
    kind = rnd.choice(["near", "any", "falling"])
    lasts = {"near": lambda b: b - rnd.randint(1, 4), "any": lambda b: rnd.randint(-1, b - 1) if b else -1, "falling": lambda b: base + n - b}
    return [(b, max(-1, min(b - 1, lasts[kind](b)))) for b in range(base, base + n)]


def test_step_functions():
    rnd = random.Random(1)
    for _ in range(200):
        base, n = rnd.choice([1, 20]), rnd.randint(1, 30)
        rows = made(rnd, n, base)
        numbers, last = (np.array(c) for c in zip(*rows))
        assert first_below(last, numbers).tolist() == [next((j for j in range(i + 1, n) if last[j] < numbers[i]), n) for i in range(n)]
        upto, start = step_function(numbers, last)
        for s in range(base):
            at = int(np.searchsorted(upto, s))
            assert (start[at] if start[at] >= 0 else s) == walk(rows, s)[-1][1]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges(spark, seed):
    """Ten thousand rows in many ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = made(random.Random(seed), 10_000)
        df = spark.createDataFrame(rows, "block long, last long").repartition(3)
        got = group_starts(df, "block", "last").orderBy("number").collect()
        assert [(r.number, r.start) for r in got] == walk(rows)
        assert [r.new for r in got] == [int(n == s) for n, s in walk(rows)]
        assert group_starts(df.limit(0), "block", "last").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert folds

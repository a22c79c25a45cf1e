"""Sliding moments against numpy, with values that would spoil running sums."""

import numpy as np
import pytest

from emberlog.functions.lookback import sliding_moments
from emberlog.operators.rules import RuleSpec, evaluate_rules, with_rolling_z


def frames(size, last, rng):
    keys = np.sort(rng.integers(0, 4, size))
    first = np.maximum(np.searchsorted(keys, keys), np.arange(size) - last + 1)
    return first, np.arange(size) + 1 - first


@pytest.mark.parametrize("last", [1, 2, 7, 100, 1000])
@pytest.mark.parametrize("odd", [1.0, 1e9, 1e12, np.inf, -np.inf, np.nan])
def test_against_numpy(last, odd):
    rng = np.random.default_rng(last)
    x = rng.random((2, 3000))
    x[0, [500, 2600]] = odd
    x[1, 700:720] = 0.1
    first, n = frames(3000, last, rng)
    mean, spread = sliding_moments(x, first, n)
    plain, plain_spread = sliding_moments(np.where(x == odd, 0.5, x), first, n)
    for i in range(0, 3000, 13 if last > 100 else 1):
        for c in range(2):
            own = x[c, first[i] : first[i] + n[i]]
            with np.errstate(invalid="ignore"):
                assert mean[c, i] == pytest.approx(own.mean(), rel=1e-9, abs=1e-12, nan_ok=True)
                if not (own == own[0]).all():
                    assert spread[c, i] == pytest.approx(own.std(), rel=1e-9, abs=1e-13, nan_ok=True)
                elif np.isfinite(own).all():
                    assert spread[c, i] == 0 and mean[c, i] == own[0]
            if not np.any((own == odd) | np.isnan(own)):
                assert (mean[c, i], spread[c, i]) == (plain[c, i], plain_spread[c, i])


def test_empty_frames():
    mean, spread = sliding_moments(np.ones((1, 3)), np.array([0, 1, 2]), np.array([0, 0, 1]))
    assert np.isnan(mean[0, :2]).all() and (mean[0, 2], spread[0, 2]) == (1.0, 0.0)
    assert sliding_moments(np.ones((2, 0)), np.zeros(0, int), np.zeros(0, int))[0].shape == (2, 0)


def test_one_huge_value_blanks_nothing_after_its_frames(spark):
    rng = np.random.default_rng(5)
    values = rng.random(2600).tolist()
    values[10], values[20], values[30] = 1e9, float("inf"), float("nan")
    df = spark.createDataFrame([(f"{i:05}", i, v) for i, v in enumerate(values)], "id string, us long, bytes double")
    got = {r.us: r.z for r in with_rolling_z(df, "bytes", "z").collect()}
    for i in range(1030, 2600, 10):
        own = np.array(values[i - 999 : i + 1])
        assert got[i] == pytest.approx(abs(values[i] - own.mean()) / own.std(), rel=1e-9)
    assert all(got[i] is None for i in range(29)) and all(got[i] is None for i in range(30, 1020))


def test_rule_ids_and_defaults(spark):
    rows = [(f"{i:04}", i, 100.0 if i == 99 else float(i % 2)) for i in range(100)] + [("9999", 100, None)]
    df = spark.createDataFrame(rows, "id string, us long, bytes double")
    plain = {"field": "bytes"}
    rules = [RuleSpec(n, "statistical", "low", 1, "T", plain) for n in ("S.1", "s.1", "S 1`", "")]
    rules += [RuleSpec("S.1", "statistical", "low", 1, "T", plain), RuleSpec("S.1", "statistical", "low", 1, "T", {**plain, "z_threshold": 1e9}), RuleSpec("T.1", "threshold", "low", 1, "T", {"field": "id", "threshold": 1, "window_seconds": 1})]
    got = {r.id: [m.rule_id for m in r.matches] for r in evaluate_rules(df, rules).collect()}
    assert got["0099"] == ["S.1", "s.1", "S 1`", "", "S.1", "T.1"] and got["0050"] == ["T.1"] and got["9999"] == ["T.1"]

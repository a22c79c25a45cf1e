import random

from emberlog.operators.memory import throughput


def test_nearest_rank_without_a_list(spark):
    rnd = random.Random(1)
    rows = [(f"2024-01-01 {0 if i % 3 else rnd.randrange(1, 24):02d}:10:00", rnd.choice([None, 1.0, 2.0, rnd.random() * 9])) for i in range(900)] + [("2024-01-02 05:00:00", None)]
    df = spark.createDataFrame(rows, "t string, l double").selectExpr("CAST(t AS TIMESTAMP) AS ts", "l")
    got = throughput(df, "l", "1 hour", "1 hour")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = {}
    for t, x in rows:
        want.setdefault(t[:13], []).append(x)
    found = {str(r.start)[:13]: r for r in got.selectExpr("at - INTERVAL 1 HOUR AS start", "date_format(at - INTERVAL 1 HOUR, 'yyyy-MM-dd HH') AS k", "per_second", "p95").collect()}
    found = {r.k: r for r in found.values()}
    assert set(found) == set(want)
    for k, xs in want.items():
        known = sorted(x for x in xs if x is not None)
        assert found[k].p95 == (known[min(int(len(known) * 0.95), len(known) - 1)] if known else None)
        assert abs(found[k].per_second - len(xs) / 3600) < 1e-9


def test_sliding_windows_of_panes(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(-90, 200) * 500_000, rnd.choice([None, float(rnd.randrange(6)), rnd.random() * 9])) for _ in range(400)]
    df = spark.createDataFrame(rows, "us long, l double").selectExpr("timestamp_micros(us) AS ts", "l")
    for width, step in ((10, 1), (7, 3), (3, 7)):
        want = {}
        for us, x in rows:
            for w in range(-200, 300):
                if w * step * 10**6 <= us < (w * step + width) * 10**6:
                    want.setdefault(w * step + width, []).append(x)
        got = {r.at: r for r in throughput(df, "l", f"{width} seconds", f"{step} seconds").selectExpr("unix_seconds(at) AS at", "per_second", "mean", "p95").collect()}
        assert set(got) == set(want)
        for k, xs in want.items():
            known = sorted(x for x in xs if x is not None)
            assert got[k].p95 == (known[min(int(len(known) * 0.95), len(known) - 1)] if known else None)
            assert abs(got[k].per_second - len(xs) / width) < 1e-9 and (got[k].mean is None) == (not known)
            assert not known or abs(got[k].mean - sum(known) / len(known)) < 1e-9

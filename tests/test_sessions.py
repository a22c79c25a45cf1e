"""Sessions as segmented scans against a walk over each key's events, with one key that holds most of the rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.functions.lookback import with_rank
from emberlog.operators.correlation import PRIVILEGE_WORDS, sessionize, session_summary

MINUTE = 60_000_000


def walk(rows, timeout, per_minute, hours):
    keys = defaultdict(list)
    for r in rows:
        i, us, ip, user, host, country, message = r
        keys["|".join([ip or "", user or "", host or "", *([i] if not (ip or user) else [])])].append(r)
    sessions, out = defaultdict(list), {}
    for key, own in keys.items():
        nth, last = 0, None
        for r in sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
            nth += last is None or r[1] is None or r[1] - last > timeout
            last = r[1]
            sessions[f"{key}#{nth}"].append(r)
    for name, own in sessions.items():
        burst = travel = False
        place = None
        times = [r[1] for r in own if r[1] is not None]
        for n, (_, us, _, _, _, country, _) in enumerate(own, 1):
            if us is not None and (us - own[0][1]) / 1e6 >= 1:
                burst |= n / ((us - own[0][1]) / 6e7) > per_minute
            if country:
                travel |= bool(place and place[0] != country and (us - place[1]) / 3.6e9 < hours)
                place = (country, us)
        privileged = any(w in (r[6] or "").lower() for r in own for w in PRIVILEGE_WORDS)
        out[name] = (len(own), min(times, default=None), max(times, default=None), burst, privileged, travel)
    return out


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables would be one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    made = []
    for i in range(900):
        hot = i % 2 == 0
        ip, user, host = ("1.1.1.1", "hot", "h") if hot else (rnd.choice(["2.2.2.2", "", None]), rnd.choice(["a", "", None]), rnd.choice(["h", "", None]))
        us = rnd.randrange(0, 1500) * MINUTE // (1 if hot else 3)
        made.append((f"{i:04}", us, ip, user, host, rnd.choice(["DE", "FR", "", None, "DE"]), rnd.choice(["fine", "sudo -i", None, "fine"])))
    return made + [("x1", 30 * MINUTE * 100, "3.3.3.3", "b", "h", "DE", ""), ("x2", 30 * MINUTE * 101, "3.3.3.3", "b", "h", "FR", "")]


def test_sessions(spark, rows):
    df = spark.createDataFrame(rows, "id string, us long, ip_address string, user_id string, host string, country string, message string").withColumn("event_type", F.lit("view")).repartition(5)
    expected = walk(rows, 5 * MINUTE, 2.0, 0.05)
    made = sessionize(df, 5 * MINUTE, keep_parts=True)
    hot = made.filter("user_id = 'hot'").groupBy("__part").count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 450  # the hot key is spread
    for given in (made, sessionize(df, 5 * MINUTE)):
        got = {r.session: (r.n, r.start_us, r.end_us, r.burst_activity, r.privilege_escalation, r.impossible_travel) for r in session_summary(given, burst_per_minute=2.0, travel_hours=0.05).collect()}
        assert got == expected
    assert sum(e[3] for e in expected.values()) and sum(e[5] for e in expected.values())


def test_gap_of_exactly_the_timeout_stays(spark):
    df = spark.createDataFrame([(str(i), t * MINUTE, "1", "u", "h") for i, t in enumerate((0, 30, 61, 91))], "id string, us long, ip_address string, user_id string, host string")
    assert sorted((r.us // MINUTE, r.session) for r in sessionize(df).collect()) == [(0, "1|u|h#1"), (30, "1|u|h#1"), (61, "1|u|h#2"), (91, "1|u|h#2")]
    assert sessionize(df.limit(0)).count() == 0


def test_rank(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", None, "b"]), rnd.randint(0, 20), i) for i in range(300)]
    got = sorted((tuple(r) for r in with_rank(spark.createDataFrame(rows, "k string, v int, i int"), "nth", ["k"], ["v", "i"]).collect()), key=repr)
    place = {k: sorted((v, i) for x, v, i in rows if x == k) for k in {r[0] for r in rows}}
    assert got == sorted(((k, v, i, place[k].index((v, i)) + 1) for k, v, i in rows), key=repr)

"""Every registered query of the core runs; those with SQL agree with DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from emberlog.functions.storage import stage
from emberlog.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each family: the driver compares all of them.
COMPARED = ("r3_threshold_rule", "r4_statistical_rule_global", "t2_domain_reputation", "t5_substring_indicators", "a6_frequency_anomaly", "d7_detect_threats", "p5_threat_score", "c5_group_summary", "k3_chain_confidence", "e6_session_risk", "g9_communities", "l4_group_alerts", "m1_similar_texts", "n7_access_log", "s8_batch_receipt", "w3_stream_threshold", "w5_stream_dedupe", "n8_csv", "x4_timeline_dwell", "x5_merged_report", "g6_distances", "l1_build_alerts", "d4_risk_composition", "w4_stream_session_anomalies", "w8_late_rows", "u2_own_chain_and_playbook")
RUN = ("m4_cluster", "a3_a4_isolation_forest")


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", RUN)
def test_runs(spark, name):
    # Written, not only counted: columns whose names clash show up then.
    assert stage(registry.queries()[name](spark, DATA), "test").count() > 0


def test_outliers_are_isolated(spark):
    from emberlog.operators.isolation import fit_forest, score_forest

    df = spark.range(2000).selectExpr("id", "if(id = 7, 50D, sin(id)) AS x", "if(id = 7, -50D, cos(id * 3)) AS y")
    top = score_forest(df, fit_forest(df, ["x", "y"], trees=40), ["x", "y"], scale="published").orderBy("isolation", ascending=False).first()
    assert top.id == 7


def test_incident_groups_bridge_by_host(spark):
    from emberlog.operators.response import auto_group

    minute = 60_000_000
    data = [("1", 0, "a"), ("2", 10 * minute, "b"), ("3", 100 * minute, "a"), ("4", 200 * minute, "c"), ("5", 300 * minute, "b")]
    got = auto_group(spark.createDataFrame(data, "id string, us long, host string")).orderBy("block").collect()
    # 3 bridges by host a; 4 starts anew; 5's host b is not in 4's group.
    assert [r.grp for r in got] == [1, 1, 2, 3]


def test_incident_groups_against_one_alert_at_a_time(spark):
    import random

    from emberlog.operators.response import auto_group

    rnd = random.Random(4)
    for _ in range(3):
        at, data = 0, []
        for i in range(60):
            at += rnd.choice([0, 5, 40])
            data.append((f"{i:03}", at, rnd.choice("abcdefgh")))
        want, hosts, last = [], set(), None
        for _, us, host in data:
            if last is None or not (us - last <= 10 or host in hosts):
                hosts = set()
                want.append(0)
            hosts.add(host)
            want[-1] += 1
            last = us
        df = spark.createDataFrame(data, "id string, us long, host string")
        found = auto_group(df, 10)
        from emberlog.operators.response import group_alerts
        from pyspark.sql import functions as F

        blocks = group_alerts(df.withColumn("host", F.lit(None).cast("string")), 10).withColumnRenamed("grp", "block")
        got = [r.n for r in blocks.join(found.withColumnRenamed("grp", "g"), "block").groupBy("g").agg(F.count("*").alias("n")).orderBy("g").collect()]
        assert got == want

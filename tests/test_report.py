"""The merged report goes through each text once."""

from emberlog.operators.memory import merged_report


def test_no_text_is_read_after_the_report_is_staged(spark):
    rows = [("1", "a", "2024-01-01T00:00:00Z brute force user=eve at evil.com", "1.1.1.1", "eve", "a"), ("2", "a", "2024-01-01T03:00:00Z sql injection failed 1.1.1.1", "1.1.1.1", "bob", "a"), ("3", "b", None, None, "", "b")]
    df = spark.createDataFrame(rows, "id string, host string, line string, ip_address string, user_id string, other string")
    out = merged_report(df, "host", "line")
    got = {r["host"]: r.asDict() for r in out.collect()}
    assert (got["a"]["category"], got["a"]["severity"], got["a"]["n_indicators"], got["a"]["n_users"], got["a"]["dwell_hours"], got["a"]["failure"]) == ("sql_injection", 7, 2, 1, 3.0, True)
    assert (got["b"]["category"], got["b"]["techniques"], got["b"]["dwell_hours"], got["b"]["n_users"], got["b"]["failure"]) == ("unknown", [], None, 0, None)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan and "brute" not in plan

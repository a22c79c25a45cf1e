"""One raw line per format; expected values worked out by hand."""

import datetime as dt

from emberlog.functions.normalize import csv_fields, normalize_logs, parse_time, redact
from pyspark.sql import functions as F

LINES = {
    "rfc3164": "<34>Mar 31 17:10:00 web-01 sshd[411]: Failed password for user=admin from 10.0.0.9",
    "one-digit day": "<13>Mar  3 07:01:09 db-01 cron: job done",
    "rfc5424": "<165>1 2026-03-31T17:10:00.003Z host app 8710 ID47 - message text",
    "cef": "CEF:0|Vendor|Product|1.0|100|Name of event|7|src=10.0.0.1 dst=2.1.2.2 suser=bob rt=1774977000",
    "bad cef": "CEF:0|V|P|1|1|N|High|src=10.0.0.1",
    "access": '203.0.113.17 - - [31/Mar/2026:17:10:10 +0000] "GET /login HTTP/1.1" 500 1240 "-" "curl"',
    "json": '{"@timestamp":"2026-03-31T17:10:00Z","level":"error","msg":"denied user=eve","src_ip":"10.1.1.1","extra":"x"}',
    "windows": '{"EventID":4672,"Level":"Information","Computer":"dc1","Message":"Special privileges","TimeCreated":"2026-03-31T17:10:00Z"}',
    "csv": '2026-03-31 17:10:00,"disk, full",sda',
    "plain": "2026-03-31T17:10:00Z CRITICAL kernel panic",
    "comma": "critical failure, call user=ops",
    "empty": "",
}


def test_formats(spark):
    df = spark.createDataFrame([(k, v) for k, v in LINES.items()] + [("null", None)], "name string, value string")
    got = {r["name"]: r for r in normalize_logs(df, "test", "odd", year=2026).collect()}
    time = dt.datetime(2026, 3, 31, 17, 10)
    r = got["rfc3164"]
    assert (r.parse_format, r.severity, r.host, r.process_name, r.user_id, r.ip_address, r.ts) == ("rfc3164", "critical", "web-01", "sshd", "admin", "10.0.0.9", time)
    assert r.parsed_fields == {"pri": "34", "facility": "4", "severity_code": "2", "pid": "411"} and r.source_type == "custom"
    assert got["one-digit day"].ts == dt.datetime(2026, 3, 3, 7, 1, 9) and got["one-digit day"].process_name == "cron"
    r = got["rfc5424"]
    assert (r.severity, r.process_name, r.message, r.parsed_fields["msgid"], r.ts) == ("info", "app", "message text", "ID47", time.replace(microsecond=3000))
    r = got["cef"]
    assert (r.severity, r.ip_address, r.user_id, r.event_type, r.message, r.parse_error) == ("error", "2.1.2.2", "bob", "cef_100", "Name of event", None)
    assert got["bad cef"].parse_error == "severity is no number"
    r = got["access"]
    assert (r.severity, r.ip_address, r.user_id, r.parsed_fields["bytes"], r.message) == ("error", "203.0.113.17", "", "1240", "GET /login 500")
    r = got["json"]
    assert (r.severity, r.user_id, r.ip_address, r.parsed_fields) == ("error", "eve", "10.1.1.1", {"src_ip": "10.1.1.1", "extra": "x"})
    r = got["windows"]
    assert (r.parse_format, r.event_type, r.severity, r.host, r.ts) == ("windows", "windows_event_4672", "info", "dc1", time)
    r = got["csv"]
    assert (r.message, r.severity, r.parsed_fields["field_2"], r.ts) == ("disk, full", "info", "sda", time)
    assert (got["plain"].severity, got["plain"].ts) == ("critical", time)
    assert (got["comma"].parse_format, got["comma"].severity, got["comma"].message, got["comma"].parse_error) == ("csv", "info", " call user=ops", "no readable time")
    assert got["empty"].parse_error == got["null"].parse_error == "empty"


def test_times_and_redaction(spark):
    values = ["1774977000", "1774977000000", "31/Mar/2026:17:10:00 +0000", "2026-03-31 17:10", "03/31/2026 05:10:00 PM", "20260331171000", "nonsense", "9999999999"]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(parse_time(F.col("v")).alias("t")).collect()]
    assert got[:6] == [dt.datetime(2026, 3, 31, 17, 10)] * 6 and got[6:] == [None, None]
    row = spark.range(1).select(redact(F.create_map(F.lit("API_Key"), F.lit("x"), F.lit("name"), F.lit("y"))).alias("m")).first()
    assert row.m == {"API_Key": "[REDACTED]", "name": "y"}


def test_csv_keeps_every_field_in_its_place(spark):
    lines = ["2024-01-05 07:01:09,,third", ",".join(["2024-01-05 07:01:09", *(f"v{i}" for i in range(69))]), '2024-01-05 07:01:09,"a ""b"", c",,', '2024-01-05 07:01:09,"open, to the end', 'x,y"z"']
    import csv

    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").orderBy("i").select(csv_fields(F.col("value")).alias("c")).collect()]
    assert got == [next(csv.reader([x])) for x in lines]

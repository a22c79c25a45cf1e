"""Queries over the driver's tables for ingestion and normalisation, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions import normalize as n
from emberlog.functions.storage import new_path
from emberlog.plans.checks_detection import table
from emberlog.sources import logs as s
from emberlog.sources.events import sec_events
from emberlog.streaming.streams import run_to_table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Raw lines of seven formats from the events; one text for Spark and DuckDB.
VALUE = """CASE event_id % 7
 WHEN 0 THEN '<' || CAST(event_id % 191 AS STRING) || '>Jan  5 07:01:09 host' || CAST(user_id AS STRING) || ' app[' || CAST(event_id AS STRING) || ']: text user=u' || CAST(user_id AS STRING) || ' from 10.0.0.' || CAST(user_id % 250 AS STRING)
 WHEN 1 THEN '<' || CAST(event_id % 191 AS STRING) || '>1 2024-01-05T07:01:09Z host app ' || CAST(event_id AS STRING) || ' ID47 - text ' || event_type
 WHEN 2 THEN '10.1.0.' || CAST(user_id % 250 AS STRING) || ' - u' || CAST(user_id AS STRING) || ' [05/Jan/2024:07:01:09 +0000] "GET /p HTTP/1.1" ' || CAST(200 + 100 * (event_id % 4) AS STRING) || ' ' || CAST(event_id AS STRING)
 WHEN 3 THEN '{"timestamp":"2024-01-05T07:01:09Z","level":"' || event_type || '","msg":"m user=x' || CAST(user_id AS STRING) || '","src_ip":"10.2.0.1","k":"' || CAST(event_id AS STRING) || '"}'
 WHEN 4 THEN '2024-01-05 07:01:09,text ' || event_type || ',third'
 WHEN 5 THEN 'CEF:0|V|P|1|' || CAST(event_id AS STRING) || '|Name|' || CAST(event_id % 11 AS STRING) || '|src=10.3.0.1 suser=u' || CAST(user_id AS STRING) || ' rt=1704438069'
 ELSE '2024-01-05T07:01:09Z ' || event_type || ' on host' END"""
R_SQL = "WITH r AS (SELECT event_id AS id, user_id AS u, " + VALUE.replace("STRING", "VARCHAR") + " AS value FROM events) "
SYSLOG = "CASE WHEN (id % 191) % 8 <= 2 THEN 'critical' WHEN (id % 191) % 8 = 3 THEN 'error' WHEN (id % 191) % 8 = 4 THEN 'warning' ELSE 'info' END"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else R_SQL + sql
        return f

    return put


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS u", f"{VALUE} AS value")


def _ntz():
    return F.col("ts").cast("timestamp_ntz").alias("ts")


def _parsed(spark, sf_dir, kind=None):
    df = n.normalize_logs(_lines(spark, sf_dir), "app", "system", year=2024)
    return df if kind is None else df.filter(F.col("parse_format") == kind)


TIME = "TIMESTAMP '2024-01-05 07:01:09' AS ts"


@query("SELECT CASE id % 7 WHEN 0 THEN 'rfc3164' WHEN 1 THEN 'rfc5424' WHEN 2 THEN 'access' WHEN 3 THEN 'json' WHEN 4 THEN 'csv' WHEN 5 THEN 'cef' ELSE 'plain' END AS parse_format, count(*) AS n FROM r GROUP BY 1")
def n1_format_routing(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy("parse_format").agg(F.count("*").alias("n"))


@query(f"SELECT id, {SYSLOG} AS severity, 'host' || u AS host, 'app' AS process_name, 'u' || u AS user_id, '10.0.0.' || (u % 250) AS ip_address, {TIME} FROM r WHERE id % 7 = 0")
def n2_rfc3164(spark, sf_dir):
    return _parsed(spark, sf_dir, "rfc3164").select("id", "severity", "host", "process_name", "user_id", "ip_address", _ntz())


@query(f"SELECT id, {SYSLOG} AS severity, 'host' AS host, 'app' AS process_name, CAST(id AS VARCHAR) AS procid, split_part(value, ' - ', 2) AS message, {TIME} FROM r WHERE id % 7 = 1")
def n3_rfc5424(spark, sf_dir):
    return _parsed(spark, sf_dir, "rfc5424").select("id", "severity", "host", "process_name", F.col("parsed_fields")["procid"].alias("procid"), "message", _ntz())


@query("WITH x AS (SELECT 1) SELECT 'windows' AS parse_format, 'error' AS severity, count(*) AS n, count(DISTINCT event_id) AS types FROM events")
def n4_windows_events(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").alias("EventID"), F.lit("Error").alias("Level"), F.concat(F.lit("dc"), "user_id").alias("Computer"))).alias("value"))
    return n.normalize_logs(made).groupBy("parse_format", "severity").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"))


@query(f"SELECT id, CASE WHEN contains(value, '\"level\":\"error\"') THEN 'error' ELSE 'info' END AS severity, 'm user=x' || u AS message, 'x' || u AS user_id, '10.2.0.1' AS ip_address, CAST(id AS VARCHAR) AS k, {TIME} FROM r WHERE id % 7 = 3")
def n5_json(spark, sf_dir):
    return _parsed(spark, sf_dir, "json").select("id", "severity", "message", "user_id", "ip_address", F.col("parsed_fields")["k"].alias("k"), _ntz())


@query(f"SELECT id, CASE WHEN id % 11 <= 3 THEN 'info' WHEN id % 11 <= 6 THEN 'warning' WHEN id % 11 <= 8 THEN 'error' ELSE 'critical' END AS severity, '10.3.0.1' AS ip_address, 'u' || u AS user_id, 'cef_' || id AS event_type, {TIME} FROM r WHERE id % 7 = 5")
def n6_cef(spark, sf_dir):
    return _parsed(spark, sf_dir, "cef").select("id", "severity", "ip_address", "user_id", "event_type", _ntz())


@query(f"SELECT id, CASE WHEN id % 4 = 3 THEN 'error' WHEN id % 4 = 2 THEN 'warning' ELSE 'info' END AS severity, 'GET /p ' || (200 + 100 * (id % 4)) AS message, '10.1.0.' || (u % 250) AS ip_address, 'u' || u AS user_id, CAST(id AS VARCHAR) AS bytes, {TIME} FROM r WHERE id % 7 = 2")
def n7_access_log(spark, sf_dir):
    return _parsed(spark, sf_dir, "access").select("id", "severity", "message", "ip_address", "user_id", F.col("parsed_fields")["bytes"].alias("bytes"), _ntz())


#: Of three CSV lines one has an empty field, one 70 fields, one quotes that hold commas and quotes.
CSV_LINE = """CASE id % 3 WHEN 0 THEN '2024-01-05 07:01:09,,third,' || CAST(id AS STRING)
 WHEN 1 THEN '2024-01-05 07:01:09,m' || CAST(id AS STRING) || repeat(',x', 67) || ',last'
 ELSE '2024-01-05 07:01:09,"say ""hi"", ' || CAST(id AS STRING) || '",third,' END"""


@query(f"""SELECT id, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'm' || id ELSE 'say "hi", ' || id END AS message, CASE WHEN id % 3 = 1 THEN 'x' ELSE 'third' END AS third,
  CASE id % 3 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN 'last' ELSE '' END AS last, CASE WHEN id % 3 = 1 THEN 70 ELSE 4 END AS n, {TIME} FROM r""")
def n8_csv(spark, sf_dir):
    lines = _lines(spark, sf_dir).selectExpr("id", f"{CSV_LINE} AS value")
    df = n.normalize_logs(lines, "app", "system", year=2024).filter("parse_format = 'csv'")
    size, fields = F.size("parsed_fields"), F.col("parsed_fields")
    last = F.try_element_at(fields, F.concat(F.lit("field_"), (size - 1).cast("string")))
    return df.select("id", "message", fields["field_2"].alias("third"), last.alias("last"), size.alias("n"), _ntz())


@query(f"SELECT id, CASE WHEN contains(value, 'error') THEN 'error' ELSE 'info' END AS severity, value AS message, {TIME} FROM r WHERE id % 7 = 6")
def n9_plain_text(spark, sf_dir):
    return _parsed(spark, sf_dir, "plain").select("id", "severity", "message", _ntz())


@query("WITH x AS (SELECT 1) SELECT event_id AS id, date_trunc('second', ts) AS ts FROM events")
def n10_timestamps(spark, sf_dir):
    df = sec_events(spark, sf_dir)
    k = F.col("id").cast("long") % 5
    written = F.when(k == 0, F.unix_seconds("ts").cast("string")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss +0000")).when(k == 3, F.date_format("ts", "MM/dd/yyyy HH:mm:ss")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    return df.select(F.col("id").cast("long").alias("id"), n.parse_time(written).cast("timestamp_ntz").alias("ts"))


@query("WITH x AS (SELECT CASE severity WHEN 'info' THEN 'info' WHEN 'warning' THEN 'warning' ELSE 'error' END AS severity FROM (SELECT CASE event_type WHEN 'error' THEN 'warning' WHEN 'purchase' THEN 'error' ELSE 'info' END AS severity FROM events) t) SELECT severity, count(*) AS n FROM x GROUP BY severity")
def n11_severity_mapping(spark, sf_dir):
    return sec_events(spark, sf_dir).groupBy(n.keyword_severity(F.concat(F.lit(" "), F.upper("severity"))).alias("severity")).agg(F.count("*").alias("n"))


@query(r"WITH x AS (SELECT doc_id, regexp_extract(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', 0) AS ip FROM documents) SELECT doc_id, ip FROM x WHERE ip <> ''")
def n12_first_ip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", n.first_ip(F.col("text")).alias("ip")).filter("ip <> ''")


@query("WITH x AS (SELECT CASE WHEN source IN ('src1', 'src2') THEN 'api' ELSE 'custom' END AS kind FROM documents) SELECT kind, count(*) AS n FROM x GROUP BY kind")
def n13_canonical_coercion(spark, sf_dir):
    named = F.when(F.col("source").isin("src1", "src2"), "api").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").groupBy(n.canonical_source_type(named).alias("kind")).agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT 1) SELECT doc_id, '[REDACTED]' AS secret, lang AS plain FROM documents")
def n14_redaction(spark, sf_dir):
    fields = n.redact(F.create_map(F.lit("Auth_Token"), F.col("source"), F.lit("lang"), F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", fields["Auth_Token"].alias("secret"), fields["lang"].alias("plain"))


@query("""WITH x AS (SELECT 1) SELECT doc_id AS "a.doc_id", lang AS "a.b.lang" FROM documents""")
def n15_flatten(spark, sf_dir):
    nested = F.struct("doc_id", F.struct("lang").alias("b")).alias("a")
    return n.flatten(table(spark, sf_dir, "documents").select(nested))


@query("WITH e AS (SELECT user_id % 20 AS h, event_id, '192.0.2.' || (user_id % 60) AS ip FROM events) SELECT 'h' || h AS host, count(*) AS n, CAST(0 AS BIGINT) AS missing, count(*) AS valid_ips, CAST(0 AS BIGINT) AS private_ips, count(*) AS known_severities FROM e GROUP BY h")
def n16_quality_report(spark, sf_dir):
    return n.quality_report(sec_events(spark, sf_dir), "host")


@query("SELECT count(*) AS lines FROM r")
def s1_read_log_files(spark, sf_dir):
    path = new_path(spark, "logs")
    _lines(spark, sf_dir).select("value").write.option("lineSep", "\n").text(f"{path}/a")
    df = s.read_log_files(spark, path)
    return df.agg(F.count("*").alias("lines"))


@query("SELECT 'part' AS source, count(*) AS lines FROM r")
def s2_stream_log_files(spark, sf_dir):
    """The lines of two folders of files, each file once, with the first word of its name."""
    path = new_path(spark, "logs")
    for i in range(2):
        _lines(spark, sf_dir).filter(F.col("id") % 2 == i).select("value").write.text(f"{path}/{i}")
    got = run_to_table(s.stream_log_files(spark, path), "log-lines")
    return got.groupBy(F.regexp_extract("source", "^([a-z]+)", 1).alias("source")).agg(F.count("*").alias("lines"))


@query("SELECT id // 10 AS batch, count(*) AS n FROM r GROUP BY 1")
def s3_ingest_payloads(spark, sf_dir):
    made = _lines(spark, sf_dir).groupBy(F.floor(F.col("id") / 10).alias("batch")).agg(F.to_json(F.sort_array(F.collect_list("value"))).alias("json"), F.array_join(F.collect_list("value"), "\n").alias("raw"))
    both = made.select("batch", F.when(F.col("batch") % 2 == 0, "json").otherwise("raw").alias("format"), F.when(F.col("batch") % 2 == 0, F.col("json")).otherwise(F.col("raw")).alias("data"))
    return s.ingest_payloads(both).groupBy("batch").agg(F.count("*").alias("n"))


@query("SELECT id // 10 AS batch, count(*) AS n FROM r GROUP BY 1")
def s4_unnest_webhook(spark, sf_dir):
    made = _lines(spark, sf_dir).groupBy(F.floor(F.col("id") / 10).alias("batch")).agg(F.collect_list("value").alias("l"))
    body = F.when(F.col("batch") % 2 == 0, F.to_json(F.struct(F.col("l").alias("logs")))).otherwise(F.to_json(F.struct(F.col("l").alias("alerts"))))
    return s.unnest_webhook(made.select("batch", body.alias("body"))).groupBy("batch").agg(F.count("*").alias("n"))


BROKEN = "CASE WHEN id % 50 = 4 THEN 'no time here' ELSE value END"


def _broken(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumn("value", F.when(F.col("id") % 50 == 4, F.lit("no time here")).otherwise(F.col("value")))
    return n.normalize_logs(df, "app", year=2024)


@query("SELECT count(*) FILTER (WHERE id % 50 <> 4) AS ok, count(*) FILTER (WHERE id % 50 = 4) AS bad FROM r")
def s5_split_valid(spark, sf_dir):
    ok, bad = s.split_valid(_broken(spark, sf_dir))
    return ok.agg(F.count("*").alias("ok")).join(F.broadcast(bad.agg(F.count("*").alias("bad"))), F.lit(True))


@query("SELECT id, 'no time here' AS preview, 'no readable time' AS error FROM r WHERE id % 50 = 4 ORDER BY id DESC LIMIT 20")
def s6_quarantine_snapshot(spark, sf_dir):
    _, bad = s.split_valid(_broken(spark, sf_dir))
    return s.quarantine_snapshot(bad.select("id", F.col("raw_log").alias("record"), F.col("parse_error").alias("error")), 20, [F.desc("id")]).select("id", "preview", "error")


@query("SELECT CAST(least(30, count(*)) AS INT) AS ok, greatest(0, count(*) - 30) AS waiting FROM r WHERE id % 50 = 4")
def s7_replay_quarantine(spark, sf_dir):
    _, bad = s.split_valid(_broken(spark, sf_dir))
    fixed = bad.select(F.sha2(F.col("id").cast("string"), 256).alias("entry_id"), F.concat(F.lit("2024-01-05T07:01:09Z fixed "), "id").alias("record"), "source", F.col("parse_error").alias("error"), F.lit(1).alias("attempts"), F.timestamp_seconds("id").alias("failed_at"))
    ok, again, left = s.replay_quarantine(fixed, 30, [F.col("failed_at"), F.col("entry_id")])
    return ok.agg(F.count("*").cast("int").alias("ok")).join(F.broadcast(left.agg(F.count("*").alias("waiting"))), F.lit(True))


@query("SELECT id % 8 AS batch, count(*) FILTER (WHERE id % 50 <> 4) AS accepted, count(*) FILTER (WHERE id % 50 = 4) AS rejected FROM r GROUP BY 1")
def s8_batch_receipt(spark, sf_dir):
    return s.batch_receipt(_broken(spark, sf_dir).withColumn("batch", F.col("id") % 8), "batch").select("batch", "accepted", "rejected")


@query("WITH x AS (SELECT 'u' || user_id AS user_id, max_by(event_id, ts) AS last FROM events GROUP BY 1) SELECT user_id, CAST(last AS VARCHAR) AS last FROM x")
def s9_current_view(spark, sf_dir):
    path = new_path(spark, "logs")
    s.write_partitioned(sec_events(spark, sf_dir), path)
    return s.current_view(spark.read.parquet(path), "user_id", "us", "id").select("user_id", F.col("id").alias("last"))


@query("WITH x AS (SELECT 1) SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'stored' ELSE 'builtin' END AS origin FROM customer")
def s10_reference_tables(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    base.filter("k % 3 = 0").withColumn("origin", F.lit("stored")).write.parquet(path := new_path(spark, "reference"))
    return s.load_reference_table(spark, path, base.withColumn("origin", F.lit("builtin")), ["k"])

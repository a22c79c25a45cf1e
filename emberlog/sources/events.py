"""Security events: the canonical log schema, and the view of it over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CANONICAL_LOG = "id string, ts timestamp, source string, source_type string, severity string, message string, host string, ip_address string, user_id string, process_name string, event_type string, raw_log string, tags array<string>, parsed_fields map<string,string>, parse_format string, parse_error string"

#: One text for Spark and for the SQL that checks it.
SEC_EVENTS_SQL = """
SELECT CAST(event_id AS STRING) AS id, ts, 'app' AS source,
  CASE event_type WHEN 'error' THEN 'ssh_login_failure' WHEN 'signup' THEN 'auth_success'
    WHEN 'click' THEN 'http_access' WHEN 'view' THEN 'file_access' ELSE 'data_exfiltration' END AS event_type,
  CASE event_type WHEN 'error' THEN 'warning' WHEN 'purchase' THEN 'error' ELSE 'info' END AS severity,
  'u' || CAST(user_id AS STRING) AS user_id,
  'h' || CAST(user_id % 20 AS STRING) AS host,
  '192.0.2.' || CAST(user_id % 60 AS STRING) AS ip_address,
  CASE WHEN event_type = 'error' THEN 'Failed password for u' || CAST(user_id AS STRING) || ' port 22 ssh2'
    WHEN event_type = 'click' AND event_id % 7 = 0 THEN 'GET /../../etc/passwd HTTP/1.1'
    WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'q=1 UNION ALL SELECT pw'
    WHEN event_type = 'signup' AND event_id % 9 = 0 THEN 'sudo -i session opened'
    ELSE 'ok ' || event_type END AS message,
  value AS bytes,
  CASE event_id % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' ELSE 'US' END AS country
FROM {events}
"""


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table in the shape of normalised security logs; ``ts`` in UTC, ``us`` its microseconds."""
    df = spark.sql(SEC_EVENTS_SQL.format(events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return df.selectExpr("* EXCEPT (ts)", "CAST(ts AS TIMESTAMP) AS ts", "unix_micros(CAST(ts AS TIMESTAMP)) AS us")

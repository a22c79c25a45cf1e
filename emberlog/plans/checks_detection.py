"""Queries over the driver's tables for rules, intelligence, anomaly, detection and scoring, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import intel, rules, scoring
from emberlog.plans.detection import detect_threats, detection_rate
from emberlog.sources.events import SEC_EVENTS_SQL, sec_events

HOUR = 3_600_000_000
QUERIES: dict = {}
SQL: dict[str, str] = {}
E_SQL = "e AS (" + SEC_EVENTS_SQL.replace("STRING", "VARCHAR").format(events="events") + ")"


def query(sql: str | None = None):
    """Register a function as a query under its name; ``{e}`` in the SQL stands for the security events."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + E_SQL + sql if sql.lstrip().startswith(",") else "WITH " + E_SQL + " " + sql
        return f

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SIGNATURE = rules.RuleSpec("R-1", "signature", "high", 90, "T1110", {"field": "event_type", "value": "SSH_Login_Failure", "fields": {"severity": "warning"}})
PATTERN = rules.RuleSpec("R-2", "pattern", "high", 85, "T1083", {"field": "message", "pattern": r"/etc/(passwd|shadow|sudoers|crontab)"})
THRESHOLD = rules.RuleSpec("R-3", "threshold", "high", 80, "T1110", {"field": "ip_address", "threshold": 5, "window_seconds": 86400, "filter": {"event_type": "ssh_login_failure"}})
STATISTICAL = rules.RuleSpec("R-4", "statistical", "medium", 60, "T1048", {"field": "bytes", "z_threshold": 2.0, "min_samples": 50})
ALL_RULES = (SIGNATURE, PATTERN, THRESHOLD, STATISTICAL)

COUNTED = """, k AS (SELECT *, count(*) OVER (PARTITION BY ip_address ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY ip_address, ts) + row_number() OVER (PARTITION BY ip_address, ts ORDER BY id) AS n
  FROM e WHERE event_type = 'ssh_login_failure')"""
ROLLED = """, z0 AS (SELECT *, count(bytes) OVER w AS n, avg(bytes) OVER w AS m, stddev_pop(bytes) OVER w AS s
  FROM e WINDOW w AS (ORDER BY ts, id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, CASE WHEN n >= 50 AND s > 0 THEN abs(bytes - m) / s END AS z FROM z0)"""


def _one(spark, sf_dir, spec):
    df = rules.evaluate_rules(sec_events(spark, sf_dir), [spec])
    return df.select("id", F.explode("matches").alias("m")).select("id", "m.rule_id", F.round("m.confidence", 6).alias("confidence"), "m.matched")


@query("SELECT id, 'R-1' AS rule_id, 0.9 AS confidence, event_type AS matched FROM e WHERE lower(event_type) = 'ssh_login_failure' AND severity = 'warning'")
def r1_signature_rule(spark, sf_dir):
    return _one(spark, sf_dir, SIGNATURE)


@query(r"SELECT id, 'R-2' AS rule_id, 0.85 AS confidence, regexp_extract(message, '/etc/(passwd|shadow|sudoers|crontab)', 0) AS matched FROM e WHERE regexp_matches(message, '/etc/(passwd|shadow|sudoers|crontab)')")
def r2_pattern_rule(spark, sf_dir):
    return _one(spark, sf_dir, PATTERN)


@query(COUNTED + " SELECT id, 'R-3' AS rule_id, round(least(1.0, n / 10.0), 6) AS confidence, ip_address AS matched FROM k WHERE n >= 5")
def r3_threshold_rule(spark, sf_dir):
    return _one(spark, sf_dir, THRESHOLD)


@query(ROLLED + " SELECT id, 'R-4' AS rule_id, round(least(1.0, (z - 2.0) / 2.0 + 0.6), 6) AS confidence FROM z WHERE z >= 2.0")
def r4_statistical_rule_global(spark, sf_dir):
    return _one(spark, sf_dir, STATISTICAL).drop("matched")


@query(ROLLED.replace("(ORDER BY ts", "(PARTITION BY event_type ORDER BY ts") + " SELECT id, round(z, 6) AS z FROM z WHERE z >= 2.0")
def r4_statistical_rule_keyed(spark, sf_dir):
    df = rules.with_rolling_z(sec_events(spark, sf_dir), "bytes", "z", 50, keys=["event_type"])
    return df.filter("z >= 2.0").select("id", F.round("z", 6).alias("z"))


ALL_MATCHES = COUNTED + ROLLED + """, h AS (
  SELECT id, 'R-1' AS rule_id, 0.9 AS confidence FROM e WHERE event_type = 'ssh_login_failure' AND severity = 'warning'
  UNION ALL SELECT id, 'R-2', 0.85 FROM e WHERE regexp_matches(message, '/etc/(passwd|shadow|sudoers|crontab)')
  UNION ALL SELECT id, 'R-3', least(1.0, n / 10.0) FROM k WHERE n >= 5
  UNION ALL SELECT id, 'R-4', least(1.0, (z - 2.0) / 2.0 + 0.6) FROM z WHERE z >= 2.0)"""


@query(ALL_MATCHES + " SELECT id, string_agg(rule_id, ',' ORDER BY rule_id) AS rules, count(*) AS n FROM h GROUP BY id")
def r5_evaluate_rules(spark, sf_dir):
    df = rules.evaluate_rules(sec_events(spark, sf_dir), ALL_RULES).filter("size(matches) > 0")
    return df.select("id", F.array_join("matches.rule_id", ",").alias("rules"), F.size("matches").cast("long").alias("n"))


@query(ALL_MATCHES + """ SELECT r.rule_id, CAST(count(h.id) AS BIGINT) AS hits, max(e.ts) AS last_triggered, round(count(h.id) / (SELECT count(*) FROM e), 6) AS match_rate
  FROM (VALUES ('R-1'), ('R-2'), ('R-3'), ('R-4')) r(rule_id) LEFT JOIN h ON h.rule_id = r.rule_id LEFT JOIN e ON e.id = h.id GROUP BY r.rule_id""")
def r6_rule_statistics(spark, sf_dir):
    df = rules.rule_statistics(rules.evaluate_rules(sec_events(spark, sf_dir), ALL_RULES), ALL_RULES)
    return df.select("rule_id", "hits", F.col("last_triggered").cast("timestamp_ntz").alias("last_triggered"), "match_rate")


TI = """, ti AS (SELECT '192.0.2.' || CAST(i AS VARCHAR) AS ip, 55.0 + i % 30 AS score, CASE WHEN i % 2 = 0 THEN 'test_scanner' ELSE 'test_suspicious' END AS category FROM range(3, 45) t(i))"""


@query(TI + " SELECT id, ti.score AS ti_score, ti.category AS ti_category FROM e LEFT JOIN ti ON trim(ip_address) = ti.ip")
def t1_ip_reputation(spark, sf_dir):
    return intel.ip_reputation(sec_events(spark, sf_dir), intel.builtin_indicators(spark)).select("id", "ti_score", "ti_category")


DOMAINS = [("example.net", "domain", "test", 61.0, [], True), ("ads-track.example.com", "domain", "ads", 72.0, [], True), ("example.com", "domain", "base", 40.0, [], True)]
HOSTS = ", h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages)"
KNOWN = ", d AS (SELECT * FROM (VALUES ('example.net', 61.0, 'test'), ('ads-track.example.com', 72.0, 'ads'), ('example.com', 40.0, 'base')) v(name, score, category))"


@query(HOSTS + KNOWN + """, m AS (SELECT page_id, host, name, score, category, row_number() OVER (PARTITION BY page_id ORDER BY length(name) DESC) AS r
  FROM h JOIN d ON host = name OR ends_with(host, '.' || name)) SELECT page_id, host AS domain, name AS indicator, score, category FROM m WHERE r = 1""")
def t2_domain_reputation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)).alias("host"))
    known = spark.createDataFrame(DOMAINS, intel.INDICATOR)
    return intel.domain_reputation(pages, known, "host", "page_id").select("page_id", "domain", "indicator", "score", "category")


@query(""", f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'))) AS v FROM documents) SELECT doc_id, v AS value FROM f""".replace("\\\\", "\\"))
def t3_ioc_extraction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return intel.extract_iocs(docs, F.col("text"), "doc_id").filter("kind = 'ip'").select("doc_id", "value")


@query(TI + """ SELECT id, ip_address AS value, score, category FROM e JOIN ti ON ip_address = ti.ip""")
def t3_ioc_matches(spark, sf_dir):
    df = sec_events(spark, sf_dir)
    return intel.ioc_matches(df, F.concat_ws(" ", "message", "ip_address", "host"), intel.builtin_indicators(spark)).select("id", "value", "score", "category")


@query(r"""SELECT id, concat_ws(',', CASE WHEN regexp_matches(message, 'union.{0,20}select', 'i') THEN 'SIG_SQLI_UNION' END,
  CASE WHEN regexp_matches(message, '\.\./|%2e%2e%2f', 'i') THEN 'SIG_PATH_TRAVERSAL' END) AS signatures FROM e WHERE regexp_matches(message, 'union.{0,20}select|\.\./|%2e%2e%2f', 'i')""")
def t4_attack_signatures(spark, sf_dir):
    df = sec_events(spark, sf_dir).withColumn("hits", intel.signature_hits(F.col("message"))).filter("size(hits) > 0")
    return df.select("id", F.array_join("hits.signature", ",").alias("signatures"))


@query("SELECT id, v AS value FROM e, (VALUES ('port 22'), ('ETC/passwd'), ('zz'), ('ok')) x(v) WHERE contains(lower(message), lower(v))")
def t5_substring_indicators(spark, sf_dir):
    values = spark.createDataFrame([("port 22",), ("ETC/passwd",), ("zz",), ("ok",)], "value string")
    return intel.substring_matches(sec_events(spark, sf_dir), "message", values)


@query("SELECT id, v AS value FROM e, (SELECT DISTINCT v FROM (SELECT 'U' || c_custkey AS v FROM customer UNION ALL SELECT 'for u' || c_custkey || ' Port' FROM customer) y) x WHERE contains(message, 'for u') AND contains(lower(message), lower(v))")
def t5_substring_indicators_long(spark, sf_dir):
    """Thousands of values that overlap and begin alike: one automaton for all."""
    values = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.explode(F.array(F.concat(F.lit("U"), "c_custkey"), F.concat(F.lit("for u"), "c_custkey", F.lit(" Port")))).alias("value"))
    return intel.substring_matches(sec_events(spark, sf_dir).filter(F.contains("message", F.lit("for u"))), "message", values)


@query(TI + """ SELECT id, CAST(CASE WHEN score IS NULL THEN 0 ELSE 1 END AS BIGINT) AS ioc_count, score AS ti_score, coalesce(category, '') AS categories,
  CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 AND severity <> 'critical' THEN 'high' ELSE severity END AS severity FROM e LEFT JOIN ti ON ip_address = ti.ip""")
def t6_enrich(spark, sf_dir):
    df = intel.enrich(sec_events(spark, sf_dir), F.col("ip_address"), intel.builtin_indicators(spark))
    return df.select("id", "ioc_count", "ti_score", F.coalesce(F.array_join("ti_categories", ","), F.lit("")).alias("categories"), "severity")


@query("""SELECT event_type, CASE event_type WHEN 'ssh_login_failure' THEN 'T1110' WHEN 'file_access' THEN 'T1083' WHEN 'data_exfiltration' THEN 'T1048' END AS technique,
  CASE event_type WHEN 'ssh_login_failure' THEN 'Credential Access' WHEN 'file_access' THEN 'Discovery' WHEN 'data_exfiltration' THEN 'Exfiltration' END AS tactic, count(*) AS n FROM e GROUP BY event_type""")
def t7_technique_lookup(spark, sf_dir):
    named = scoring.mapped(F.col("event_type"), {"ssh_login_failure": "T1110", "file_access": "T1083", "data_exfiltration": "T1048"}, None)
    counted = sec_events(spark, sf_dir).groupBy("event_type", named.cast("string").alias("technique")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(intel.techniques(spark)), "technique", "left").select("event_type", "technique", "tactic", "n")


@query(HOSTS + " SELECT * FROM (SELECT 'domain' AS indicator_type, 10 + count(DISTINCT host) AS n FROM h WHERE host <> '' UNION ALL SELECT 'ip', 108) t")
def t8_indicator_upsert(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)).alias("indicator")).filter("indicator <> ''").distinct()
    added = pages.selectExpr("indicator", "'domain' AS indicator_type", "'seen' AS category", "50D AS score", "CAST(array() AS array<string>) AS techniques", "true AS custom")
    return intel.upsert_indicators(intel.builtin_indicators(spark), added).groupBy("indicator_type").agg(F.count("*").alias("n"))


#: The features that vary over the view, as SQL; the other ones are constants.
FEATURE_SQL = {
    "message_length": "length(message)", "severity_code": "CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END", "hour": "hour(ts)", "n_special": r"length(message) - length(regexp_replace(message, '[!@#$%^&*()\[\]{}|;:<>?]', '', 'g'))",
    "digit_ratio": "(length(message) - length(regexp_replace(message, '[0-9]', '', 'g'))) / greatest(length(message), 1)", "upper_ratio": "(length(message) - length(regexp_replace(message, '[A-Z]', '', 'g'))) / greatest(length(message), 1)",
    "type_bucket": "CAST('0x' || substr(md5(event_type), 1, 8) AS BIGINT) % 10", "bytes": "coalesce(bytes, 0)",
}
FEATURES_SQL = ", f AS (SELECT *, " + ", ".join(f"CAST({v} AS DOUBLE) AS f_{k}" for k, v in FEATURE_SQL.items()) + " FROM e)"
CONSTANTS = {"raw_length": 0, "source_code": 2, "has_ip": 1, "has_user": 1, "has_process": 0, "n_parsed": 0, "status_class": 0}


@query(FEATURES_SQL + " SELECT id, " + ", ".join(f"round(f_{k}, 6) AS f_{k}" for k in FEATURE_SQL) + ", " + ", ".join(f"CAST({v} AS DOUBLE) AS f_{k}" for k, v in CONSTANTS.items()) + " FROM f")
def a1_features(spark, sf_dir):
    df = scoring.extract_features(sec_events(spark, sf_dir))
    return df.select("id", *(F.round(f"f_{k}", 6).alias(f"f_{k}") for k in scoring.FEATURES))


ENTITY_SQL = FEATURES_SQL + ", m AS (" + " UNION ALL ".join(f"SELECT id, ts, '{k}:' || {k} AS k, {', '.join(f'f_{f}' for f in FEATURE_SQL)} FROM f" for k in ("host", "source", "user_id")) + "), s AS (SELECT id, count(*) OVER w AS n, (" + " + ".join(f"abs(f_{f} - avg(f_{f}) OVER w) / (coalesce(stddev_pop(f_{f}) OVER w, 0) + 1e-6)" for f in FEATURE_SQL) + """) / 15 AS z
  FROM m WINDOW w AS (PARTITION BY k ORDER BY ts, id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)), u AS (SELECT id, avg(z) AS z, avg(least(1.0, z / 5)) AS es FROM s WHERE n >= 10 GROUP BY id)"""


@query(ENTITY_SQL + " SELECT e.id, round(z, 6) AS z, round(es, 5) AS entity_score FROM e LEFT JOIN u ON u.id = e.id")
def a2_entity_baseline_all(spark, sf_dir):
    df = scoring.entity_z(scoring.extract_features(sec_events(spark, sf_dir)))
    return df.select("id", "z", F.round(scoring.mean_of(F.col("entity_scores")), 5).alias("entity_score"))


@query(""", f AS (SELECT *, CAST(length(message) AS DOUBLE) AS a, coalesce(bytes, 0) AS b FROM e),
m AS (SELECT id, ts, 'host:' || host AS k, a, b FROM f UNION ALL SELECT id, ts, 'user_id:' || user_id, a, b FROM f),
s AS (SELECT id, count(*) OVER w AS n, (abs(a - avg(a) OVER w) / (coalesce(stddev_pop(a) OVER w, 0) + 1e-6) + abs(b - avg(b) OVER w) / (coalesce(stddev_pop(b) OVER w, 0) + 1e-6)) / 2 AS z
  FROM m WINDOW w AS (PARTITION BY k ORDER BY ts, id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING))
SELECT id, round(avg(CASE WHEN n >= 10 THEN z END), 6) AS z FROM s GROUP BY id""")
def a2_entity_baseline(spark, sf_dir):
    df = scoring.entity_z(scoring.extract_features(sec_events(spark, sf_dir)), ["host", "user_id"], ["message_length", "bytes"])
    return df.select("id", "z")


FREQUENCY = """, c AS (SELECT *, count(*) OVER (PARTITION BY source, event_type ORDER BY ts RANGE BETWEEN INTERVAL {window} PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY source, event_type, ts) + row_number() OVER (PARTITION BY source, event_type, ts ORDER BY id) AS recent FROM e),
q AS (SELECT *, CASE WHEN count(recent) OVER w >= 20 THEN least(1.0, abs(recent - avg(recent) OVER w) / (stddev_pop(recent) OVER w + 1e-6) / 5) ELSE 0.0 END AS fs
  FROM c WINDOW w AS (PARTITION BY source, event_type ORDER BY ts, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""


@query(FREQUENCY.format(window="60 SECOND") + " SELECT id, recent, round(fs, 5) AS frequency_score FROM q")
def a6_frequency_anomaly_minute(spark, sf_dir):
    return scoring.frequency_anomaly(sec_events(spark, sf_dir)).select("id", "recent", F.round("frequency_score", 5).alias("frequency_score"))


@query(FREQUENCY.format(window="6 HOUR") + " SELECT id, recent, round(fs, 5) AS frequency_score FROM q")
def a6_frequency_anomaly(spark, sf_dir):
    return scoring.frequency_anomaly(sec_events(spark, sf_dir), 6 * HOUR).select("id", "recent", F.round("frequency_score", 5).alias("frequency_score"))


@query(FREQUENCY.format(window="6 HOUR") + " SELECT id, round((fs + least(1.0, bytes / 1000)) / 2, 8) AS anomaly FROM q WHERE bytes IS NOT NULL")
def a5_combined_score(spark, sf_dir):
    df = scoring.frequency_anomaly(sec_events(spark, sf_dir).filter("bytes IS NOT NULL"), 6 * HOUR)
    return df.select("id", F.round(scoring.combined_anomaly(F.col("frequency_score"), F.lit(None).cast("double"), F.least(F.lit(1.0), F.col("bytes") / 1000)), 8).alias("anomaly"))


@query("SELECT count(*) AS n FROM e WHERE NOT (host = 'h3' AND starts_with(event_type, 'ssh')) AND user_id <> 'u7'")
def d1_whitelist(spark, sf_dir):
    df = sec_events(spark, sf_dir)
    return df.filter(~scoring.whitelisted(df, (("host", ("h3",), "ssh"), ("user_id", ("u7",), None)))).agg(F.count("*").alias("n"))


@query(r"""SELECT id, CASE WHEN regexp_matches(message, '(/etc/shadow|/etc/passwd|sam\.hive)', 'i') THEN 25.0 ELSE 0.0 END + CASE WHEN regexp_matches(message, '\b(privilege.?escalat|sudo.?-i|suid)\b', 'i') THEN 25.0 ELSE 0.0 END AS points
  FROM e WHERE regexp_matches(message, '(/etc/shadow|/etc/passwd|sam\.hive)|\b(privilege.?escalat|sudo.?-i|suid)\b', 'i')""")
def d2_threat_keywords(spark, sf_dir):
    df = sec_events(spark, sf_dir).withColumn("k", scoring.keyword_hits(F.col("message"))).filter("size(k) > 0")
    return df.select("id", F.aggregate("k", F.lit(0.0), lambda a, x: a + x["points"]).alias("points"))


UBA = """, u AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 120 HOUR PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, ts) + row_number() OVER (PARTITION BY user_id, ts ORDER BY id) - 1 AS al,
  count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 120 HOUR PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, event_type, ts) + row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY id) - 1 AS own FROM e),
d AS (SELECT *, CASE WHEN al >= 10 THEN greatest(0.0, 1 - 5.0 * own / al) ELSE 0.0 END AS deviation FROM u)"""


@query(UBA + " SELECT id, round(deviation, 6) AS deviation FROM d WHERE deviation > 0")
def d3_user_deviation(spark, sf_dir):
    return scoring.user_deviation(sec_events(spark, sf_dir), 120 * HOUR).filter("deviation > 0").select("id", F.round("deviation", 6).alias("deviation"))


def _hits(spec: rules.RuleSpec) -> str:
    """Confidence of a built-in rule's match as SQL over ``e`` joined with its counts; null without one."""
    c = spec.condition
    if spec.type == "pattern":
        return f"CASE WHEN regexp_matches({c['field']}, '{c['pattern']}', 'i') THEN 0.85 END"
    if spec.type == "signature":
        wanted = {c["field"]: c["value"]} | c.get("fields", {})
        return "CASE WHEN " + " AND ".join(f"lower({k}) = '{v}'" for k, v in wanted.items()) + " THEN 0.9 END"
    if spec.type == "threshold":
        return f"CASE WHEN {spec.id[:3]}{spec.id[4:]}.n >= {c['threshold']} THEN least(1.0, {spec.id[:3]}{spec.id[4:]}.n / {2.0 * c['threshold']}) END"
    return f"CASE WHEN z.z >= {c['z_threshold']} THEN least(1.0, (z.z - {c['z_threshold']}) / {c['z_threshold']} + 0.6) END"


def _counts(spec: rules.RuleSpec) -> str:
    c = spec.condition
    kept = " AND ".join(["ip_address <> ''", *(f"lower({k}) = '{v}'" for k, v in c.get("filter", {}).items())])
    return f""", {spec.id[:3]}{spec.id[4:]} AS (SELECT id, count(*) OVER (PARTITION BY ip_address ORDER BY ts RANGE BETWEEN INTERVAL {c['window_seconds']} SECOND PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY ip_address, ts) + row_number() OVER (PARTITION BY ip_address, ts ORDER BY id) AS n FROM e WHERE {kept})"""


THRESHOLDS = [r for r in rules.BUILTIN_RULES if r.type == "threshold"]
BUILTIN = ROLLED + "".join(map(_counts, THRESHOLDS)) + ", b AS (SELECT e.*, " + ", ".join(f"{_hits(r)} AS h{i}" for i, r in enumerate(rules.BUILTIN_RULES)) + " FROM e LEFT JOIN (SELECT id, z FROM z) z ON z.id = e.id" + "".join(f" LEFT JOIN {r.id[:3]}{r.id[4:]} ON {r.id[:3]}{r.id[4:]}.id = e.id" for r in THRESHOLDS) + ")"
BY_PRIORITY = sorted(range(len(rules.BUILTIN_RULES)), key=lambda i: -rules.BUILTIN_RULES[i].priority)


def _flagship_events(spark, sf_dir):
    """The view with the number that a built-in rule reads from the parsed fields."""
    return sec_events(spark, sf_dir).withColumn("parsed_fields", F.create_map(F.lit("bytes"), F.col("bytes").cast("string")))


@query(BUILTIN + ", r AS (SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN h{i} IS NOT NULL THEN '{rules.BUILTIN_RULES[i].id}' END" for i in BY_PRIORITY) + ") AS rules, round(" + " + ".join(f"coalesce(h{i}, 0)" for i in BY_PRIORITY) + ", 6) AS confidence FROM b) SELECT * FROM r WHERE rules <> ''")
def r5_builtin_rules(spark, sf_dir):
    df = rules.evaluate_rules(_flagship_events(spark, sf_dir)).filter("size(matches) > 0")
    return df.select("id", F.array_join("matches.rule_id", ",").alias("rules"), F.round(F.aggregate("matches", F.lit(0.0), lambda a, m: a + m["confidence"]), 6).alias("confidence"))


POINTS = " + ".join(f"{scoring.RULE_POINTS[r.severity]} * coalesce(h{i}, 0)" for i, r in enumerate(rules.BUILTIN_RULES))
KEYWORD_POINTS = " + ".join(f"CASE WHEN regexp_matches(b.message, '{p}', 'i') THEN {x} ELSE 0 END" for p, _, x in scoring.KEYWORDS)
RULED = " OR ".join(f"h{i} IS NOT NULL" for i in BY_PRIORITY)
USUAL = UBA.replace("120 HOUR", "1 HOUR").replace(", u AS (", ", ub AS (").replace("FROM u)", "FROM ub)")
LEVEL_OF_RISK = "CASE WHEN x >= 80 THEN 'critical' WHEN x >= 60 THEN 'high' WHEN x >= 40 THEN 'medium' WHEN x >= 20 THEN 'low' ELSE 'info' END"
NAMES = {r.technique for r in rules.BUILTIN_RULES}


def _risk(anomaly: str, joined: str) -> str:
    """Alerts ``a(id, event_type, x, anomaly, ruled)``; ``joined`` adds the table that the anomaly score comes from."""
    return f""", r AS (SELECT b.*, deviation, ti.score IS NOT NULL AS listed, {anomaly} AS anomaly, {POINTS} + {KEYWORD_POINTS} + CASE WHEN ti.score IS NOT NULL THEN 30 ELSE 0 END
    + CASE WHEN deviation > 0.5 THEN 20 * deviation ELSE 0 END + CASE WHEN {anomaly} > 0.6 THEN 25 * {anomaly} ELSE 0 END AS points, {RULED} AS ruled
  FROM b JOIN d ON d.id = b.id LEFT JOIN ti ON ti.ip = b.ip_address {joined}),
g AS (SELECT *, least(100.0, points) AS x FROM r), a AS (SELECT * FROM g WHERE x >= 10 AND (ruled OR x / 100 >= 0.3))"""


RISK = BUILTIN + TI + USUAL + ENTITY_SQL + _risk("u.es", "LEFT JOIN u ON u.id = b.id")
#: With the frequency as the only score, it is often high enough to count.
RATED = BUILTIN + TI + USUAL + FREQUENCY.format(window="60 SECOND") + _risk("q.fs", "JOIN q ON q.id = b.id")


def _alerts(spark, sf_dir):
    return detect_threats(_flagship_events(spark, sf_dir), intel.builtin_indicators(spark))


def _rated_alerts(spark, sf_dir):
    df = scoring.frequency_anomaly(_flagship_events(spark, sf_dir))
    return detect_threats(df, intel.builtin_indicators(spark), entities=(), scores=("frequency_score",))


TECHNIQUES = "concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(f'h{i} IS NOT NULL' for i, r in enumerate(rules.BUILTIN_RULES) if r.technique == t)} THEN '{t}' END" for t in sorted(NAMES)) + ")"


@query(RISK + f" SELECT id, round(x, 4) AS risk, {LEVEL_OF_RISK} AS severity, round(anomaly, 5) AS anomaly, {TECHNIQUES} AS techniques FROM a")
def d7_detect_threats(spark, sf_dir):
    return _alerts(spark, sf_dir).select("id", F.round("risk", 4).alias("risk"), F.col("risk_severity").alias("severity"), F.round("anomaly", 5).alias("anomaly"), F.array_join("techniques", ",").alias("techniques"))


@query(RISK + f" SELECT {LEVEL_OF_RISK} AS severity, count(*) AS n FROM a GROUP BY 1")
def d6_severity_bands(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy(F.col("risk_severity").alias("severity")).agg(F.count("*").alias("n"))


@query(RISK + " SELECT (SELECT count(*) FROM e) AS events, count(*) AS alerts, round(count(*) / (SELECT count(*) FROM e), 6) AS rate FROM a")
def d5_alert_gate_rate(spark, sf_dir):
    return detection_rate(sec_events(spark, sf_dir), _alerts(spark, sf_dir))


@query(RATED + " SELECT id, event_type, round(x, 4) AS risk, ruled, anomaly > 0.6 AS strange FROM a")
def d4_risk_composition(spark, sf_dir):
    return _rated_alerts(spark, sf_dir).select("id", "event_type", F.round("risk", 4).alias("risk"), (F.size("matches") > 0).alias("ruled"), F.array_contains("reasons", "anomaly").alias("strange"))


SCORE = TI + """, w AS (SELECT *, count(*) OVER (PARTITION BY source, event_type ORDER BY ts RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY source, event_type, ts) + row_number() OVER (PARTITION BY source, event_type, ts ORDER BY id) AS n,
  count(*) OVER (PARTITION BY user_id, host ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS al, count(*) OVER (PARTITION BY user_id, host, event_type ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM e),
p AS (SELECT w.id, CASE severity WHEN 'info' THEN 10.0 WHEN 'warning' THEN 40.0 ELSE 70.0 END AS b, CASE WHEN event_type = 'ssh_login_failure' THEN 75 * 0.9 END AS m,
  CASE WHEN n <= 2 THEN 20.0 WHEN n <= 5 THEN 45.0 WHEN n <= 10 THEN 70.0 ELSE 90.0 END AS f, CASE WHEN al < 20 THEN 30.0 WHEN own / al >= 0.2 THEN 20.0 WHEN own / al >= 0.05 THEN 45.0 WHEN own / al >= 0.02 THEN 65.0 ELSE 85.0 END AS h,
  CASE WHEN bytes IS NULL THEN 25.0 WHEN bytes <= 1 THEN round(greatest(0, bytes) * 100, 2) ELSE round(least(100.0, bytes), 2) END AS a, coalesce(ti.score, 10.0) AS t FROM w LEFT JOIN ti ON ti.ip = w.ip_address),
s AS (SELECT *, round(CASE WHEN m IS NULL THEN b ELSE least(100.0, b + m * 0.5) END, 2) AS sv FROM p)"""


def _scored(spark, sf_dir):
    df = rules.evaluate_rules(sec_events(spark, sf_dir), [SIGNATURE]).withColumn("anomaly", F.col("bytes"))
    return scoring.threat_score(intel.ip_reputation(df, intel.builtin_indicators(spark)))


@query(SCORE + " SELECT id, sv AS p_severity, f AS p_frequency, h AS p_history FROM s")
def p1_p3_score_factors(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "p_severity", F.col("p_frequency"), F.col("p_historical_behavior").alias("p_history"))


@query(SCORE + " SELECT id, a AS p_anomaly, t AS p_intel FROM s")
def p4_score_factors(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", F.col("p_anomaly_deviation").alias("p_anomaly"), F.col("p_threat_intel").alias("p_intel"))


@query(SCORE + """, x AS (SELECT *, round(0.25 * sv + 0.2 * f + 0.2 * h + 0.2 * a + 0.15 * t, 2) AS sc, greatest(sv, f, h, a, t) AS most FROM s),
y AS (SELECT *, CASE WHEN sc >= 80 THEN 'Critical' WHEN sc >= 60 THEN 'High' WHEN sc >= 40 THEN 'Medium' ELSE 'Low' END AS level,
  CASE most WHEN sv THEN 'severity' WHEN f THEN 'frequency' WHEN h THEN 'historical_behavior' WHEN a THEN 'anomaly_deviation' ELSE 'threat_intel' END AS dominant FROM x)
SELECT id, round(sc, 1) AS score, level, dominant, true AS explained FROM y""")
def p5_threat_score(spark, sf_dir):
    explained = F.col("explanation").startswith(F.concat("level", F.lit(" threat ("))) & F.col("explanation").endswith(F.concat(F.lit("main factor: "), "dominant"))
    return _scored(spark, sf_dir).select("id", F.round("score", 1).alias("score"), "level", "dominant", explained.alias("explained"))


@query("SELECT id, round(greatest(0, least(100, 0.7 * 0.9 * (1 + event_id % 3) * 0.5 * 100)), 4) AS risk FROM (SELECT id, CAST(id AS BIGINT) AS event_id FROM e) t")
def p6_simple_risk(spark, sf_dir):
    risk = scoring.simple_risk(F.lit(0.7), F.lit(0.9), (1 + F.col("id").cast("long") % 3) * 0.5)
    return sec_events(spark, sf_dir).select("id", F.round(risk, 4).alias("risk"))

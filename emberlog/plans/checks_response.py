"""Queries over the driver's tables for alerts, incidents, memory, analysis and searches, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.storage import stage
from emberlog.operators import memory as m
from emberlog.operators import response as r
from emberlog.operators import search as q
from emberlog.operators import rules, scoring
from emberlog.plans.checks_detection import BY_PRIORITY, E_SQL, RISK, TECHNIQUES, _alerts, table
from emberlog.sources.events import sec_events

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = 1_706_745_600_000_000  # 2024-02-01


def query(sql: str | None = None, recursive: bool = False):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{E_SQL}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return put


REASONS = "concat_ws('; ', " + ", ".join([*(f"CASE WHEN h{i} IS NOT NULL THEN 'rule:{rules.BUILTIN_RULES[i].id}' END" for i in BY_PRIORITY), *(f"CASE WHEN regexp_matches(message, '{p}', 'i') THEN 'keyword:{n}' END" for p, n, _ in scoring.KEYWORDS), "CASE WHEN listed THEN 'malicious_ip' END", "CASE WHEN deviation > 0.5 THEN 'user_behaviour' END", "CASE WHEN anomaly > 0.6 THEN 'anomaly' END"]) + ")"
BAND = "CASE WHEN x >= 80 THEN 'critical' WHEN x >= 60 THEN 'high' WHEN x >= 40 THEN 'medium' WHEN x >= 20 THEN 'low' ELSE 'info' END"


@query(RISK + f""" SELECT id, 'Threat detected: ' || event_type AS title, {BAND} AS severity, {REASONS} AS description, {TECHNIQUES} AS techniques, round(x / 100, 6) AS confidence,
  'auto_generated,rule_based_detection' AS tags FROM a""")
def l1_build_alerts(spark, sf_dir):
    detected = stage(_alerts(spark, sf_dir), "alerts")
    alerts = r.build_alerts(detected)
    all_of = detected.select("id", F.array_join("techniques", ",").alias("techniques"))
    df = alerts.select(F.get("log_ids", 0).alias("id"), "title", "severity", "description", "technique", F.round("confidence", 6).alias("confidence"), F.array_join("tags", ",").alias("tags"))
    kept = df.join(all_of, "id").filter(F.coalesce("technique", F.lit("")) == F.substring_index("techniques", ",", 1))
    return kept.drop("technique")


@query(", h AS (SELECT *, sha256(ip_address || ':' || ':' || host || ':' || event_type || ':' || severity) AS h FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ts, id) AS n FROM h) SELECT id, h AS dedupe_hash FROM k WHERE n = 1")
def l2_dedupe_alerts(spark, sf_dir):
    df = sec_events(spark, sf_dir)
    return r.first_of_hash(df, r.dedupe_hash(F.col("ip_address"), F.lit(None), F.col("host"), F.col("event_type"), F.col("severity"))).select("id", "dedupe_hash")


LEVEL = "CASE severity WHEN 'error' THEN 'critical' WHEN 'warning' THEN 'high' ELSE 'low' END"


def _leveled(spark, sf_dir):
    df = sec_events(spark, sf_dir)
    level = F.when(F.col("severity") == "error", "critical").when(F.col("severity") == "warning", "high").otherwise("low")
    return df.withColumn("severity", level).withColumn("status", F.when(F.col("id").cast("long") % 5 == 0, "resolved").otherwise("open")).withColumn("attack_vector", F.col("event_type"))


LEVELED = f", v AS (SELECT id, ts, host, ip_address, user_id, event_type, message, {LEVEL} AS severity, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'resolved' ELSE 'open' END AS status FROM e)"


@query(LEVELED + " SELECT id, round(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 1 END / 4.0 * 0.8 * greatest(0.1, 1 - date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 3.6e9 / 48.0) * 100, 2) AS priority FROM v")
def l3_priority(spark, sf_dir):
    return _leveled(spark, sf_dir).select("id", r.priority(F.col("severity"), F.lit(0.8), r.age_hours(F.col("us"), AS_OF)).alias("priority"))


@query(LEVELED + ", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 SECOND OR host = lag(host) OVER w THEN 0 ELSE 1 END AS n FROM v WINDOW w AS (ORDER BY ts, id)) SELECT id, CAST(sum(n) OVER (ORDER BY ts, id) AS BIGINT) AS grp FROM g")
def l4_group_alerts(spark, sf_dir):
    return r.group_alerts(_leveled(spark, sf_dir), 30_000_000).select("id", "grp")


@query(LEVELED + ", d AS (SELECT *, date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 6e7 - CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 120 ELSE 1440 END AS over FROM v) SELECT severity, count(*) AS n, round(max(over), 1) AS most FROM d WHERE over > 0 AND status <> 'resolved' GROUP BY severity")
def l5_alert_breaches(spark, sf_dir):
    return r.breaches(r.deadlines(_leveled(spark, sf_dir)), AS_OF).groupBy("severity").agg(F.count("*").alias("n"), F.max("minutes_overdue").alias("most"))


@query(", c AS (SELECT user_id, max_by(event_type, ts) AS status, min(CASE WHEN event_type = 'file_access' THEN ts END) AS done FROM e GROUP BY user_id) SELECT user_id AS id, status, done IS NOT NULL AS resolved FROM c")
def l6_lifecycle(spark, sf_dir):
    changes = sec_events(spark, sf_dir).select(F.col("user_id").alias("id"), "us", F.col("id").alias("seq"), F.when(F.col("event_type") == "file_access", "resolved").otherwise(F.col("event_type")).alias("status"), F.col("host").alias("assignee"))
    back = F.when(F.col("status") == "resolved", "file_access").otherwise(F.col("status"))
    return r.lifecycle(changes).select("id", back.alias("status"), F.col("resolved_us").isNotNull().alias("resolved"))


@query(RISK + f", w AS (SELECT {BAND} AS severity FROM a) SELECT severity, count(*) AS n FROM w WHERE severity IN ('high', 'critical') GROUP BY severity")
def l7_escalate(spark, sf_dir):
    return r.escalate(r.build_alerts(_alerts(spark, sf_dir))).groupBy("severity").agg(F.count("*").alias("n"))


@query(LEVELED + " SELECT host AS grp, count(*) AS n, CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' ELSE 'low' END AS severity, CAST(1 AS BIGINT) AS hosts, count(DISTINCT event_type) AS vectors, CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 1 END) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' ELSE 'LOW' END || ' incident: ' || min(event_type) || ' on 1 host(s)' AS title FROM v GROUP BY host")
def i1_incidents(spark, sf_dir):
    return r.incidents_of(_leveled(spark, sf_dir), "host").select(F.col("host").alias("grp"), "n", "severity", "hosts", "vectors", "title")


@query(""", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, id) <= INTERVAL 60 SECOND THEN 0 ELSE 1 END AS new FROM e),
b AS (SELECT *, sum(new) OVER (ORDER BY ts, id) AS block FROM g),
f AS (SELECT block, arg_min(host, ts) AS h FROM b GROUP BY block),
l AS MATERIALIZED (SELECT f.block, coalesce(max(b.block), -1) AS last FROM f LEFT JOIN b ON b.host = f.h AND b.block < f.block GROUP BY f.block),
w AS (SELECT CAST(1 AS BIGINT) AS block, CAST(1 AS BIGINT) AS start, CAST(1 AS BIGINT) AS grp UNION ALL
  SELECT CAST(l.block AS BIGINT), CAST(CASE WHEN l.last < w.start THEN l.block ELSE w.start END AS BIGINT), w.grp + CASE WHEN l.last < w.start THEN 1 ELSE 0 END FROM w JOIN l ON l.block = w.block + 1)
SELECT grp, count(*) AS blocks FROM w GROUP BY grp""", recursive=True)
def i2_auto_group(spark, sf_dir):
    return r.auto_group(_leveled(spark, sf_dir), 60_000_000).groupBy("grp").agg(F.count("*").alias("blocks"))


@query(LEVELED + ", i AS (SELECT user_id, min(ts) AS ts, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 1 END) AS k FROM v GROUP BY user_id) SELECT count(*) AS n FROM i WHERE ts + CASE k WHEN 4 THEN INTERVAL 1 HOUR WHEN 3 THEN INTERVAL 4 HOUR ELSE INTERVAL 72 HOUR END < TIMESTAMP '2024-01-03'")
def i3_incident_breaches(spark, sf_dir):
    return r.breaches(r.incidents_of(_leveled(spark, sf_dir), "user_id"), 1_704_240_000_000_000).agg(F.count("*").alias("n"))


@query("SELECT user_id AS id, id AS seq, row_number() OVER w AS nth, least(3, count(*) FILTER (WHERE severity = 'error') OVER w) AS steps FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)")
def i4_timeline(spark, sf_dir):
    events = sec_events(spark, sf_dir).select(F.col("user_id").alias("id"), "us", F.col("id").alias("seq"), F.when(F.col("severity") == "error", "escalate").otherwise("note").alias("action"), F.col("host").alias("actor"))
    return r.timeline(events).select("id", "seq", "nth", "steps")


@query("SELECT DISTINCT host, 'ip' AS kind, ip_address AS value FROM e UNION ALL SELECT DISTINCT host, 'host', host FROM e UNION ALL SELECT DISTINCT host, 'user', user_id FROM e")
def i5_containment(spark, sf_dir):
    df = sec_events(spark, sf_dir)
    return r.containment(df.select("*", F.col("host").alias("grp")), "grp").select(F.col("grp").alias("host"), "kind", "value")


@query("SELECT id, CASE WHEN event_type = 'data_exfiltration' THEN 'pb-data-breach' WHEN event_type = 'ssh_login_failure' THEN 'pb-brute-force' ELSE 'pb-malware' END AS playbook FROM e")
def i6_playbooks(spark, sf_dir):
    vector = F.when(F.col("event_type") == "ssh_login_failure", "brute_force").otherwise(F.col("event_type"))
    return r.recommend_playbook(sec_events(spark, sf_dir).withColumn("attack_vector", vector).select("id", "attack_vector"), "id")


TERMS = """, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), t AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
f AS (SELECT w.doc_id, term, count(*) / n AS tf FROM w JOIN t ON t.doc_id = w.doc_id GROUP BY w.doc_id, term, n), d AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM f GROUP BY term)"""


@query(TERMS + """, x AS (SELECT doc_id, f.term, tf * idf AS w FROM f JOIN d ON d.term = f.term), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id),
q AS (SELECT item_id, x AS term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM benchmark) t GROUP BY item_id, x),
qn AS (SELECT item_id, sum(c) AS n FROM q GROUP BY item_id), qw AS (SELECT q.item_id, q.term, c / n * coalesce(idf, 1.0) AS q FROM q JOIN qn ON qn.item_id = q.item_id LEFT JOIN d ON d.term = q.term),
ql AS (SELECT item_id, sqrt(sum(q * q)) AS l FROM qw GROUP BY item_id), s AS (SELECT qw.item_id, x.doc_id, sum(w * q) AS dot FROM x JOIN qw ON qw.term = x.term GROUP BY 1, 2),
r AS (SELECT s.item_id, s.doc_id, round(dot / (norm * l), 6) AS similarity FROM s JOIN n ON n.doc_id = s.doc_id JOIN ql ON ql.item_id = s.item_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rn FROM r) SELECT item_id AS "query", doc_id, round(similarity, 4) AS similarity FROM k WHERE rn <= 3""")
def m1_similar_texts(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return m.similar_texts(table(spark, sf_dir, "documents"), asked, "doc_id", "text", 3).select("query", "doc_id", F.round("similarity", 4).alias("similarity"))


@query(""", w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS c FROM w GROUP BY 1, 2),
b AS (SELECT item_id, CAST('0x' || substr(sha256(term), i * 4 + 1, 4) AS BIGINT) % 256 AS bucket, sum(c) AS n FROM c, range(16) t(i) GROUP BY 1, 2)
SELECT item_id, CAST(bucket AS INT) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS value FROM b""")
def m2_hashed_embedding(spark, sf_dir):
    return m.hashed_embedding(table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", F.col("bucket").cast("int").alias("bucket"), F.round("value", 6).alias("value"))


@query(""", p AS (SELECT a.vec_id AS q, b.vec_id AS v, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, v) AS n FROM p) SELECT q AS "query", v AS vec_id, round(greatest(0, 1 - d / 2), 5) AS similarity FROM k WHERE n <= 3""")
def m3_nearest(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings")
    asked = corpus.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return m.nearest(corpus.withColumn("embedding", F.col("embedding").cast("array<double>")), asked, "vec_id", "embedding", 3).select("query", "vec_id", F.round("similarity", 5).alias("similarity"))


@query()
def m4_cluster(spark, sf_dir):
    return m.cluster(table(spark, sf_dir, "embeddings"), "embedding", 4).groupBy("cluster").agg(F.count("*").alias("n"))


@query(", c AS (SELECT host, severity, count(*) AS n FROM e GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, severity) AS r, sum(n) OVER (PARTITION BY host) AS al FROM c) SELECT host, CAST(al AS BIGINT) AS n, severity FROM k WHERE r = 1")
def m5_cluster_profile(spark, sf_dir):
    return m.cluster_profile(sec_events(spark, sf_dir), "host", ["severity"])


@query("SELECT id FROM e ORDER BY ts DESC, id LIMIT 500")
def m6_retention(spark, sf_dir):
    return m.retain_newest(sec_events(spark, sf_dir), "us", "id", 500).select("id")


def _distinct(pattern: str, group: int) -> str:
    return f"(SELECT source, count(DISTINCT v) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '{pattern}', {group})) AS v FROM documents) t GROUP BY source)"


@query(f""", i AS {_distinct(m.IP, 0)}, u AS {_distinct(m.USER, 1)}, p AS {_distinct(m.PROCESS, 1)},
g AS (SELECT source, bool_or(regexp_matches(text, '{m.FAILURE}')) AS failure, bool_or(regexp_matches(text, '{m.PRIVILEGE}')) AS privileged FROM documents GROUP BY source)
SELECT g.source, coalesce(i.n, 0) AS n_ips, coalesce(u.n, 0) AS n_users, coalesce(p.n, 0) AS n_processes, failure, privileged, coalesce(i.n, 0) > 5 AS multi_source,
  CASE WHEN failure OR privileged OR coalesce(i.n, 0) > 5 THEN 'high' ELSE 'low' END AS severity FROM g LEFT JOIN i ON i.source = g.source LEFT JOIN u ON u.source = g.source LEFT JOIN p ON p.source = g.source""")
def x1_batch_entities(spark, sf_dir):
    return m.batch_entities(table(spark, sf_dir, "documents"), "source", "text")


#: A text for each category, and one for none.
PHRASES = ("brute force", "sql injection", "cmd inject", "data theft", "psexec run", "setuid bit", "ransom note", "trojan found", "spear phish", "nmap sweep", "call home", "dnscat use", "webshell up", "lsass read", "crontab edit", "all is well")
TEXTS = ", y AS (SELECT *, list_extract([" + ", ".join(f"'{x}'" for x in PHRASES) + "], CAST(CAST(id AS BIGINT) % 16 AS INT) + 1) AS line FROM e), " + "k AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}', 'i') THEN {i}" for i, (p, _, _) in enumerate(m.CATEGORIES)) + " ELSE -1 END AS c FROM y), z(c, category, points) AS (VALUES (-1, 'unknown', 3), " + ", ".join(f"({i}, '{c}', {x})" for i, (_, c, x) in enumerate(m.CATEGORIES)) + ")"


def _texts(spark, sf_dir):
    return sec_events(spark, sf_dir).withColumn("line", F.get(F.array(*map(F.lit, PHRASES)), (F.col("id").cast("long") % 16).cast("int")))


@query(TEXTS + " SELECT category, points AS severity, count(*) AS n FROM k JOIN z ON z.c = k.c GROUP BY 1, 2")
def x2_classify(spark, sf_dir):
    kind = m.classify(F.col("line"))
    return _texts(spark, sf_dir).groupBy(kind["category"].alias("category"), kind["severity"].alias("severity")).agg(F.count("*").alias("n"))


NAMED = TEXTS + ", q(category, tactic, technique) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in m.CATEGORY_TECHNIQUES) + ")"


@query(NAMED + " SELECT q.category, tactic, technique, count(*) AS n FROM k JOIN z ON z.c = k.c JOIN q ON q.category = z.category GROUP BY 1, 2, 3")
def x3_category_techniques(spark, sf_dir):
    named = _texts(spark, sf_dir).select(m.classify(F.col("line"))["category"].alias("category"))
    return named.join(F.broadcast(m.category_techniques(spark)), "category").groupBy("category", "tactic", "technique").agg(F.count("*").alias("n"))


#: Times with a fraction, and every third with an offset of two hours.
@query("SELECT host, round(date_diff('microsecond', min(t), max(t)) / 3.6e9, 3) AS dwell_hours FROM (SELECT host, date_trunc('millisecond', ts) - CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS t FROM e) x GROUP BY host")
def x4_timeline_dwell(spark, sf_dir):
    offset = F.when(F.col("id").cast("long") % 3 == 0, "+0200").otherwise("Z")
    df = sec_events(spark, sf_dir).withColumn("line", F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), offset, F.lit(" "), F.col("message")))
    return m.dwell_hours(m.incident_timeline(df, "host", "line"), "host")


@query(NAMED + """, w AS (SELECT *, 'at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' user=' || user_id || ' from ' || ip_address || ' ' || line AS t FROM k),
s AS (SELECT host, max(points) AS severity, list(category ORDER BY points DESC, category)[1] AS category, avg(CASE WHEN category = 'unknown' THEN 0.0 ELSE 1.0 END) AS known FROM w JOIN z ON z.c = w.c GROUP BY host),
n AS (SELECT host, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques FROM w JOIN z ON z.c = w.c JOIN q ON q.category = z.category WHERE z.category <> 'unknown' GROUP BY host),
v AS (SELECT host, count(DISTINCT ip_address) AS n_indicators, count(DISTINCT user_id) AS users, round(date_diff('microsecond', min(date_trunc('second', ts)), max(date_trunc('second', ts))) / 3.6e9, 3) AS dwell_hours FROM w GROUP BY host),
i AS (SELECT ip_address AS x, 0.6 AS f FROM e GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT user_id, 0.55 FROM e GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT host, avg(f) AS grouped FROM (SELECT DISTINCT host, ip_address AS x FROM e UNION ALL SELECT DISTINCT host, user_id FROM e) d JOIN i ON i.x = d.x GROUP BY host)
SELECT s.host, severity, category, techniques, n_indicators, CAST(1 AS BIGINT) AS blast_hosts, users AS blast_users, users AS n_users, false AS failure, false AS privileged, dwell_hours,
  round((nullif(known, 0) + grouped) / 2, 3) AS confidence FROM s JOIN n ON n.host = s.host JOIN v ON v.host = s.host JOIN o ON o.host = s.host""")
def x5_merged_report(spark, sf_dir):
    written = F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" user="), "user_id", F.lit(" from "), "ip_address", F.lit(" "), "line")
    return m.merged_report(_texts(spark, sf_dir).withColumn("line", written), "host", "line").withColumn("techniques", F.array_join("techniques", ","))


@query("SELECT count(*) FILTER (WHERE t AND d) AS tp, count(*) FILTER (WHERE d AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT d) AS fn, round(count(*) FILTER (WHERE t AND d) / count(*) FILTER (WHERE d), 6) AS precision, round(count(*) FILTER (WHERE t AND d) / count(*) FILTER (WHERE t), 6) AS recall, round(2 * count(*) FILTER (WHERE t AND d) / (count(*) FILTER (WHERE d) + count(*) FILTER (WHERE t)), 6) AS f1 FROM (SELECT event_type = 'ssh_login_failure' AS t, host IN ('h1', 'h2', 'h3') AS d FROM e) x")
def v1_evaluation(spark, sf_dir):
    df = sec_events(spark, sf_dir)
    return m.evaluate_detection(df.filter("event_type = 'ssh_login_failure'"), df.filter("host IN ('h1', 'h2', 'h3')"))


@query(", b AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL (10 * (i + 1)) SECOND AS w, bytes FROM e, range(6) r(i) WHERE bytes IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY bytes) AS n, count(*) OVER (PARTITION BY w) AS c FROM b) SELECT w AS at, round(max(c) / 60, 6) AS per_second, round(avg(bytes), 4) AS mean, round(max(CASE WHEN n = least(floor(c * 0.95) + 1, c) THEN bytes END), 4) AS p95 FROM k GROUP BY w")
def o1_throughput(spark, sf_dir):
    df = m.throughput(sec_events(spark, sf_dir).filter("bytes IS NOT NULL"), "bytes", "60 seconds", "10 seconds")
    return df.select(F.col("at").cast("timestamp_ntz").alias("at"), F.round("per_second", 6).alias("per_second"), F.round("mean", 4).alias("mean"), F.round("p95", 4).alias("p95"))


@query("SELECT event_type AS source, count(*) FILTER (WHERE severity <> 'error') AS accepted, count(*) FILTER (WHERE severity = 'error') AS errors, round(count(*) FILTER (WHERE severity = 'error') / count(*), 6) AS error_rate, CAST(sum(CASE WHEN severity <> 'error' THEN octet_length(encode(message)) ELSE 0 END) AS BIGINT) AS bytes FROM e GROUP BY event_type")
def o2_source_health(spark, sf_dir):
    df = sec_events(spark, sf_dir).withColumn("source", F.col("event_type"))
    return m.source_health(df.filter("severity <> 'error'"), df.filter("severity = 'error'")).select("source", "accepted", "errors", "error_rate", "bytes")


@query("SELECT id, ts FROM e WHERE severity = 'warning' AND host = 'h3' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, id")
def q1_search_logs(spark, sf_dir):
    df = q.search(sec_events(spark, sf_dir), {"severity": "warning", "host": "h3"}, "2024-01-05", "2024-01-20")
    return df.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT id, (SELECT count(*) FROM e) AS total, (SELECT (count(*) + 49) // 50 FROM e) AS pages, true AS has_next, true AS has_prev FROM (SELECT id FROM e ORDER BY ts DESC, id LIMIT 50 OFFSET 100) t")
def q2_paginate(spark, sf_dir):
    return q.paginate(sec_events(spark, sf_dir).select("id", "us"), 3, 50, [F.desc("us"), F.col("id")]).drop("us")


@query(LEVELED + " SELECT id FROM v WHERE severity = 'critical' AND status = 'open' ORDER BY ts DESC, id LIMIT 100")
def q3_search_alerts(spark, sf_dir):
    return q.search(_leveled(spark, sf_dir), {"severity": "critical", "status": "open"}).limit(100).select("id")


@query("SELECT lower(severity) AS severity, count(*) AS n FROM e GROUP BY 1")
def q4_severity_distribution(spark, sf_dir):
    return q.severity_distribution(sec_events(spark, sf_dir))


@query(LEVELED + " SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) AS alerts, (SELECT count(DISTINCT host) FROM v) AS incidents FROM v")
def q5_kpis(spark, sf_dir):
    alerts = _leveled(spark, sf_dir)
    return q.kpis(alerts, r.incidents_of(alerts, "host"))


@query("SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def q6_table_counts(spark, sf_dir):
    return q.table_counts({n: table(spark, sf_dir, n) for n in ("events", "orders", "documents")})


@query(LEVELED + ", p AS (SELECT id, round(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 1 END / 4.0 * 0.8 * greatest(0.1, 1 - date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 3.6e9 / 48.0) * 100, 2) AS priority FROM v) SELECT id, priority FROM p ORDER BY priority DESC, id LIMIT 20")
def q7_top_alerts(spark, sf_dir):
    return q.top(l3_priority(spark, sf_dir), [F.desc("priority"), F.col("id")], 20)


@query(LEVELED + " SELECT host, min(ts) AS ts FROM v GROUP BY host")
def q8_list_incidents(spark, sf_dir):
    found = q.search(r.incidents_of(_leveled(spark, sf_dir), "host"), {"status": "open"}, tie="host")
    return found.select("host", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))

"""Queries over the driver's tables for streams and the isolation forest, with the SQL that checks them."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from emberlog.functions.storage import new_path, stage
from emberlog.operators import correlation, intel, isolation, response, rules, scoring
from emberlog.plans.checks_correlation import SESSIONS, SIX
from emberlog.plans.checks_detection import E_SQL, FREQUENCY, HOUR, UBA
from emberlog.plans.checks_ingest import _lines
from emberlog.plans.detection import detect_stateless, detect_threats
from emberlog.sources.events import sec_events
from emberlog.streaming import streams, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {E_SQL}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return put


def _stream(spark, sf_dir, batches: int = 1):
    """The events written once and read as a stream, in so many micro-batches."""
    df, files = sec_events(spark, sf_dir), spark.sparkContext.defaultParallelism
    written = df if batches == 1 else df.repartition(batches * files, "id")
    written.write.parquet(path := new_path(spark, "events"))
    reader = spark.readStream.schema(df.schema)
    return (reader if batches == 1 else reader.option("maxFilesPerTrigger", files)).parquet(path)


@query("SELECT count(*) AS ok, CAST(0 AS BIGINT) AS bad FROM e")
def w1_stream_ingest(spark, sf_dir):
    _lines(spark, sf_dir).select("value").write.text(path := new_path(spark, "lines"))
    logs, bad = new_path(spark, "logs"), new_path(spark, "quarantine")
    streams.ingest(spark.readStream.text(path), logs, bad, new_path(spark, "state"), year=2024).awaitTermination()
    kept = spark.read.parquet(logs).agg(F.count("*").alias("ok"))
    return kept.join(F.broadcast(spark.read.parquet(bad).agg(F.count("*").alias("bad"))), F.lit(True))


@query(r"""SELECT id, concat_ws(',', CASE WHEN regexp_matches(message, '/etc/(passwd|shadow|sudoers|crontab)', 'i') THEN 'SIG-002' END, CASE WHEN regexp_matches(message, '\.\./', 'i') THEN 'SIG-005' END) AS rules,
  CASE WHEN regexp_matches(message, '(/etc/shadow|/etc/passwd)', 'i') THEN 25.0 ELSE 0.0 END + CASE WHEN regexp_matches(message, 'sudo.?-i\b', 'i') THEN 25.0 ELSE 0.0 END AS points,
  concat_ws(',', CASE WHEN regexp_matches(message, 'union.{0,20}select', 'i') THEN 'SIG_SQLI_UNION' END, CASE WHEN regexp_matches(message, '\.\./', 'i') THEN 'SIG_PATH_TRAVERSAL' END) AS signatures,
  CASE WHEN i BETWEEN 3 AND 44 THEN 55.0 + i % 30 END AS ti_score, CASE WHEN i BETWEEN 3 AND 44 AND 55 + i % 30 >= 70 THEN 'high' ELSE severity END AS severity FROM (SELECT *, CAST(substr(user_id, 2) AS BIGINT) % 60 AS i FROM e) t""")
def w2_stream_detection(spark, sf_dir):
    """Three micro-batches; what is found is what one batch over all finds."""
    known, path = intel.builtin_indicators(spark), new_path(spark, "detected")
    streams.for_each_batch(_stream(spark, sf_dir, 3), path, new_path(spark, "state"), lambda batch: detect_stateless(batch, known)).awaitTermination()
    df = spark.read.parquet(path)
    points = F.aggregate("keywords", F.lit(0.0), lambda a, k: a + k["points"])
    return df.select("id", F.array_join("matches.rule_id", ",").alias("rules"), points.alias("points"), F.array_join("signatures.signature", ",").alias("signatures"), "ti_score", "severity")


@query("SELECT ip_address, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL (i + 1) HOUR AS w_end, count(*) AS n FROM e, range(24) r(i) GROUP BY 1, 2")
def w3_stream_window_counts(spark, sf_dir):
    """Windows of a day, one beginning each hour."""
    got = streams.run_to_table(streams.sliding_counts(_stream(spark, sf_dir), "ip_address", "24 hours", "1 hour"), "counts", "complete")
    return got.select("ip_address", F.col("w.end").cast("timestamp_ntz").alias("w_end"), "n")


@query("SELECT id, n FROM (SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, ts) + row_number() OVER (PARTITION BY user_id, ts ORDER BY id) AS n FROM e) t WHERE n >= 5")
def w3_stream_threshold(spark, sf_dir):
    """Four micro-batches out of order find what one batch finds."""
    with windows.rocksdb(spark):
        return streams.run_to_table(windows.threshold_hits(_closed(spark, sf_dir, 4), "user_id", 5, 86_400_000_000, "3 days"), "hits").select("id", "n")


def _closed(spark, sf_dir, batches: int = 1):
    """The events as a stream in so many micro-batches, up to two days out of order, and an event a year later, in a batch of its own, that closes what they leave open."""
    df = sec_events(spark, sf_dir)
    path, come = new_path(spark, "events"), F.col("us") + F.pmod(F.xxhash64("id"), F.lit(2 * 86_400_000_000))
    files = spark.sparkContext.defaultParallelism  # so many tasks write and read a batch
    low, high = df.agg(F.min(come), F.max(come)).first()
    for i in range(batches):
        df.filter(F.floor((come - low) / (high - low + 1) * batches) == i).repartition(files, "id").write.parquet(f"{path}/part={i}")
    end = df.agg((F.max("us") + F.lit(365 * 86_400_000_000)).alias("us")).select(F.lit("end").alias("id"), "us", F.timestamp_micros("us").alias("ts"), *(F.lit("end").alias(c) for c in ("host", "user_id", "source", "event_type")))
    df.limit(0).unionByName(end, allowMissingColumns=True).coalesce(1).write.parquet(f"{path}/part={batches}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part=*")


@query(""", l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id) AS nth FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, nth""")
def w4_stream_sessions(spark, sf_dir):
    """All sessions, each as the watermark passes its end."""
    got = streams.run_to_table(streams.sessions(_closed(spark, sf_dir), ["user_id"], "6 hours"), "sessions")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(SESSIONS + """ SELECT user_id, n, round(sec, 3) AS seconds, coalesce(burst, false) AS burst, priv, sec > 28800 AS long, coalesce(jump, false) AS jump,
  round(least(10.0, CASE WHEN burst THEN 2.5 ELSE 0 END + CASE WHEN priv THEN 3.0 ELSE 0 END + CASE WHEN sec > 28800 THEN 1.5 ELSE 0 END + CASE WHEN jump THEN 4.0 ELSE 0 END + least(2.0, n * 0.02)), 2) AS risk FROM z""")
def w4_stream_session_anomalies(spark, sf_dir):
    """All sessions: an event a year later closes those that the events leave open."""
    stream = _closed(spark, sf_dir)
    got = streams.run_to_table(streams.session_anomalies(stream, SIX, burst_per_minute=0.05), "session-anomalies")
    user = F.split("key", r"\|")[1].alias("user_id")
    return got.select(user, "n", F.round((F.col("end_us") - F.col("start_us")) / 1e6, 3).alias("seconds"), F.col("burst_activity").alias("burst"), F.col("privilege_escalation").alias("priv"), F.col("abnormal_duration").alias("long"), F.col("impossible_travel").alias("jump"), "risk")


@query("SELECT count(DISTINCT host || event_type) AS n FROM e")
def w5_stream_dedupe(spark, sf_dir):
    return streams.run_to_table(streams.deduplicate(_stream(spark, sf_dir), ["host", "event_type"], "60 days"), "unique").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM e GROUP BY user_id")
def w6_stream_baseline_join(spark, sf_dir):
    usual = sec_events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("usual"))
    got = streams.run_to_table(streams.with_baseline(_stream(spark, sf_dir), usual, ["user_id"]).select("user_id", "usual"), "joined")
    return got.groupBy("user_id").agg(F.max("usual").alias("n"))


@query(UBA + " SELECT id, round(deviation, 6) AS deviation FROM d")
def w6_stream_behaviour(spark, sf_dir):
    """D3 of every event, in four micro-batches out of order."""
    with windows.rocksdb(spark):
        got = streams.run_to_table(windows.user_deviation(_closed(spark, sf_dir, 4), 120 * HOUR, late="3 days"), "behaviour")
    return got.filter("id <> 'end'").select("id", F.round("deviation", 6).alias("deviation"))


@query(FREQUENCY.format(window="6 HOUR") + " SELECT id, recent, round(fs, 5) AS frequency_score FROM q")
def w6_stream_frequency(spark, sf_dir):
    """A6 of every event, in four micro-batches out of order."""
    with windows.rocksdb(spark):
        got = streams.run_to_table(windows.frequency_anomaly(_closed(spark, sf_dir, 4), 6 * HOUR, late="3 days"), "frequency")
    return got.filter("id <> 'end'").select("id", "recent", F.round("frequency_score", 5).alias("frequency_score"))


@query("SELECT time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL (10 * (i + 1)) SECOND AS w_end, round(count(*) / 60, 6) AS per_second FROM e, range(6) r(i) GROUP BY 1")
def w7_stream_metrics(spark, sf_dir):
    got = streams.run_to_table(streams.metrics(_stream(spark, sf_dir)), "metrics", "complete")
    return got.select(F.col("at").cast("timestamp_ntz").alias("w_end"), F.round("per_second", 6).alias("per_second"))


@query("SELECT count(*) AS late FROM e WHERE CAST(id AS BIGINT) % 4 = 3 AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM e WHERE CAST(id AS BIGINT) % 2 = 0) - INTERVAL 10 DAY")
def w8_late_rows(spark, sf_dir):
    """Ids come in three batches. What is more than ten days behind the first is late from the batch after the next on."""
    df = sec_events(spark, sf_dir)
    path = new_path(spark, "events")
    for i, own in enumerate(("id % 2 = 0", "id % 4 = 1", "id % 4 = 3")):
        df.filter(own).coalesce(1).write.parquet(f"{path}/part={i}")
    listener = streams.LateRows()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
        q = streams.sliding_counts(stream, "id", "1 hour", "1 hour", "10 days").writeStream.format("noop").option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = streams.late_rows(q)
        for _ in range(100):  # the listener hears of the last batch a little later
            if listener.rows.get(q.id, 0) >= rows:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    return df.limit(1).select(F.lit(listener.rows.get(q.id, 0)).cast("long").alias("late"))


@query("SELECT id, 'U-1' AS rule_id, 0.5 AS confidence FROM e WHERE length(message) > 30")
def u1_own_rule_type(spark, sf_dir):
    """A rule type that isn't built in is one function from its specification to columns."""
    longer = {"longer_than": lambda df, spec: (F.length(spec.condition["field"]) > spec.condition["n"], F.lit(0.5), F.col(spec.condition["field"]))}
    spec = rules.RuleSpec("U-1", "longer_than", "low", 10, "T0000", {"field": "message", "n": 30})
    return rules.evaluate_rules(sec_events(spark, sf_dir), [spec], longer).select("id", F.explode("matches").alias("m")).select("id", "m.rule_id", "m.confidence")


@query(", t AS (SELECT user_id, min(CASE WHEN event_type = 'file_access' THEN ts END) AS a FROM e GROUP BY user_id), k AS (SELECT e.user_id, bool_or(e.event_type = 'data_exfiltration' AND (t.a IS NULL OR e.ts > t.a)) AS b, bool_or(t.a IS NOT NULL) AS a FROM e JOIN t ON t.user_id = e.user_id GROUP BY e.user_id) SELECT user_id, CAST(a AS INT) + CAST(b AS INT) AS matched, CASE WHEN a AND b THEN 'pb-own' ELSE 'pb-malware' END AS playbook FROM k WHERE a OR b")
def u2_own_chain_and_playbook(spark, sf_dir):
    """A chain and a playbook that aren't built in are rows beside those that are."""
    own = correlation.Pattern("OWN", "high", (("read", ("file_access",), ()), ("sent", ("data_exfiltration",), ())))
    found = correlation.match_chains(sec_events(spark, sf_dir), ("user_id",), patterns=(*correlation.PATTERNS, own)).filter("pattern = 'OWN'")
    books = (*response.PLAYBOOKS, ("pb-own", 1, ("steps:2",)))
    played = response.recommend_playbook(found.withColumn("steps", F.col("matched")).select("user_id", "steps"), "user_id", books)
    return found.select("user_id", "matched").join(played, "user_id")


@query("SELECT id, CASE WHEN host = 'h7' THEN 99.0 WHEN i BETWEEN 3 AND 44 THEN 55.0 + i % 30 END AS ti_score FROM (SELECT *, CAST(substr(user_id, 2) AS BIGINT) % 60 AS i FROM e) t")
def u3_own_indicators(spark, sf_dir):
    """Own indicators take the place of built-in ones: here, all addresses of one host."""
    df = sec_events(spark, sf_dir)
    own = df.filter("host = 'h7'").select(F.col("ip_address").alias("indicator")).distinct().selectExpr("indicator", "'ip' AS indicator_type", "'own' AS category", "99D AS score", "CAST(array() AS array<string>) AS techniques", "true AS custom")
    return intel.ip_reputation(df, intel.upsert_indicators(intel.builtin_indicators(spark), own)).select("id", "ti_score")


@query("SELECT event_type, count(*) AS n FROM e GROUP BY event_type")
def u4_own_sink(spark, sf_dir):
    """A sink of a stream is a function of each micro-batch."""
    path = new_path(spark, "sink")
    counted = lambda batch: batch.groupBy("event_type").agg(F.count("*").alias("n"))
    streams.for_each_batch(_stream(spark, sf_dir, 2), path, new_path(spark, "state"), counted).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"))


@query()
def a3_a4_isolation_forest(spark, sf_dir):
    names = [f"f_{f}" for f in scoring.FEATURES]
    df = scoring.extract_features(sec_events(spark, sf_dir))
    return isolation.score_forest(df, isolation.fit_forest(df, names, key="id"), names).select("id", F.round("isolation", 6).alias("isolation"))


@query()
def a3_forest_versions(spark, sf_dir):
    """Forests fitted every 2000 events on the last 10 000, each scoring what comes next."""
    df = scoring.extract_features(sec_events(spark, sf_dir))
    got = isolation.score_versions(df, [f"f_{f}" for f in scoring.FEATURES], 2000)
    return got.select("id", "forest", F.round("isolation", 6).alias("isolation"), "outlier")


@query()
def d7_detect_threats_with_forest(spark, sf_dir):
    """The flagship, its anomaly averaged with the score of the forest of the event's time."""
    names = [f"f_{f}" for f in scoring.FEATURES]
    df = isolation.score_versions(scoring.extract_features(sec_events(spark, sf_dir)), names, 2000, contamination=None).drop(*names, "forest", "outlier")
    found = detect_threats(stage(df, "forest-scores"), intel.builtin_indicators(spark), scores=["isolation"])
    return found.select("id", F.round("anomaly", 6).alias("anomaly"), F.round("risk", 6).alias("risk"), "risk_severity")

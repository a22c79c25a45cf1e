"""Whole detection plans, composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators import intel, rules, scoring


def detect_threats(events: DataFrame, indicators: DataFrame, specs: Sequence[rules.RuleSpec] = rules.BUILTIN_RULES, uba_window_us: int = 3_600_000_000, entities: Sequence[str] = ("host", "source", "user_id"), scores: Sequence[str] = ()) -> DataFrame:
    """Suppress, evaluate rules, keywords, address reputation, behaviour and anomaly, compose the risk, gate and band.

    The anomaly score is the mean of those of the ``entities`` against their own past and of the columns of ``events``
    named in ``scores``, such as an isolation forest's. Returns the alerts: the events' columns with ``anomaly``,
    ``matches``, ``risk``, ``reasons``, ``risk_severity``, ``techniques``. Ids must be unique.
    """
    kept = events.filter(~scoring.whitelisted(events))
    # Windows run over the fields that they read; wide rows are dealt by id, once, to what the windows say of them.
    known = rules.window_columns(kept, specs)
    rare = scoring.user_deviation(kept.select("id", "us", "user_id", "event_type"), uba_window_us).select("id", "deviation")
    df = kept.join(known, "id").join(rare, "id")
    if entities:
        usual = scoring.entity_z(scoring.extract_features(kept), entities).select("id", "entity_scores")
        df = df.join(usual, "id", "left")
    else:
        df = df.withColumn("entity_scores", F.array().cast("array<double>"))
    df = rules.evaluate_rules(df, specs).drop(*(c for c in known.columns if c != "id")).withColumn("keywords", scoring.keyword_hits(F.col("message")))
    df = intel.ip_reputation(df, indicators)
    parts = F.concat(F.coalesce("entity_scores", F.array().cast("array<double>")), F.array(*map(F.col, scores)).cast("array<double>"))
    df = df.withColumn("anomaly", scoring.mean_of(parts)).drop("entity_scores")
    df = scoring.alert_gate(settled(scoring.compose_risk(df), ("matches", "keywords", "anomaly", "risk", "reasons")))
    return df.withColumn("risk_severity", scoring.severity_of_risk(F.col("risk"))).withColumn("techniques", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["technique"]))))


def settled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df``, its columns ``names`` computed once a row. A filter on a column is else moved below it and computes all that it is
    made of, such as each pattern of the rules, once for each time it is named, and the rows that stay compute it once more."""
    made = F.inline(F.array(F.struct(*names)))
    return df.select(*(f"`{c}`" for c in df.columns if c not in names), made).select(*(f"`{c}`" for c in df.columns))


def detect_stateless(events: DataFrame, indicators: DataFrame, specs: Sequence[rules.RuleSpec] = rules.BUILTIN_RULES) -> DataFrame:
    """What each event tells by itself: suppression, signature and pattern rules, keywords, attack signatures, address
    reputation and enrichment by indicators. ``events`` with ``matches``, ``keywords``, ``signatures``, ``ti_score``,
    ``ioc_count`` and the bumped ``severity``; all stay but the suppressed. A batch plan, or one for each micro-batch."""
    kept = events.filter(~scoring.whitelisted(events))
    own = [r for r in specs if r.type not in ("threshold", "statistical")]
    df = rules.evaluate_rules(kept, own).withColumn("keywords", scoring.keyword_hits(F.col("message"))).withColumn("signatures", intel.signature_hits(F.col("message")))
    return intel.enrich(df, F.concat_ws(" ", "message", "ip_address"), indicators)


def detection_rate(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """``events, alerts, rate``."""
    seen, raised = events.agg(F.count("*").alias("events")), alerts.agg(F.count("*").alias("alerts"))
    return seen.join(F.broadcast(raised), F.lit(True)).select("events", "alerts", F.round(F.col("alerts") / F.greatest("events", F.lit(1)), 6).alias("rate"))

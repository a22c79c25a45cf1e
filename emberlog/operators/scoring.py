"""Anomaly features and scores, detection risk, and the weighted threat score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.lookback import trailing_z, with_earlier_counts, with_trailing_counts, with_trailing_moments
from emberlog.operators.rules import value_of

# Codes of severities and source types as features.
SEVERITY_CODE = {"critical": 4.0, "error": 3.0, "warning": 2.0, "info": 1.0}
SOURCE_CODE = {"network": 1.0, "system": 2.0, "application": 3.0, "api": 4.0, "file": 5.0, "stream": 6.0}
FEATURES = ("message_length", "raw_length", "severity_code", "source_code", "hour", "has_ip", "has_user", "has_process", "n_parsed", "n_special", "digit_ratio", "upper_ratio", "type_bucket", "bytes", "status_class")
# Threat keywords (pattern, reason, points).
KEYWORDS = (
    (r"\b(metasploit|meterpreter|cobalt.?strike)\b", "known_exploit_tool", 30.0),
    (r"\b(mimikatz|lsass|credential.?dump)\b", "credential_dumping", 35.0),
    (r"\b(ransomware|\.locked|\.crypted|\.encrypted)\b", "ransomware_indicator", 40.0),
    (r"(\/etc\/shadow|\/etc\/passwd|sam\.hive)", "sensitive_file_access", 25.0),
    (r"(base64.*eval|eval\(base64|powershell.*-enc)", "obfuscated_execution", 28.0),
    (r"(wget|curl).*(http|https).*\|.*(bash|sh|python)", "download_execute_chain", 35.0),
    (r"\b(c2|command.?and.?control|beacon|implant)\b", "c2_communication", 30.0),
    (r"\b(sql.?injection|union.?select|or.?1.?=.?1)\b", "sql_injection", 20.0),
    (r"\b(xss|script.?injection|<script|onerror=)\b", "xss_attempt", 15.0),
    (r"\b(ldap.?injection|log4j|jndi:)\b", "critical_vulnerability", 40.0),
    (r"\b(privilege.?escalat|sudo.?-i|suid)\b", "privilege_escalation", 25.0),
    (r"\b(lateral.?movement|pass.?the.?hash|wmiexec)\b", "lateral_movement", 30.0),
)
# Suppressed sources (field, values, prefix of the event type or none).
WHITELIST = (("ip_address", ("127.0.0.1", "::1", "0.0.0.0"), None), ("user_id", ("root",), "ssh_login_success"), ("source", ("healthcheck", "monitor", "prometheus"), None))
# Points of a rule's severity in the risk, bands of the risk.
RULE_POINTS = {"critical": 35.0, "high": 25.0, "error": 20.0, "warning": 12.0, "medium": 12.0, "low": 6.0, "info": 2.0}
RISK_BANDS = ((80, "critical"), (60, "high"), (40, "medium"), (20, "low"))
# Weights of the threat score, points of a severity, bands of the score.
WEIGHTS = {"severity": 0.25, "frequency": 0.2, "historical_behavior": 0.2, "anomaly_deviation": 0.2, "threat_intel": 0.15}
SEVERITY_POINTS = {"info": 10.0, "low": 25.0, "warning": 40.0, "medium": 55.0, "high": 75.0, "critical": 95.0, "error": 70.0}
SCORE_BANDS = ((80, "Critical"), (60, "High"), (40, "Medium"))
# Points of a rule of unknown severity and the share that counts; points of how often an event came (most,
# points), and of how usual its type is for its user and host (least share, points), with too few events, and else.
RULE_OTHER, RULE_SHARE = 35.0, 0.5
FREQUENCY_BANDS, FREQUENCY_MOST = ((2, 20.0), (5, 45.0), (10, 70.0)), 90.0
HISTORY_LEAST, HISTORY_UNKNOWN, HISTORY_BANDS, HISTORY_RARE = 20, 30.0, ((0.2, 20.0), (0.05, 45.0), (0.02, 65.0)), 85.0


def mapped(value: Column, table: Mapping[str, object], default) -> Column:
    """Look up a string in a small fixed table."""
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def banded(value: Column, bands: Sequence[tuple], lowest: str) -> Column:
    out = F.when(F.lit(False), F.lit(lowest))
    for limit, name in bands:
        out = out.when(value >= limit, F.lit(name))
    return out.otherwise(F.lit(lowest))


def extract_features(df: DataFrame) -> DataFrame:
    """``df`` with the 15 FEATURES as columns; what isn't there counts as empty or 0. Hour is null without a time."""
    text = lambda n: F.coalesce(value_of(df, n).cast("string"), F.lit(""))
    number = lambda n: F.coalesce(value_of(df, n).try_cast("double"), F.lit(0.0))
    message = text("message")
    flag = lambda c: F.when(c != "", 1.0).otherwise(0.0)
    share = lambda p: F.regexp_count(message, F.lit(p)) / F.greatest(F.length(message), F.lit(1))
    parsed = F.size("parsed_fields") if "parsed_fields" in df.columns else F.lit(0)
    columns = [
        F.length(message), F.length(text("raw_log")), mapped(F.lower(text("severity")), SEVERITY_CODE, 1.0), mapped(F.lower(text("source_type")), SOURCE_CODE, 2.0), F.hour("ts"), flag(text("ip_address")), flag(text("user_id")), flag(text("process_name")),
        F.greatest(parsed, F.lit(0)), F.regexp_count(message, F.lit(r"[!@#$%^&*()\[\]{}|;:<>?]")), share(r"\p{Nd}"), share(r"\p{Lu}"), F.conv(F.substring(F.md5(text("event_type")), 1, 8), 16, 10).cast("long") % 10, number("bytes" if "bytes" in df.columns else "parsed_fields.bytes"), F.floor(number("parsed_fields.status_code") / 100),
    ]
    return df.select("*", *(c.cast("double").alias(f"f_{n}") for c, n in zip(columns, FEATURES)))


def entity_z(df: DataFrame, keys: Sequence[str] = ("host", "source", "user_id"), features: Sequence[str] = FEATURES, last: int = 500, least: int = 10) -> DataFrame:
    """``id, z``: the mean |z| of an event's features against the ``last`` events before it of each of its entities,
    averaged over the entities with ``least`` such events; null without one. Features whose frame holds an infinity or
    NaN are left out. ``entity_scores`` has a fifth of each
    entity's, at most 1."""
    columns = [f"f_{f}" for f in features]
    values = [F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c) for c in columns]
    # An event's features are computed once and come out with each of its entities.
    entities = F.filter(F.array(*(F.when(F.coalesce(F.col(k), F.lit("")) != "", F.concat(F.lit(f"{k}:"), k)) for k in keys)), lambda e: e.isNotNull())
    before = trailing_z(df.select("id", "us", *values, F.explode(entities).alias("entity")), columns, last, ["entity"], include_self=False)
    scored = before.select("id", F.when(F.col("n") >= least, F.col("z")).alias("z"))
    return scored.groupBy("id").agg(F.round(F.avg("z"), 6).alias("z"), F.collect_list(F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), F.col("z") / 5))).alias("entity_scores"))


def mean_of(scores: Column) -> Column:
    """Mean of an array's numbers that aren't null; null without any. In sorted order, so that it is the same each time."""
    there = F.array_sort(F.filter(scores, lambda s: s.isNotNull()))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def combined_anomaly(*scores: Column) -> Column:
    """Mean of the scores that are there."""
    return mean_of(F.array(*scores))


def frequency_anomaly(df: DataFrame, window_us: int = 60_000_000, history: int = 100, least: int = 20) -> DataFrame:
    """``df`` with ``recent``, events of the pair (source, event_type) in the trailing window, and ``frequency_score``:
    its |z| against the last ``history`` such counts, as a fifth, at most 1; 0 before ``least`` counts."""
    pair = ["source", "event_type"]
    counted = with_trailing_counts(df, {"recent": pair}, window_us)
    seen = with_trailing_moments(counted.withColumn("__recent", F.col("recent").cast("double")), ["__recent"], history, pair)
    z = F.abs(F.col("__recent") - F.col("__recent_mean")) / (F.col("__recent_dev") + 1e-6)
    return seen.select(*(f"`{c}`" for c in counted.columns), F.when(F.col("n") >= least, F.least(F.lit(1.0), z / 5)).otherwise(0.0).alias("frequency_score"))


def whitelisted(df: DataFrame, entries: Sequence[tuple] = WHITELIST) -> Column:
    """Whether an event is suppressed: its field has a listed value and, where the entry says so, its type the prefix."""
    out = F.lit(False)
    for name, values, prefix in entries:
        if name in df.columns:
            fits = F.coalesce(F.col(name).isin(*values), F.lit(False))
            out = out | (fits & F.coalesce(F.col("event_type"), F.lit("")).startswith(prefix) if prefix else fits)
    return out


def keyword_hits(text: Column, keywords: Sequence[tuple] = KEYWORDS) -> Column:
    """Array of (reason, points) of the keywords found, in their order."""
    return F.filter(F.array(*(F.when(text.rlike("(?iu)" + p), F.struct(F.lit(r).alias("reason"), F.lit(x).alias("points"))) for p, r, x in keywords)), lambda h: h.isNotNull())


def user_deviation(df: DataFrame, window_us: int = 3_600_000_000, least: int = 10) -> DataFrame:
    """``df`` with ``deviation``: how rare this event type was among the user's events in the window before it.

    ``max(0, 1 - 5 * share)``; 0 with fewer than ``least`` events, and for no user.
    """
    known = F.coalesce(F.col("user_id"), F.lit("")) != ""
    # Events of no user get keys of their own, so that no task gathers them.
    keyed = df.withColumn("__user", F.when(known, F.col("user_id")).otherwise(F.concat(F.lit("\0"), F.col("id").cast("string"))))
    counted = with_trailing_counts(keyed, {"__all": ["__user"], "__own": ["__user", "event_type"]}, window_us, include_self=False)
    rare = F.greatest(F.lit(0.0), 1 - 5 * F.col("__own") / F.greatest(F.col("__all"), F.lit(1)))
    return counted.withColumn("deviation", F.when(known & (F.col("__all") >= least), rare).otherwise(0.0)).drop("__user", "__all", "__own")


def severity_of_risk(risk: Column) -> Column:
    return banded(risk, RISK_BANDS, "info")


def rule_points(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0.0), lambda a, m: a + mapped(F.lower(m["severity"]), RULE_POINTS, 5.0) * m["confidence"])


def compose_risk(df: DataFrame) -> DataFrame:
    """``df`` with ``risk`` and ``reasons`` from ``matches``, ``keywords``, ``ti_score``, ``deviation`` and ``anomaly``."""
    points = F.aggregate("keywords", F.lit(0.0), lambda a, k: a + k["points"])
    bad_ip, odd, strange = F.col("ti_score").isNotNull(), F.col("deviation") > 0.5, F.coalesce(F.col("anomaly") > 0.6, F.lit(False))
    risk = rule_points(F.col("matches")) + points + F.when(bad_ip, 30.0).otherwise(0.0) + F.when(odd, 20 * F.col("deviation")).otherwise(0.0) + F.when(strange, 25 * F.col("anomaly")).otherwise(0.0)
    reasons = F.concat(F.transform("matches", lambda m: F.concat(F.lit("rule:"), m["rule_id"])), F.transform("keywords", lambda k: F.concat(F.lit("keyword:"), k["reason"])), F.filter(F.array(F.when(bad_ip, F.lit("malicious_ip")), F.when(odd, F.lit("user_behaviour")), F.when(strange, F.lit("anomaly"))), lambda r: r.isNotNull()))
    return df.withColumn("risk", F.least(F.lit(100.0), risk)).withColumn("reasons", reasons)


def alert_gate(df: DataFrame) -> DataFrame:
    """Rows worth an alert: risk of 10 or more with a reason, and a rule's match or a risk of 30 or more."""
    return df.filter((F.col("risk") >= 10) & (F.size("reasons") > 0) & ((F.size("matches") > 0) | (F.col("risk") / 100 >= 0.3)))


def severity_factor(severity: Column, matches: Column) -> Column:
    """Points of a severity, raised by a share of the mean of its rules' points and confidence, 100 at most."""
    base = mapped(F.lower(F.coalesce(severity, F.lit("info"))), SEVERITY_POINTS, 20.0)
    total = F.aggregate(matches, F.lit(0.0), lambda a, m: a + mapped(F.lower(m["severity"]), SEVERITY_POINTS, RULE_OTHER) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), m["confidence"])))
    return F.round(F.when(F.size(matches) > 0, F.least(F.lit(100.0), base + total / F.size(matches) * RULE_SHARE)).otherwise(base), 2)


def frequency_factor(count: Column) -> Column:
    """Points of how many such events came lately, by bands."""
    out = F.when(F.lit(False), 0.0)
    for most, points in FREQUENCY_BANDS:
        out = out.when(count <= most, points)
    return out.otherwise(FREQUENCY_MOST)


def history_factor(total: Column, own: Column) -> Column:
    """Points of the share that ``own`` has of ``total`` earlier events, by bands; one figure where too few have come."""
    share, out = own / F.greatest(total, F.lit(1)), F.when(total < HISTORY_LEAST, HISTORY_UNKNOWN)
    for least, points in HISTORY_BANDS:
        out = out.when(share >= least, points)
    return out.otherwise(HISTORY_RARE)


def anomaly_factor(score: Column) -> Column:
    """Points of an anomaly given as a share or as points, 100 at most; 25 without one."""
    x = F.greatest(F.lit(0.0), score)
    return F.when(score.isNull(), 25.0).when(x <= 1, F.round(x * 100, 2)).otherwise(F.round(F.least(F.lit(100.0), x), 2))


def intel_factor(score: Column) -> Column:
    """Points of an indicator's score given as a share or as points, within 0 and 100; 10 without one."""
    x = F.when(score <= 1, score * 100).otherwise(score)
    return F.when(score.isNull(), 10.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 2))


def threat_score(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, window_us: int = 300_000_000) -> DataFrame:
    """``df`` with the five factors ``p_*``, ``score``, ``level`` and ``dominant``, from ``matches``, ``anomaly`` and ``ti_score``.

    Frequency counts the pair (source, event_type) in the trailing window; history is all earlier events of user and
    host. Weights are made to add up to 1; of equal factors the first in their order dominates.
    """
    entity = [F.coalesce(F.nullif("user_id", F.lit("")), F.lit("unknown")).alias("__u"), F.coalesce("host", F.lit("unknown")).alias("__h")]
    counted = with_trailing_counts(df.select("*", *entity), {"__n": ["source", "event_type"]}, window_us)
    rows = with_earlier_counts(counted, {"__all": ["__u", "__h"], "__own": ["__u", "__h", "event_type"]})
    factors = {"severity": severity_factor(F.col("severity"), F.col("matches")), "frequency": frequency_factor(F.col("__n")), "historical_behavior": history_factor(F.col("__all"), F.col("__own")), "anomaly_deviation": anomaly_factor(F.col("anomaly")), "threat_intel": intel_factor(F.col("ti_score"))}
    rows = rows.select(*(c for c in df.columns), *(v.alias(f"p_{k}") for k, v in factors.items()))
    total = sum(weights.values()) or 1.0
    score = sum((F.col(f"p_{k}") * (weights.get(k, 0.0) / total) for k in factors), F.lit(0.0))
    best = F.greatest(*(F.col(f"p_{k}") for k in factors))
    dominant = F.coalesce(*(F.when(F.col(f"p_{k}") == best, F.lit(k)) for k in factors))
    rows = rows.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2))
    return rows.withColumn("level", banded(F.col("score"), SCORE_BANDS, "Low")).withColumn("dominant", dominant).withColumn("explanation", F.format_string("%s threat (%.2f/100); main factor: %s", "level", "score", "dominant"))


def simple_risk(severity_weight: Column, confidence: Column, criticality: Column) -> Column:
    """The product of weight, confidence and criticality in points, within 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), severity_weight * confidence * criticality * 100))

"""Alerts and incidents: building, de-duplication, priority, grouping, deadlines and life-cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.folds import group_starts
from emberlog.functions.lookback import in_ranges, joined, with_earlier_counts, with_previous
from emberlog.operators.scoring import mapped

# Hours to answer by severity, weights and ranks of severities.
ALERT_HOURS = {"low": 24.0, "medium": 8.0, "high": 2.0, "critical": 0.25}
INCIDENT_HOURS = {"low": 72.0, "medium": 24.0, "high": 4.0, "critical": 1.0}
RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
NAMES = ("low", "medium", "high", "critical")
# Playbooks (id, priority, triggers), and the one for all other incidents.
PLAYBOOKS = (
    ("pb-brute-force", 2, ("attack_vector:brute_force", "failed_auth_count>10")),
    ("pb-malware", 1, ("event_type:malware_detection",)),
    ("pb-data-breach", 1, ("attack_vector:data_exfiltration", "bytes_sent>10485760")),
    ("pb-phishing", 3, ("event_type:phishing",)),
    ("pb-insider-threat", 2, ("user_risk_score>80", "anomalous_access:true")),
    ("pb-ransomware", 1, ("event_type:ransomware", "file_encryption_detected:true")),
    ("pb-lateral-movement", 1, ("attack_vector:lateral_movement",)),
    ("pb-ddos", 2, ("event_type:ddos", "connection_rate>10000")),
    ("pb-sql-injection", 2, ("attack_vector:sql_injection",)),
    ("pb-privilege-escalation", 1, ("event_type:privilege_escalation",)),
)
DEFAULT_PLAYBOOK = "pb-malware"


# Texts of alerts.
ALERT_TITLE, ALERT_UNKNOWN, ALERT_DESCRIPTION, ALERT_CHARS, ALERT_TAGS = "Threat detected: ", "unknown_event", "Rule-based threat detection triggered.", 2000, ("auto_generated", "rule_based_detection")


def build_alerts(detections: DataFrame) -> DataFrame:
    """Alert rows of detections with ``risk``, ``risk_severity``, ``reasons``, ``techniques``, ``matches``.

    The title names the event's type or else its source; the description is the reasons, cut at ALERT_CHARS, or a fixed
    text; rule and technique are the first, null without one.
    """
    named = F.coalesce(F.nullif("event_type", F.lit("")), F.nullif("source", F.lit("")), F.lit(ALERT_UNKNOWN))
    text = F.coalesce(F.nullif(F.substring(F.array_join("reasons", "; "), 1, ALERT_CHARS), F.lit("")), F.lit(ALERT_DESCRIPTION))
    return detections.select(
        F.sha2(F.concat_ws(":", F.lit("alert"), "id"), 256).alias("alert_id"), F.concat(F.lit(ALERT_TITLE), named).alias("title"), text.alias("description"), F.get("matches", 0)["rule_id"].alias("rule_id"),
        F.get("techniques", 0).alias("technique"), F.array_compact(F.array(F.nullif("id", F.lit("")))).alias("log_ids"), "risk", F.least(F.lit(1.0), F.col("risk") / 100).alias("confidence"), F.col("risk_severity").alias("severity"),
        F.array(*map(F.lit, ALERT_TAGS)).alias("tags"), "ts", "us", "host", "ip_address", "user_id", F.col("event_type").alias("attack_vector"), F.lit("open").alias("status"),
    )


def dedupe_hash(source: Column, target: Column, host: Column, vector: Column, severity: Column) -> Column:
    """SHA-256 of what makes two alerts the same; a missing part is an empty one."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(c, F.lit("")) for c in (source, target, host, vector, severity))), 256)


def first_of_hash(alerts: DataFrame, hashed: Column, order: Sequence[str] = ("us", "id")) -> DataFrame:
    """The first alert of each hash."""
    return alerts.withColumn("dedupe_hash", hashed).withColumn("__nth", F.row_number().over(Window.partitionBy("dedupe_hash").orderBy(*order))).filter("__nth = 1").drop("__nth")


def priority(severity: Column, confidence: Column, age_hours: Column) -> Column:
    """Rank of the severity times confidence, falling with age to a tenth at 43 hours; 0 to 100."""
    return F.round(mapped(severity, RANK, 2) / 4.0 * confidence * F.greatest(F.lit(0.1), 1 - age_hours / 48.0) * 100, 2)


def age_hours(us: Column, as_of_us: int) -> Column:
    """Hours from ``us`` to ``as_of_us``, both in microseconds."""
    return (F.lit(as_of_us) - us) / 3.6e9


def group_alerts(alerts: DataFrame, gap_us: int = 1_800_000_000) -> DataFrame:
    """``alerts`` with ``grp``: in time order, an alert joins the one before it if it is near in time or on the same host.

    The order is global, the work is not: each row's boundary needs its neighbour only, and a group's number is how many
    boundaries come before in its range and in the ranges before, of which there is one row per range.
    """
    near = (F.col("us") - F.col("__prev_us") <= gap_us) | ((F.coalesce("host", F.lit("")) != "") & (F.col("host") == F.col("__prev_host")))
    marked = with_previous(alerts, {"__prev_us": "us", "__prev_host": "host"}, []).withColumn("__new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).drop("__prev_us", "__prev_host")
    rows = in_ranges(marked, ["us", "id"])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(F.col("__part").alias("__p")).agg(F.sum("__new").alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = F.sum("__new").over(Window.partitionBy("__part").orderBy("__at"))
    return rows.withColumn("__in", within).join(bases, F.col("__part") == F.col("__p")).withColumn("grp", F.col("__base") + F.col("__in")).drop("__part", "__at", "__p", "__base", "__in", "__new")


def deadlines(rows: DataFrame, hours: dict[str, float] = ALERT_HOURS) -> DataFrame:
    """``rows`` with ``deadline_us`` by severity; unknown severities have a medium one's."""
    return rows.withColumn("deadline_us", F.col("us") + (mapped(F.col("severity"), hours, hours["medium"]) * 3_600_000_000).cast("long"))


def breaches(rows: DataFrame, as_of_us: int) -> DataFrame:
    """Open rows past their deadline, with ``minutes_overdue``."""
    return rows.filter((F.col("deadline_us") < as_of_us) & ~F.col("status").isin("resolved", "closed")).withColumn("minutes_overdue", F.round((as_of_us - F.col("deadline_us")) / 6e7, 1))


def lifecycle(changes: DataFrame) -> DataFrame:
    """State of each ``id`` from appended ``changes(id, us, seq, status, assignee)``: last status and assignee, when first resolved."""
    at = F.struct("us", "seq")
    return changes.groupBy("id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"), F.max_by("assignee", F.when(F.col("assignee").isNotNull(), at)).alias("assignee"), F.min(F.when(F.col("status") == "resolved", F.col("us"))).alias("resolved_us"))


def escalate(alerts: DataFrame) -> DataFrame:
    """New incidents of high and critical alerts."""
    return alerts.filter(F.col("severity").isin("high", "critical")).select(F.sha2(F.concat(F.lit("incident:"), "alert_id"), 256).alias("incident_id"), F.concat(F.lit("Incident: "), "title").alias("title"), "severity", F.array("alert_id").alias("alert_ids"), "us", F.lit("open").alias("status"))


def incident_values(alerts: DataFrame, group: str = "grp") -> DataFrame:
    """``group, kind, value``: the distinct ``host``s and ``vector``s of each group, a row each, however many there are."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("host", "host"), ("vector", "attack_vector"))))
    return alerts.select(group, F.inline(kinds)).filter("value IS NOT NULL").distinct()


def incidents_of(alerts: DataFrame, group: str = "grp") -> DataFrame:
    """One incident per group: size, highest severity, numbers of distinct hosts and vectors, deadline, title; the hosts and
    vectors themselves are rows of :func:`incident_values`. The title names the first vector."""
    rank = F.max(mapped(F.col("severity"), RANK, 2))
    out = alerts.groupBy(group).agg(F.count("*").alias("n"), F.element_at(F.array(*map(F.lit, NAMES)), rank).alias("severity"), F.min("us").alias("us"))
    values = incident_values(alerts, group).groupBy(group).agg(*(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("host", "vector")), F.min(F.when(F.col("kind") == "vector", F.col("value"))).alias("first_vector"))
    out = deadlines(joined(out, values, [group], "left").withColumns({f"{k}s": F.coalesce(f"{k}s", F.lit(0)) for k in ("host", "vector")}), INCIDENT_HOURS)
    title = F.concat_ws(" ", F.upper("severity"), F.lit("incident:"), F.coalesce("first_vector", F.lit("unknown")), F.lit("on"), F.col("hosts").cast("string"), F.lit("host(s)"))
    return out.withColumn("title", title).withColumn("status", F.lit("open")).drop("first_vector")


def auto_group(alerts: DataFrame, gap_us: int = 1_800_000_000) -> DataFrame:
    """``block, grp``: groups in which an alert joins if it is near the last one, or its host is in the current group.

    Blocks of alerts with no larger gap come first, in parallel. A block is bridged to the group before it iff its first
    alert's host is in that group; the second fold runs over blocks, of which there are far fewer, with the last block
    of each host, as a parallel prefix (:func:`emberlog.functions.folds.group_starts`). Missing hosts equal each other.
    """
    blocks = group_alerts(alerts.withColumn("__host", F.col("host")).withColumn("host", F.lit(None).cast("string")), gap_us).withColumnRenamed("grp", "block")
    named = blocks.select("block", "us", "id", F.coalesce("__host", F.lit("\0")).alias("h"))
    firsts = named.groupBy("block").agg(F.min_by("h", F.struct("us", "id")).alias("h"))
    # The last earlier block with the host that a block begins with: a join of block numbers, by host.
    seen = named.select("h", F.col("block").alias("at")).distinct()
    order = Window.partitionBy("h").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, -1)
    asked = seen.withColumn("asks", F.lit(1)).unionByName(firsts.select("h", F.col("block").alias("at"), F.lit(0).alias("asks")))
    last = asked.withColumn("last", F.max(F.when(F.col("asks") == 1, F.col("at"))).over(order)).filter("asks = 0").select(F.col("at").alias("block"), F.coalesce("last", F.lit(-1)).alias("last"))

    starts = group_starts(last, "block", "last")
    # Groups are numbered in order: a block's is the number of those that began up to it.
    begun = with_earlier_counts(starts, {"before": []}, ["number"], {"before": "new"})
    return begun.select(F.col("number").alias("block"), (F.col("before") + F.col("new")).cast("long").alias("grp"))


def timeline(events: DataFrame) -> DataFrame:
    """``events(id, us, seq, action, actor)`` with ``nth``, the entry's place in its incident's timeline from 1, and
    ``steps``, severity steps up to then, at most 3. Rows are dealt by ranges of time: no incident is one task's."""
    raised = events.withColumn("__up", F.when(F.col("action") == "escalate", 1).otherwise(0))
    counted = with_earlier_counts(raised, {"__before": ["id"], "__ups": ["id"]}, ["us", "seq"], {"__ups": "__up"})
    return counted.select(*(f"`{c}`" for c in events.columns), (F.col("__before") + 1).alias("nth"), F.least(F.lit(3), F.col("__ups") + F.col("__up")).alias("steps"))


def containment(members: DataFrame, group: str) -> DataFrame:
    """``group, kind, value``: each address (``ip``), ``host`` and ``user`` seen in each group, once.

    One row each, however many a group has; empty and null ones aren't targets.
    """
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("ip", "ip_address"), ("host", "host"), ("user", "user_id"))))
    return members.select(group, F.inline(kinds)).filter("value <> ''").distinct()


def recommend_playbook(incidents: DataFrame, key: str, playbooks: Sequence[tuple] = PLAYBOOKS) -> DataFrame:
    """``key, playbook``: the most urgent playbook with a trigger that holds; DEFAULT_PLAYBOOK where none does.

    ``field:value`` is equality as text, ``field>number`` a comparison; fields that aren't there hold nothing.
    """
    made = []
    for order, (name, urgency, triggers) in enumerate(playbooks):
        for t in triggers:
            field, sign, value = t.partition(">") if ">" in t else t.partition(":")
            if field in incidents.columns:
                holds = F.col(field).try_cast("double") > float(value) if sign == ">" else F.lower(F.col(field).cast("string")) == value
                made.append(F.when(holds, F.struct(F.lit(urgency).alias("urgency"), F.lit(order).alias("nth"), F.lit(name).alias("playbook"))))
    best = F.array_min(F.array_compact(F.array(*made)))["playbook"] if made else F.lit(None)
    return incidents.select(key, F.coalesce(best, F.lit(DEFAULT_PLAYBOOK)).alias("playbook"))

"""Detection rules: specifications compiled to columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.lookback import with_trailing_counts, with_trailing_moments

MATCH = "struct<rule_id:string,rule_type:string,severity:string,technique:string,priority:int,confidence:double,matched:string>"
#: Rules of one array expression, so that its generated code stays below the method limit.
CHUNK = 50
# What a statistical rule takes where it says nothing else.
Z_THRESHOLD, MIN_SAMPLES = 3.0, 30


@dataclass(frozen=True)
class RuleSpec:
    """One rule. ``condition`` holds what its type asks for; ``enabled`` is honoured."""

    id: str
    type: str
    severity: str
    priority: int
    technique: str
    condition: dict = field(default_factory=dict)
    enabled: bool = True


# The built-in rules, in their order.
BUILTIN_RULES = (
    RuleSpec("SIG-001", "threshold", "high", 90, "T1110", {"field": "ip_address", "threshold": 5, "window_seconds": 60, "filter": {"event_type": "ssh_login_failure"}}),
    RuleSpec("SIG-002", "pattern", "high", 85, "T1083", {"pattern": r"/etc/(passwd|shadow|sudoers|crontab)", "field": "message"}),
    RuleSpec("SIG-003", "pattern", "critical", 95, "T1059", {"pattern": r"(bash\s+-i|/dev/tcp/|nc\s+-e|ncat\s+.*-e|python.*socket.*connect)", "field": "message"}),
    RuleSpec("SIG-004", "signature", "high", 88, "T1078", {"field": "event_type", "value": "windows_event_4672"}),
    RuleSpec("SIG-005", "pattern", "high", 80, "T1190", {"pattern": r"(\.\./|\.\.\\|%2e%2e%2f|%252e%252e)", "field": "message"}),
    RuleSpec("SIG-006", "statistical", "medium", 60, "T1048", {"field": "parsed_fields.bytes", "z_threshold": 4.0, "min_samples": 50}),
    RuleSpec("SIG-007", "signature", "medium", 70, "T1136", {"field": "event_type", "value": "windows_event_4720"}),
    RuleSpec("SIG-008", "pattern", "high", 82, "T1071.004", {"pattern": r"(evil|malware|c2|exfil|rat\.|botnet)", "field": "message"}),
    RuleSpec("SIG-009", "signature", "warning", 50, "T1562.004", {"field": "event_type", "value": "firewall_event", "fields": {"severity": "warning"}}),
    RuleSpec("SIG-010", "threshold", "medium", 65, "T1595", {"field": "ip_address", "threshold": 20, "window_seconds": 30}),
)


def value_of(df: DataFrame, name: str) -> Column:
    """A field by name; ``map.key`` reads a map column; a field that isn't there is null."""
    if name in df.columns:
        return F.col(f"`{name}`")
    head, _, key = name.partition(".")
    if key and head in df.columns:
        return F.try_element_at(F.col(head), F.lit(key)) if dict(df.dtypes)[head].startswith("map") else F.col(name)
    return F.lit(None).cast("string")


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(value_of(df, name).cast("string"), F.lit(""))


def _equal(df: DataFrame, name: str, value) -> Column:
    return F.lower(_text(df, name)) == str(value).lower()


def helper(spec: RuleSpec) -> str:
    """The column that holds what a rule's window gives. Ids may hold anything, so that it is named by a digest."""
    return "__" + hashlib.md5(repr((spec.id, spec.type, sorted(spec.condition.items(), key=repr))).encode()).hexdigest()[:16]


def signature(df: DataFrame, spec: RuleSpec) -> tuple[Column, Column, Column]:
    """Equality of a field, and of further ones, without regard to case; null counts as the empty string."""
    c = spec.condition
    fits = _equal(df, c["field"], c.get("value", ""))
    for name, value in c.get("fields", {}).items():
        fits = fits & _equal(df, name, value)
    return fits, F.lit(0.9), _text(df, c["field"])


def pattern(df: DataFrame, spec: RuleSpec) -> tuple[Column, Column, Column]:
    """A regular expression found in a field, or in any string field; the match is cut to 200 characters."""
    c = spec.condition
    regex = ("" if c.get("flags", 2) == 0 else "(?iu)") + c["pattern"]
    names = [c["field"]] if c.get("field") else [n for n, t in df.dtypes if t == "string"]
    found = [F.when(_text(df, n).rlike(regex), F.substring(F.regexp_extract(_text(df, n), regex, 0), 1, 200)) for n in names]
    hit = F.coalesce(*found)
    return hit.isNotNull(), F.lit(0.85), hit


def threshold(df: DataFrame, spec: RuleSpec) -> tuple[Column, Column, Column]:
    """Events of one key, after the filter, in the trailing window: from the N-th on, each fires."""
    c = spec.condition
    counted = _text(df, c["field"]) != ""
    for name, value in c.get("filter", {}).items():
        counted = counted & _equal(df, name, value)
    n = F.col(helper(spec))
    return counted & (n >= c["threshold"]), F.least(F.lit(1.0), n / (2.0 * c["threshold"])), _text(df, c["field"])


def statistical(df: DataFrame, spec: RuleSpec) -> tuple[Column, Column, Column]:
    """The z-score of a number against the last 1000 values, its own included; a limit of 3 where none is given."""
    limit, z = float(spec.condition.get("z_threshold", Z_THRESHOLD)), F.col(helper(spec))
    return z >= limit, F.least(F.lit(1.0), (z - limit) / limit + 0.6), _text(df, spec.condition["field"])


#: Rule type -> compiler. A new type is one more function.
COMPILERS: dict[str, Callable] = {"signature": signature, "pattern": pattern, "regex": pattern, "threshold": threshold, "statistical": statistical}


def with_threshold_count(df: DataFrame, spec: RuleSpec) -> DataFrame:
    """``df`` with the trailing count that a threshold rule needs."""
    c = spec.condition
    counted = _text(df, c["field"]) != ""
    for name, value in c.get("filter", {}).items():
        counted = counted & _equal(df, name, value)
    key = helper(spec)
    # Rows that don't count get keys of their own, so that no partition gathers them.
    keyed = df.withColumn(f"{key}_k", F.when(counted, _text(df, c["field"])).otherwise(F.concat(F.lit("\0"), F.col("id").cast("string"))))
    return with_trailing_counts(keyed, {key: [f"{key}_k"]}, int(c["window_seconds"] * 1_000_000)).drop(f"{key}_k")


def with_rolling_z(df: DataFrame, field_name: str, out: str, min_samples: int = MIN_SAMPLES, last: int = 1000, keys: Sequence[str] = (), order: Sequence[str] = ("us", "id")) -> DataFrame:
    """``out``: |x - mean| / population deviation against the last ``last`` rows with a number, per ``keys`` or over all.

    Null below ``min_samples``, where nothing varies, where the frame holds an infinity or NaN, and in rows without a number. Rows go by pieces of the order, each
    with the ``last`` rows before it, so that neither the whole nor a key is one task's.
    """
    numbers = df.withColumn(out, value_of(df, field_name).try_cast("double"))
    known = with_trailing_moments(numbers.filter(F.col(out).isNotNull()), [out], last, keys, order)
    deviation = F.col(f"{out}_dev")
    z = F.when((F.col("n") >= min_samples) & (deviation > 0) & ~F.isnan(deviation), F.abs(F.col(out) - F.col(f"{out}_mean")) / F.nullif(deviation, F.lit(0.0)))
    scored = known.select(*(f"`{c}`" for c in df.columns), z.alias(out))
    return scored.unionByName(numbers.filter(F.col(out).isNull()))


def window_columns(df: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """``id`` and the :func:`helper` columns of threshold and statistical rules, from rows of the fields that they read.

    Ids must be unique. Joined to wide rows by ``id``, they spare those a shuffle for each rule; :func:`evaluate_rules` takes
    what it finds.
    """
    own = list({helper(r): r for r in rules if r.enabled and r.type in ("threshold", "statistical")}.values())
    names = dict.fromkeys(n for r in own for n in (r.condition["field"], *r.condition.get("filter", {}), *r.condition.get("keys", ())) if n not in ("id", "us"))
    narrow = df.select("id", "us", *(value_of(df, n).alias(n) for n in names))
    # A statistical rule reads its rows three times (their ranges, their places and those without a number), so it comes before
    # the counts, whose windows would be gone through as often.
    for r in sorted(own, key=lambda r: r.type == "threshold"):
        narrow = _with_window(narrow, r)
    return narrow.select("id", *map(helper, own))


def _with_window(df: DataFrame, spec: RuleSpec) -> DataFrame:
    if spec.type == "threshold":
        return with_threshold_count(df, spec)
    c = spec.condition
    return with_rolling_z(df, c["field"], helper(spec), c.get("min_samples", MIN_SAMPLES), 1000, c.get("keys", ()))


def evaluate_rules(df: DataFrame, rules: Sequence[RuleSpec] = BUILTIN_RULES, compilers: Mapping[str, Callable] | None = None) -> DataFrame:
    """``df`` with ``matches``, an array of MATCH, by priority from high to low, equal ones in the rules' order.

    Needs ``id`` and ``us`` where threshold or statistical rules are among them. Signature and pattern rules are one
    projection; the others add a window each. Order is settled when compiling, not per row. ``compilers`` adds rule
    types, or takes the place of built-in ones.
    """
    compilers = COMPILERS | dict(compilers or {})
    active = sorted((r for r in rules if r.enabled), key=lambda r: -r.priority)
    columns = df.columns
    for r in active:
        if r.type in ("threshold", "statistical") and helper(r) not in df.columns:  # the same rule may come twice
            df = _with_window(df, r)
    found = []
    for r in active:
        fits, confidence, matched = compilers[r.type](df, r)
        made = F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.type).alias("rule_type"), F.lit(r.severity).alias("severity"), F.lit(r.technique).alias("technique"), F.lit(r.priority).alias("priority"), confidence.cast("double").alias("confidence"), matched.cast("string").alias("matched"))
        found.append(F.when(fits, made))
    parts = [F.filter(F.array(*found[i : i + CHUNK]), lambda m: m.isNotNull()) for i in range(0, len(found), CHUNK)]
    matches = F.concat(*parts) if parts else F.array().cast(f"array<{MATCH}>")
    return df.select(*(f"`{c}`" for c in columns), matches.alias("matches"))


def rule_statistics(evaluated: DataFrame, rules: Sequence[RuleSpec] = BUILTIN_RULES) -> DataFrame:
    """Every rule with its hits, its last hit and its hits per event, by priority."""
    spark = evaluated.sparkSession
    table = spark.createDataFrame([(r.id, r.type, r.severity, r.priority) for r in rules], "rule_id string, rule_type string, severity string, priority int")
    total = evaluated.agg(F.count("*").alias("events"))
    hits = evaluated.select(F.explode("matches.rule_id").alias("rule_id"), "ts").groupBy("rule_id").agg(F.count("*").alias("hits"), F.max("ts").alias("last_triggered"))
    rate = F.round(F.coalesce("hits", F.lit(0)) / F.greatest("events", F.lit(1)), 6)
    # One row of totals beside each of the rules.
    return table.join(hits, "rule_id", "left").join(F.broadcast(total), F.lit(True)).select("rule_id", "rule_type", "severity", "priority", F.coalesce("hits", F.lit(0)).alias("hits"), "last_triggered", rate.alias("match_rate"))

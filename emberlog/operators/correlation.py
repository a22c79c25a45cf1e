"""Correlated groups, attack chains and sessions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.lookback import in_ranges, joined, with_previous
from emberlog.functions.storage import stage
from emberlog.operators.components import connected_components
from emberlog.operators.scoring import mapped

# Windows of correlation in seconds, severity ranks.
WINDOWS = (("5m", 300), ("15m", 900), ("1h", 3600))
SEVERITY_RANK = {"info": 1, "low": 1, "warning": 2, "medium": 2, "high": 3, "error": 3, "critical": 4}
ENTITIES = ("ip_address", "user_id", "host")


def deduplicate(df: DataFrame, raw: str = "message", prefix: int = 256) -> DataFrame:
    """The first event, by time and id, of each (first ``prefix`` characters of the text, time, address)."""
    key = [F.substring(F.coalesce(F.col(raw), F.lit("")), 1, prefix), "us", F.coalesce("ip_address", F.lit(""))]
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy("us", "id"))).filter("__nth = 1").drop("__nth")


def entity_edges(df: DataFrame, entities: Sequence[str] = ENTITIES) -> DataFrame:
    """``id, entity``: each event and each entity that it names; null and empty ones name none."""
    named = [F.when(F.coalesce(F.col(e), F.lit("")) != "", F.concat(F.lit(f"{e}="), e)) for e in entities]
    return df.select("id", F.explode(F.array_compact(F.array(*named))).alias("entity"))


def correlated_groups(df: DataFrame, entities: Sequence[str] = ENTITIES) -> DataFrame:
    """``id, component``: events that share entities, directly or through others; the component is named by its least entity.

    Events and entities are the two sides of the graph, so an entity of ``n`` events has ``n`` edges and not ``n * n``.
    Components run over entities alone: an event ties all of its entities to the least of them.
    """
    edges = stage(entity_edges(df, entities), "entity-edges")
    least = edges.groupBy("id").agg(F.min("entity").alias("least"))
    ties = edges.join(least, "id").filter("entity <> least").select(F.col("entity").alias("src"), F.col("least").alias("dst")).distinct()
    joined = connected_components(ties)
    return least.join(joined, F.col("least") == F.col("node"), "left").select("id", F.coalesce("component", "least").alias("component"))


def _least_gaps(members: DataFrame) -> DataFrame:
    """``component, least, n``: the smallest gap in time between neighbours, and the number of times."""
    placed = with_previous(members.select("component", "us", "id"), {"before": "us"}, ["component"])
    return placed.groupBy("component").agg(F.min(F.col("us") - F.col("before")).alias("least"), F.count("us").alias("n"))


def near_in_time(members: DataFrame, window_us: int) -> DataFrame:
    """The components with two neighbours in time no more than ``window_us`` apart, or fewer than two times."""
    return _least_gaps(members).filter((F.col("n") < 2) | (F.col("least") <= window_us)).select("component")


def group_score(count: Column, rank: Column, span_seconds: Column, diversity: Column) -> Column:
    """The score of a group of events, 0 to 10, from its size, highest rank, span and number of addresses."""
    three, two = F.lit(3.0), F.lit(2.0)
    return F.round(F.least(three, count * 0.3) + rank * 0.75 + F.least(two, 100.0 / (span_seconds + 1) * 0.02) + F.least(two, diversity * 0.4), 3)


def group_entities(members: DataFrame) -> DataFrame:
    """``component, kind, value``: the distinct addresses, users, hosts and event types of each component, one row each."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for c, k in (("ip_address", "source_ips"), ("user_id", "users"), ("host", "hosts"), ("event_type", "event_types"))))
    return members.select("component", F.inline(kinds)).filter("value <> ''").distinct()


def summarise_groups(members: DataFrame) -> DataFrame:
    """One row per component of two or more events: counts, span, highest severity, score 0-10 and tags.

    ``source_ips``, ``users``, ``hosts`` and ``event_types`` are numbers of distinct values; the values themselves are
    rows of :func:`group_entities`, as a component may have any number. Of severities of one rank the first by name counts.
    """
    rank = mapped(F.lower(F.coalesce("severity", F.lit("info"))), SEVERITY_RANK, 0)
    rows = members.withColumn("__rank", rank)
    top = F.max_by("severity", F.struct(F.col("__rank"), -F.ascii("severity"), -F.length("severity")))
    failed = F.coalesce(F.bool_or(F.lower("event_type").contains("fail")), F.lit(False))
    found = rows.groupBy("component").agg(F.countDistinct("id").alias("event_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), ((F.max("us") - F.min("us")) / 1e6).alias("span_seconds"), F.max("__rank").alias("rank"), top.alias("max_severity"), failed.alias("__failed")).filter("event_count >= 2")
    kinds = ("source_ips", "users", "hosts", "event_types")
    counts = group_entities(members).groupBy("component").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    found = found.join(counts, "component", "left").withColumns({k: F.coalesce(k, F.lit(0)).cast("long") for k in kinds})
    tags = F.array_compact(F.array(F.when(F.col("source_ips") > 3, F.lit("multi_source")), F.when((F.col("span_seconds") < 60) & (F.col("event_count") >= 5), F.lit("burst_activity")), F.when(F.col("__failed"), F.lit("auth_failures"))))
    return found.withColumn("score", group_score(F.col("event_count"), F.greatest("rank", F.lit(1)), F.col("span_seconds"), F.col("source_ips"))).withColumn("tags", tags).drop("__failed")


def multi_window(members: DataFrame, windows: Sequence[tuple] = WINDOWS) -> DataFrame:
    """``window, component``: the components that pass the time filter at each window; components are made once."""
    table = F.array(*(F.struct(F.lit(n).alias("window"), F.lit(s * 1_000_000).alias("us")) for n, s in windows))
    return _least_gaps(members).withColumn("w", F.explode(table)).filter("n < 2 OR least <= w.us").select("w.window", "component")


def entity_groups(df: DataFrame) -> DataFrame:
    """Addresses and users of more than one event: ``kind, entity, n, confidence, risk``."""
    out = None
    for kind, column, confidence in (("ip", "ip_address", 0.6), ("user", "user_id", 0.55)):
        part = df.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("entity")).agg(F.count("*").alias("n")).filter("n > 1")
        part = part.select(F.lit(kind).alias("kind"), "entity", "n", F.lit(confidence).alias("confidence"), F.least(F.lit(10.0), F.col("n") * 0.5).alias("risk"))
        out = part if out is None else out.unionAll(part)
    return out


def followed_by(df: DataFrame, group: str) -> DataFrame:
    """``src, dst``: each event of a group and the next one in time."""
    return with_previous(df.select(group, "us", "id"), {"src": "id"}, [group]).filter("src IS NOT NULL").select(group, "src", F.col("id").alias("dst"))


@dataclass(frozen=True)
class Pattern:
    """An attack chain: steps of (name, event types, keywords), all required."""

    id: str
    severity: str
    steps: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]


# The built-in chains.
PATTERNS = (
    Pattern("ACP001", "high", (
        ("recon", ("recon_scanning", "discovery"), ("nmap", "scan", "enum")),
        ("brute_force", ("auth_failure", "brute_force"), ("failed", "invalid", "password_spray")),
        ("access_gained", ("auth_success", "login"), ("authenticated", "success", "session_opened")),
        ("privilege_escalation", ("privilege_escalation", "sudo"), ("sudo", "su ", "admin", "elevated")))),
    Pattern("ACP002", "critical", (
        ("network_scan", ("recon_scanning", "port_scan"), ("nmap", "masscan", "scan")),
        ("exploit", ("exploit", "vulnerability"), ("exploit", "CVE", "buffer_overflow", "RCE")),
        ("execution", ("execution", "command_injection"), ("cmd", "shell", "exec", "whoami")),
        ("persistence", ("persistence_mechanism", "cron"), ("crontab", "startup", "registry", "service_install")))),
    Pattern("ACP003", "high", (
        ("phishing_received", ("email", "phishing"), ("phish", "attachment", "malicious_url")),
        ("initial_access", ("auth_success", "execution"), ("credential", "access", "login")),
        ("lateral_movement", ("lateral_movement", "remote_service"), ("psexec", "wmi", "rdp", "smb", "lateral")),
        ("data_collection", ("collection", "file_access"), ("staged", "archive", "compress", "xcopy")))),
    Pattern("ACP004", "critical", (
        ("initial_access", ("auth_success", "execution", "phishing"), ("phish", "exploit", "macros")),
        ("recon_internal", ("discovery", "recon_scanning"), ("net view", "ipconfig", "whoami", "domain_enum")),
        ("lateral_movement", ("lateral_movement",), ("psexec", "wmi", "lateral")),
        ("disable_defenses", ("defense_evasion",), ("av_disabled", "defender", "wdav")),
        ("encryption", ("ransomware", "file_modification"), ("encrypt", ".locked", ".crypt", "readme_decrypt")))),
    Pattern("ACP005", "high", (
        ("initial_access", ("auth_success", "initial_access"), ("login", "session")),
        ("discovery", ("discovery", "file_access"), ("ls", "dir", "find", "locate")),
        ("collection", ("collection", "file_access"), ("copy", "zip", "tar", "archive")),
        ("exfiltration", ("data_exfiltration", "network"), ("upload", "ftp", "scp", "http_post", "exfil")))),
    Pattern("ACP006", "critical", (
        ("credential_dumping", ("credential_dumping",), ("mimikatz", "lsass", "hashdump", "sekurlsa")),
        ("lateral_movement_1", ("lateral_movement",), ("pass_the_hash", "pass_the_ticket", "overpass")),
        ("remote_execution", ("execution", "remote_service"), ("psexec", "wmi", "winrm", "remote_shell")),
        ("lateral_movement_2", ("lateral_movement",), ("smb", "rdp", "ssh")),
        ("persistence", ("persistence_mechanism",), ("registry", "service", "scheduled_task")))),
    Pattern("ACP007", "high", (
        ("web_recon", ("recon_scanning", "http"), ("dirb", "nikto", "gobuster", "spider")),
        ("injection", ("sql_injection", "command_injection", "xss"), ("union", "sleep(", "exec(", "alert(")),
        ("web_shell", ("web_shell", "execution"), ("webshell", "cmd.php", "shell.aspx", "c99")),
        ("pivoting", ("lateral_movement", "network"), ("curl", "wget", "netcat", "pivot")))),
    Pattern("ACP008", "high", (
        ("malware_exec", ("malware_execution", "execution"), ("malware", "trojan", "dropper")),
        ("dns_c2_setup", ("dns_tunnelling", "dns"), ("dnscat", "iodine", "dns_query_large")),
        ("c2_comm", ("c2_communication",), ("beacon", "heartbeat", "c2", "callback")),
        ("exfil_via_dns", ("data_exfiltration", "dns_tunnelling"), ("dns_exfil", "txt_record_large")))),
    Pattern("ACP009", "high", (
        ("off_hours_login", ("auth_success", "login"), ("weekend", "night", "off_hours")),
        ("bulk_file_access", ("file_access", "collection"), ("bulk_download", "mass_copy", "large_download")),
        ("cloud_upload", ("data_exfiltration",), ("dropbox", "gdrive", "onedrive", "s3", "upload")))),
    Pattern("ACP010", "critical", (
        ("software_update", ("software_update", "execution"), ("update", "patch", "installer", "package")),
        ("malicious_exec", ("malware_execution", "execution"), ("svchost", "rundll32", "powershell", "wscript")),
        ("c2_beacon", ("c2_communication",), ("beacon", "callback", "c2")),
        ("credential_harvest", ("credential_dumping", "credential_access"), ("credentials", "token", "api_key")))),
    Pattern("ACP011", "high", (
        ("credential_phish", ("phishing", "auth_failure"), ("phish", "mfa_push", "token_theft")),
        ("cloud_login", ("auth_success",), ("cloud", "aws", "azure", "gcp", "console_login")),
        ("enumeration", ("discovery",), ("list_buckets", "list_instances", "describe_")),
        ("resource_abuse", ("execution", "data_exfiltration"), ("launch_instance", "create_user", "get_object")))),
    Pattern("ACP012", "high", (
        ("stuffing_attempt", ("brute_force", "auth_failure"), ("credential_stuff", "password_spray", "401", "403")),
        ("successful_login", ("auth_success",), ("200", "authenticated", "session_created")),
        ("account_manipulation", ("account_modification",), ("change_email", "change_phone", "add_payment")))),
)


def satisfies(event_type: Column, raw: Column, step: tuple, empty_fits: bool = False) -> Column:
    """The type contains one of the step's, or is contained in it, or the text has a keyword. An empty type fits only on request."""
    _, types, words = step
    kind, text = F.lower(F.coalesce(event_type, F.lit(""))), F.lower(F.coalesce(raw, F.lit("")))
    out = F.lit(False)
    for t in types:
        out = out | kind.contains(t.lower()) | ((kind != "") & F.lit(t.lower()).contains(kind))
    for w in words:
        out = out | text.contains(w.lower())
    return out | (kind == "") if empty_fits else out


def step_tags(df: DataFrame, raw: str = "message", patterns: Sequence[Pattern] = PATTERNS, empty_fits: bool = False) -> DataFrame:
    """``df`` once for each (``pattern``, ``step``) that an event satisfies."""
    tags = [F.when(satisfies(F.col("event_type"), F.col(raw), s, empty_fits), F.struct(F.lit(p.id).alias("pattern"), F.lit(i).alias("step"))) for p in patterns for i, s in enumerate(p.steps)]
    return df.withColumn("__tag", F.explode(F.array_compact(F.array(*tags)))).select(*df.columns, "__tag.pattern", "__tag.step")


def match_chains(df: DataFrame, scope: Sequence[str] = ("ip_address",), raw: str = "message", patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """Greedy ordered matches per scope and pattern: ``matched`` steps, ``ratio``, ``confidence``, ``is_partial``.

    Each step takes the first event after the one before it took; a step without one is passed over. Step by step, the
    earliest satisfying event after the cursor is an aggregate with one row per scope and pattern, joined to the next
    step's events, so no scope is gathered into one row, and the whole batch as one scope (no columns) works alike.
    At least half of the steps must match.
    """
    scope = list(scope)
    place = F.struct("us", "id")
    events = stage(step_tags(df, raw, patterns).select(*scope, "pattern", "step", place.alias("at")), "chain-steps")
    keys = [*scope, "pattern"]
    n_steps = mapped(F.col("pattern"), {p.id: len(p.steps) for p in patterns}, 1)
    cursor = None
    for i in range(max(len(p.steps) for p in patterns)):
        own = events.filter(F.col("step") == i)
        if cursor is None:
            cursor = own.groupBy(*keys).agg(F.min("at").alias("at"), F.lit(1).alias("matched"))
            continue
        seen = cursor.select(*keys, F.col("at").alias("__from"), "matched")
        hits = own.join(seen, keys, "left").filter("__from IS NULL OR at > __from").groupBy(*keys).agg(F.min("at").alias("__at"))
        cursor = cursor.join(hits, keys, "full").select(*keys, F.coalesce("__at", "at").alias("at"), (F.coalesce("matched", F.lit(0)) + F.when(F.col("__at").isNotNull(), 1).otherwise(0)).alias("matched"))
        cursor = stage(cursor, "chain-cursor")
    total = df.groupBy(*scope).agg(F.count("*").alias("events"))
    joined = cursor.join(total, scope) if scope else cursor.join(F.broadcast(total), F.lit(True))
    ratio = F.col("matched") / n_steps
    confidence = F.least(F.lit(1.0), F.round(ratio * 0.7 + F.least(F.lit(0.3), F.col("matched") / F.greatest("events", F.lit(1)) * 0.3), 3))
    return joined.select(*keys, "matched", ratio.alias("ratio"), confidence.alias("confidence"), (ratio < 1).alias("is_partial")).filter("ratio >= 0.5")


# Words of privileged actions, points of a session's anomalies.
PRIVILEGE_WORDS = ("sudo", "su ", "runas", "admin", "root", "privilege", "elevated", "setuid")
SESSION_POINTS = {"burst_activity": 2.5, "privilege_escalation": 3.0, "abnormal_duration": 1.5, "impossible_travel": 4.0}
_PART, _AT = "__part", "__at"


def session_key(raw_id: str = "id") -> Column:
    """Address, user and host as one text; an event with neither address nor user has its own."""
    empty = (F.coalesce("ip_address", F.lit("")) == "") & (F.coalesce("user_id", F.lit("")) == "")
    return F.concat_ws("|", F.coalesce("ip_address", F.lit("")), F.coalesce("user_id", F.lit("")), F.coalesce("host", F.lit("")), F.when(empty, F.col(raw_id)))


def sessionize(df: DataFrame, timeout_us: int = 1_800_000_000, keep_parts: bool = False) -> DataFrame:
    """``df`` with ``session``: a new one after a gap of over ``timeout_us`` in one (address, user, host).

    A gap of exactly the time-out stays. An event with neither address nor user is a session by itself; so is one without
    a time. A segmented scan: rows are dealt by ranges of key and time; a range tells of each of its keys the first and
    last time and how many sessions begin inside, and over these rows, one a key and range, the numbers go on. So no
    key is one task's. ``keep_parts`` leaves range and place (``__part``, ``__at``) for :func:`session_summary`.
    """
    rows = in_ranges(df.withColumn("__key", session_key()), ["__key", "us", "id"])
    inside = Window.partitionBy(_PART, "__key").orderBy(_AT)
    begins = lambda gap: F.when(gap <= timeout_us, 0).otherwise(1)
    rows = rows.withColumn("__new", F.when(F.row_number().over(inside) == 1, 0).otherwise(begins(F.col("us") - F.lag("us").over(inside)))).withColumn("__in", F.sum("__new").over(inside))
    ends = rows.groupBy("__key", _PART).agg(F.min_by("us", _AT).alias("lo"), F.max("us").alias("hi"), F.sum("__new").alias("new"))
    along = Window.partitionBy("__key").orderBy(_PART)
    ends = ends.withColumn("first", begins(F.col("lo") - F.lag("hi").over(along)))
    before = F.coalesce(F.sum(F.col("first") + F.col("new")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("first")
    placed = joined(rows, ends.select("__key", _PART, before.alias("__base")), ["__key", _PART])
    kept = [f"`{c}`" for c in df.columns] + [_PART, _AT] * keep_parts
    return placed.select(*kept, F.concat_ws("#", "__key", F.col("__base") + F.col("__in")).alias("session"))


def session_summary(events: DataFrame, raw: str = "message", burst_per_minute: float = 60, travel_hours: float = 1500 / 700) -> DataFrame:
    """One row per session: count, times, the four anomalies, ``risk`` 0-10. Anomalies are tested at each event.

    Rows lie in ranges, as :func:`sessionize` leaves them, or are dealt so. A range knows of each session it holds how many
    events, the first time and the last place; what the ranges before bring along is put together over one row a session
    and range, and every event is then tested where it lies.
    """
    rows = events if {_PART, _AT} <= set(events.columns) else in_ranges(events, ["session", "us", "id"])
    text = F.lower(F.coalesce(F.nullif(F.col(raw), F.lit("")), "event_type", F.lit("")))
    privileged = F.lit(False)
    for w in PRIVILEGE_WORDS:
        privileged = privileged | text.contains(w)
    located = F.when(F.coalesce("country", F.lit("")) != "", F.struct("country", "us"))
    rows = rows.select("session", _PART, _AT, "us", "country", privileged.alias("__priv"), located.alias("__place"))
    ends = rows.groupBy("session", _PART).agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max_by("__place", F.when(F.col("__place").isNotNull(), F.col(_AT))).alias("place"))
    before = Window.partitionBy("session").orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    brought = [F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.min("lo").over(before).alias("__lo"), F.last("place", ignorenulls=True).over(before).alias("__from")]
    rows = joined(rows, ends.select("session", _PART, *brought), ["session", _PART])
    inside = Window.partitionBy(_PART, "session").orderBy(_AT)
    start = F.least("__lo", F.min("us").over(inside))
    seconds = (F.col("us") - start) / 1e6
    rate = (F.col("__n") + F.row_number().over(inside)) / F.nullif(seconds / 60, F.lit(0.0))
    last = F.coalesce(F.last("__place", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__from"))
    rows = rows.withColumn("__burst", (seconds >= 1) & (rate > burst_per_minute)).withColumn("__last", last)
    jump = (F.col("__last.country") != F.col("country")) & ((F.col("us") - F.col("__last.us")) / 3.6e9 < travel_hours)
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = rows.groupBy("session").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), flag(F.col("__burst")).alias("burst_activity"), flag(F.col("__priv")).alias("privilege_escalation"), flag(jump & (F.col("country") != "")).alias("impossible_travel"))
    found = found.withColumn("abnormal_duration", (F.col("end_us") - F.col("start_us")) / 1e6 > 8 * 3600)
    points = sum((F.when(F.col(k), v).otherwise(0.0) for k, v in SESSION_POINTS.items()), F.lit(0.0))
    return found.withColumn("risk", F.round(F.least(F.lit(10.0), points + F.least(F.lit(2.0), F.col("n") * 0.02)), 2))


def session_states(sessions: DataFrame, reference_us: int, timeout_us: int = 1_800_000_000, high: float = 6.0) -> DataFrame:
    """``sessions`` with ``state`` (open or expired at a time) and ``high_risk``."""
    return sessions.withColumn("state", F.when(reference_us - F.col("end_us") > timeout_us, "expired").otherwise("open")).withColumn("high_risk", F.col("risk") >= high)

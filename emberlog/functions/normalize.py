"""Raw log lines to the canonical schema: one native projection whose branches are the formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.scoring import mapped

# The shapes of lines.
RFC3164 = r"(?s)^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s{1,2}\d{1,2}\s\d{2}:\d{2}:\d{2})\s(\S+)\s([^\[:]+?)(?:\[(\d+)\])?:\s(.*)$"
RFC5424 = r"(?s)^<(\d{1,3})>(\d+)\s(\S+)\s(\S+)\s(\S+)\s(\S+)\s(\S+)\s(-|\[.*?\])\s?(.*)$"
ACCESS = r'^(\S+)\s\S+\s(\S+)\s\[([^\]]+)\]\s"(\S+)\s(\S+)\s([^"]+)"\s(\d{3})\s(\S+)(?:\s"([^"]*)"\s"([^"]*)")?'
CEF = r"(?s)^CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
CEF_PAIR = r"(\w+)=([^ ]+(?:\s+(?!\w+=)[^ ]+)*)"
IP, USER = r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"(?i)(?:user|username)[=:\s]+(\S+)"
LEADING_TIME = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?|[A-Z][a-z]{2}\s{1,2}\d{1,2}\s\d{2}:\d{2}:\d{2})"
# Patterns of written times, in the order in which they are tried.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx", "yyyy-MM-dd'T'HH:mm:ss.SSSxx", "yyyy-MM-dd'T'HH:mm:ssxx", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MMM/yyyy:HH:mm:ss xx", "yyyy MMM d HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "dd-MM-yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "d MMM yyyy HH:mm:ss xx", "yyyyMMddHHmmss", "yyyyMMdd",
)
# Severities of syslog codes, of keywords (in the order in which they are looked for) and of Windows levels.
SYSLOG_SEVERITY = ("critical", "critical", "critical", "error", "warning", "info", "info", "info")
KEYWORD_SEVERITY = {"informational": "info", "critical": "critical", "failure": "error", "warning": "warning", "failed": "error", "notice": "info", "emerg": "critical", "alert": "critical", "error": "error", "debug": "info", "crit": "critical", "warn": "warning", "info": "info", "err": "error"}
WINDOWS_LEVEL = {"0": "critical", "1": "critical", "2": "error", "3": "warning", "4": "info", "5": "info", "critical": "critical", "error": "error", "warning": "warning", "information": "info", "verbose": "info"}
# Names under which a JSON record gives a field, first that is there.
JSON_NAMES = {
    "time": ("timestamp", "time", "ts", "@timestamp", "date", "datetime"), "severity": ("severity", "level", "priority"), "message": ("message", "msg", "log", "text"), "host": ("host", "hostname", "computer"),
    "ip": ("ip", "ip_address", "src_ip", "remote_addr"), "user": ("user", "username", "user_name"), "process": ("process", "process_name", "app", "application"), "type": ("event_type", "type", "category"),
}
JSON_TAKEN = ("timestamp", "time", "ts", "@timestamp", "message", "msg", "severity", "level", "host", "hostname", "ip", "user")
SENSITIVE = "password|token|secret|key|credential|auth"
SOURCE_TYPES = ("network", "system", "application", "api", "file", "stream", "custom")
#: A field of a CSV line with the comma before it: what is quoted, what follows the quotes, or plain text.
CSV_FIELD = r',(?:"([^"]*(?:""[^"]*)*)(?:"([^,]*)|$)|([^,]*))'


def time_shape(pattern: str) -> str:
    """A regular expression that every text read by ``pattern`` fits: to try a pattern in vain costs far more."""
    out = ["(?i)^"]
    for quoted, letters, letter, other in re.findall(r"'([^']*)'|(([A-Za-z])\3*)|([^A-Za-z'])", pattern):
        named = {"MMM": "[a-z.]+", "a": "[a-z.]+", "X": r"(?:Z|[+-]\d+)", "xx": r"[+-]\d+", "SSS": r"\d*", "SSSSSS": r"\d*"}
        part = named.get(letters, r"[+-]?\d+") if letters else re.escape(quoted or other)
        if part != out[-1]:  # numbers without anything between them are one
            out.append(part)
    return "".join(out) + "$"


def parse_time(text: Column, year: int = 2026) -> Column:
    """A written time in UTC; null if no pattern fits. Epoch seconds and milliseconds count from 2000 to 2100; times
    without a year are in ``year``."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+", "")  # days of the week say nothing new
    n = t.try_cast("long")
    seconds = F.when(t.rlike(r"^\d{10}$") & n.between(946684800, 4102444800), F.timestamp_micros(n * 1_000_000))
    millis = F.when(t.rlike(r"^\d{13}$") & n.between(946684800000, 4102444800000), F.timestamp_micros(n * 1000))
    syslog = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(t, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    tried = [F.when(t.rlike(time_shape(f)), F.try_to_timestamp(t, F.lit(f))) for f in TIME_FORMATS]
    return F.coalesce(seconds, millis, *tried, F.when(t.rlike(r"^[A-Z][a-z]{2}\s"), syslog))


def csv_fields(line: Column) -> Column:
    """The fields of one CSV line, empty ones too, each in its place; quotes may hold commas and, doubled, quotes."""
    quoted, rest, plain = (F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CSV_FIELD), F.lit(i)) for i in (1, 2, 3))
    return F.transform(F.arrays_zip(quoted.alias("q"), rest.alias("r"), plain.alias("p")), lambda x: F.concat(F.replace(x["q"], F.lit('""'), F.lit('"')), x["r"], x["p"]))


def keyword_severity(word: Column) -> Column:
    """The severity that a word stands for; info for others."""
    return mapped(F.lower(F.trim(word)), KEYWORD_SEVERITY, "info")


def text_severity(text: Column) -> Column:
    """The severity of the first keyword, in their fixed order, that a text has; info without one."""
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit("info"))
    for word, severity in KEYWORD_SEVERITY.items():
        out = out.when(low.contains(word), F.lit(severity))
    return out.otherwise(F.lit("info"))


def syslog_severity(pri: Column) -> Column:
    """The severity in the lowest three bits of a syslog priority."""
    return F.get(F.array(*map(F.lit, SYSLOG_SEVERITY)), pri.bitwiseAND(7))


def http_severity(status: Column) -> Column:
    """Error for a status of 500 or more, warning for 400 or more, else info."""
    return F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")


def first_ip(text: Column) -> Column:
    """The first text that looks like an IPv4 address; empty without one."""
    return F.regexp_extract(text, IP, 0)


def first_user(text: Column) -> Column:
    """The first name after user or username; empty without one."""
    return F.regexp_extract(text, USER, 1)


def format_of(raw: Column) -> Column:
    """Which format a line has, tried in a fixed order; a one-line text with a comma is CSV."""
    t = F.trim(raw)
    return F.when(t.startswith("CEF:"), "cef").when(t.rlike(RFC5424), "rfc5424").when(t.rlike(RFC3164), "rfc3164").when(t.rlike(ACCESS), "access").when(t.startswith("{") & F.try_parse_json(t).isNotNull(), "json").when(t.contains(",") & ~t.contains("\n"), "csv").otherwise("plain")


def _pairs(*items) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(k) for k, _ in items)), F.array(*(F.coalesce(v.cast("string"), F.lit("")) for _, v in items)))


def normalize_logs(df: DataFrame, source: str = "", source_type: str = "", raw: str = "value", year: int = 2026, preserve_severity: bool = False) -> DataFrame:
    """Rows in the canonical schema, all other columns of ``df`` kept. ``parse_error`` tells what is wrong, else null.

    Times that can't be read are null and an error, not "now"; a CEF severity that is no number is an error too.
    """
    t = F.trim(F.coalesce(F.col(raw).cast("string"), F.lit("")))
    df = df.withColumn("__raw", t).withColumn("__f", format_of(F.col("__raw")))
    t, kind = F.col("__raw"), F.col("__f")
    g = lambda p, i: F.regexp_extract(t, p, i)
    df = df.withColumn("__j", F.when(kind == "json", F.from_json(t, "map<string,string>")))
    json = lambda name, default="": F.coalesce(*(F.try_element_at("__j", F.lit(n)) for n in JSON_NAMES[name]), F.lit(default))
    j = lambda *names: F.coalesce(*(F.try_element_at("__j", F.lit(n)) for n in names), F.lit(""))
    windows = (kind == "json") & (F.map_contains_key("__j", "EventID") | (F.map_contains_key("__j", "Level") & F.map_contains_key("__j", "Computer")))
    keys, values = F.regexp_extract_all(g(CEF, 8), F.lit(CEF_PAIR), F.lit(1)), F.regexp_extract_all(g(CEF, 8), F.lit(CEF_PAIR), F.lit(2))
    distinct = F.array_distinct(keys)
    # Of a key that repeats the last value counts: its place from the end is found in the reversed list.
    df = df.withColumn("__e", F.when(kind == "cef", F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.get(F.reverse(values), (F.array_position(F.reverse(keys), k) - 1).cast("int"))))))
    ext = lambda *names: F.coalesce(*(F.try_element_at("__e", F.lit(n)) for n in names), F.lit(""))
    df = df.withColumn("__w", windows).withColumn("__c", F.when(kind == "csv", csv_fields(t)))
    w = F.coalesce(F.col("__w"), F.lit(False))
    pri = F.coalesce(F.nullif(F.when(kind == "rfc5424", g(RFC5424, 1)).otherwise(g(RFC3164, 1)), F.lit("")).try_cast("int"), F.lit(13))
    status, cef_severity = g(ACCESS, 7).try_cast("int"), F.coalesce(F.nullif(g(CEF, 7), F.lit("")), F.lit("0")).try_cast("int")
    message = F.when(kind == "rfc5424", g(RFC5424, 9)).when(kind == "rfc3164", g(RFC3164, 6)).when(kind == "cef", g(CEF, 6)).when(kind == "access", F.concat_ws(" ", g(ACCESS, 4), g(ACCESS, 5), g(ACCESS, 7))).when(w, j("Message", "message", "Description")).when(kind == "json", json("message")).when(kind == "csv", F.coalesce(F.get("__c", 1), t)).otherwise(F.substring(t, 1, 2000))
    written = F.when(kind == "rfc5424", g(RFC5424, 3)).when(kind == "rfc3164", g(RFC3164, 2)).when(kind == "cef", ext("rt", "start", "end")).when(kind == "access", g(ACCESS, 3)).when(w, j("TimeCreated", "timestamp")).when(kind == "json", json("time")).when(kind == "csv", F.get("__c", 0)).otherwise(F.regexp_extract(t, LEADING_TIME, 1))
    severity = F.when(kind.isin("rfc5424", "rfc3164"), syslog_severity(pri)).when(kind == "cef", F.when(cef_severity <= 3, "info").when(cef_severity <= 6, "warning").when(cef_severity <= 8, "error").otherwise("critical")).when(kind == "access", http_severity(status)).when(w, mapped(F.lower(j("Level", "level")), WINDOWS_LEVEL, "info"))
    severity = severity.when(kind == "json", json("severity", "info") if preserve_severity else keyword_severity(json("severity", "info"))).when(kind == "csv", "info").otherwise(text_severity(t))
    # Columns of their own: what follows reads them many times.
    df = df.withColumn("__m", message).withColumn("__when", written)
    m = F.col("__m")
    plainly = kind.isin("rfc5424", "rfc3164")
    ip = F.when(plainly, first_ip(m)).when(kind == "cef", ext("dst", "src")).when(kind == "access", g(ACCESS, 1)).when(w, "").when(kind == "json", F.coalesce(F.nullif(json("ip"), F.lit("")), first_ip(m))).when(kind == "csv", "").otherwise(first_ip(t))
    user = F.when(plainly, first_user(m)).when(kind == "cef", ext("duser", "suser")).when(kind == "access", F.regexp_replace(g(ACCESS, 2), "^-$", "")).when(w, j("SubjectUserName", "user")).when(kind == "json", F.coalesce(F.nullif(json("user"), F.lit("")), first_user(m))).when(kind == "csv", "").otherwise(first_user(t))
    host = F.when(kind == "rfc5424", g(RFC5424, 4)).when(kind == "rfc3164", g(RFC3164, 3)).when(kind == "cef", ext("dhost", "shost")).when(w, j("Computer", "host")).when(kind == "json", json("host")).otherwise("")
    process = F.when(kind == "rfc5424", g(RFC5424, 5)).when(kind == "rfc3164", F.trim(g(RFC3164, 4))).when(kind == "cef", ext("app")).when(w, j("ProcessName", "process")).when(kind == "json", json("process")).otherwise("")
    event_type = F.when(kind == "rfc5424", "syslog5424").when(kind == "rfc3164", "syslog").when(kind == "cef", F.concat(F.lit("cef_"), g(CEF, 5))).when(kind == "access", "http_access").when(w, F.concat(F.lit("windows_event_"), j("EventID", "Id"))).when(kind == "json", json("type", "json_log")).when(kind == "csv", "csv_log").otherwise("plaintext_log")
    fields = F.when(kind == "rfc5424", _pairs(("pri", pri), ("facility", F.shiftright(pri, 3)), ("severity_code", pri.bitwiseAND(7)), ("version", g(RFC5424, 2)), ("procid", g(RFC5424, 6)), ("msgid", g(RFC5424, 7)), ("structured_data", g(RFC5424, 8))))
    fields = fields.when(kind == "rfc3164", _pairs(("pri", pri), ("facility", F.shiftright(pri, 3)), ("severity_code", pri.bitwiseAND(7)), ("pid", g(RFC3164, 5))))
    fields = fields.when(kind == "access", _pairs(("method", g(ACCESS, 4)), ("path", g(ACCESS, 5)), ("protocol", g(ACCESS, 6)), ("status_code", status), ("bytes", g(ACCESS, 8)), ("referer", g(ACCESS, 9)), ("user_agent", g(ACCESS, 10))))
    fields = fields.when(kind == "cef", F.map_concat(F.map_filter("__e", lambda k, v: ~k.isin("vendor", "product", "signature_id", "cef_severity")), _pairs(("vendor", g(CEF, 2)), ("product", g(CEF, 3)), ("signature_id", g(CEF, 5)), ("cef_severity", g(CEF, 7)))))
    fields = fields.when(kind == "json", F.map_filter("__j", lambda k, v: ~k.isin(*JSON_TAKEN) & v.isNotNull()))
    fields = fields.when(kind == "csv", F.map_from_entries(F.transform("__c", lambda v, i: F.struct(F.concat(F.lit("field_"), i.cast("string")), v)))).otherwise(F.create_map().cast("map<string,string>"))
    ts = F.col("__ts")
    # Generated, so that a filter on the time or the error stays above and doesn't write all of it out again for each use.
    df = df.select("*", F.inline(F.array(F.struct(parse_time(F.col("__when"), year).alias("__ts")))))
    error = F.when(t == "", "empty").when((kind == "cef") & cef_severity.isNull(), "severity is no number").when(ts.isNull(), "no readable time")
    return df.select(
        *(f"`{c}`" for c in df.columns if not c.startswith("__")), ts.alias("ts"), F.lit(source).alias("source"), canonical_source_type(F.lit(source_type)).alias("source_type"), severity.alias("severity"), m.alias("message"), host.alias("host"), ip.alias("ip_address"), user.alias("user_id"), process.alias("process_name"),
        event_type.alias("event_type"), t.alias("raw_log"), F.array().cast("array<string>").alias("tags"), fields.alias("parsed_fields"), F.when(w, "windows").otherwise(kind).alias("parse_format"), error.alias("parse_error"),
    )


def canonical_source_type(kind: Column) -> Column:
    """A known source type, or custom."""
    return F.when(kind.isin(*SOURCE_TYPES), kind).otherwise(F.lit("custom"))


def redact(fields: Column, words: str = SENSITIVE) -> Column:
    """A map's values replaced where the key has a sensitive word."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).rlike(words), F.lit("[REDACTED]")).otherwise(v))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as top-level columns with dotted names."""
    def leaves(schema, prefix=()):
        for f in schema.fields:
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, (*prefix, f.name))
            else:
                yield (*prefix, f.name)

    return df.select(*(F.col(".".join(f"`{x}`" for x in path)).alias(".".join(path)) for path in leaves(df.schema)))


def valid_ip(ip: Column) -> Column:
    """Whether a text is an IPv4 address; null isn't."""
    return F.coalesce(ip.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"), F.lit(False))


def private_ip(ip: Column) -> Column:
    """Whether an address is private, local or link-local; null isn't."""
    return F.coalesce(ip.rlike(r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"), F.lit(False))


def quality_report(df: DataFrame, by: str = "source", required=("ts", "message", "event_type")) -> DataFrame:
    """Per ``by``: rows, rows with a missing required field, valid and private addresses, known severities."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull() | (F.col(c).cast("string") == "")
    known = F.col("severity").isin("info", "warning", "error", "critical")
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(missing).alias("missing"), F.count_if(valid_ip(F.col("ip_address"))).alias("valid_ips"), F.count_if(private_ip(F.col("ip_address"))).alias("private_ips"), F.count_if(known).alias("known_severities"))

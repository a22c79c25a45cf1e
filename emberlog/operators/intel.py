"""Threat intelligence: indicators, look-ups that are joins, and enrichment."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.storage import stage

#: Rows up to which a dimension is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Values that are compiled into a projection; more are looked for by an automaton.
SHORT_LIST = 200
#: Characters of an automaton's values (about 100 bytes each in a worker); more are joined.
PART_CHARS = 1_000_000
#: Bits of the bitmap of values' beginnings: 8 MB, whatever the number of values.
BITMAP_BITS = 1 << 26
INDICATOR = "indicator string, indicator_type string, category string, score double, techniques array<string>, custom boolean"

# Listed addresses (address, category, score, techniques).
LISTED_IPS = (
    ("185.220.101.1", "tor_exit", 75, ()), ("185.220.101.2", "tor_exit", 75, ()),
    ("194.165.16.10", "scanner", 80, ()), ("194.165.16.11", "scanner", 80, ()),
    ("45.153.160.2", "c2", 95, ("T1071", "T1090")), ("45.153.160.3", "c2", 95, ("T1071", "T1090")),
    ("198.54.117.200", "spam", 60, ()), ("198.54.117.201", "spam", 60, ()),
    ("91.108.4.1", "malware_dist", 90, ("T1105",)), ("91.108.4.2", "malware_dist", 90, ("T1105",)),
    ("5.188.206.100", "bruteforce", 85, ("T1110",)), ("5.188.206.101", "bruteforce", 85, ("T1110",)),
    ("103.21.244.1", "phishing", 88, ("T1566",)), ("103.21.244.2", "phishing", 88, ("T1566",)),
    ("162.55.35.30", "scanner", 70, ()), ("162.55.35.31", "scanner", 70, ()),
    ("193.32.127.50", "c2", 92, ("T1071", "T1219")), ("193.32.127.51", "c2", 92, ("T1071", "T1219")),
    ("209.141.42.100", "anonymizer", 65, ()), ("209.141.42.101", "anonymizer", 65, ()),
    ("185.107.94.1", "ransomware", 98, ("T1486", "T1071")), ("185.107.94.2", "ransomware", 98, ("T1486", "T1071")),
    ("77.73.133.70", "botnet", 87, ("T1583", "T1090")), ("77.73.133.71", "botnet", 87, ("T1583", "T1090")),
    ("213.32.122.100", "exploit_kit", 91, ("T1190",)), ("5.34.179.60", "credential_theft", 89, ("T1078",)),
    ("176.58.100.1", "cryptominer", 72, ("T1496",)), ("176.58.100.2", "cryptominer", 72, ("T1496",)),
    ("185.244.25.200", "scanner", 68, ()), ("185.244.25.201", "scanner", 68, ()),
)
# Domains (domain, category, score, techniques).
DOMAINS = (
    ("evil-c2-server.xyz", "c2", 95, ("T1071",)), ("malware-domain.ru", "malware_dist", 90, ("T1105",)),
    ("suspicious-exfil.net", "exfiltration", 88, ("T1048",)), ("phishing-login.com", "phishing", 85, ("T1566",)),
    ("update-now-patch.org", "phishing", 82, ("T1566",)), ("free-vpn-proxy.net", "anonymizer", 60, ()),
    ("cdn-delivery-fast.xyz", "typosquatting", 78, ()), ("windowsupdate-cdn.org", "typosquatting", 80, ()),
    ("secure-paypal-login.com", "phishing", 90, ("T1566",)), ("ransomware-payment.onion", "ransomware", 99, ("T1486",)),
)
# Attack signatures (name, pattern, technique, severity), and the score of each severity.
SIGNATURES = (
    ("SIG_SQLI_UNION", r"union.{0,20}select", "T1190", "high"),
    ("SIG_SQLI_TAUTOL", r"'\s*or\s*'1'\s*=\s*'1", "T1190", "high"),
    ("SIG_XSS_SCRIPT", r"<script[^>]*>", "T1059.007", "medium"),
    ("SIG_CMD_INJECT", r";\s*(ls|cat|id|whoami|uname)", "T1059", "high"),
    ("SIG_PATH_TRAVERSAL", r"\.\./|%2e%2e%2f", "T1190", "high"),
    ("SIG_LOG4SHELL", r"\$\{jndi:", "T1190", "critical"),
    ("SIG_SHELLSHOCK", r"\(\s*\)\s*\{.*\}", "T1190", "critical"),
    ("SIG_HEARTBLEED", r"heartbeat.*overflow", "T1190", "critical"),
    ("SIG_MIMIKATZ", r"(sekurlsa|lsadump|kerberos::)", "T1003", "critical"),
    ("SIG_COBALT_STRIKE", r"(beacon|cobaltstrike|cs\.exe)", "T1219", "critical"),
)
SIGNATURE_SCORE = {"critical": 95.0, "high": 80.0, "medium": 60.0, "low": 40.0}
# Techniques (id, name, tactic).
TECHNIQUES = (
    ("T1059", "Command and Scripting Interpreter", "Execution"), ("T1059.007", "JavaScript", "Execution"),
    ("T1071", "Application Layer Protocol", "Command and Control"), ("T1071.004", "DNS", "Command and Control"),
    ("T1078", "Valid Accounts", "Privilege Escalation"), ("T1083", "File and Directory Discovery", "Discovery"),
    ("T1090", "Proxy", "Command and Control"), ("T1105", "Ingress Tool Transfer", "Command and Control"),
    ("T1110", "Brute Force", "Credential Access"), ("T1136", "Create Account", "Persistence"),
    ("T1190", "Exploit Public-Facing Application", "Initial Access"), ("T1219", "Remote Access Software", "Command and Control"),
    ("T1486", "Data Encrypted for Impact", "Impact"), ("T1496", "Resource Hijacking", "Impact"),
    ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltration"), ("T1003", "OS Credential Dumping", "Credential Access"),
    ("T1562.004", "Disable or Modify System Firewall", "Defense Evasion"), ("T1566", "Phishing", "Initial Access"),
    ("T1583", "Acquire Infrastructure", "Resource Development"), ("T1595", "Active Scanning", "Reconnaissance"),
)
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
DOMAIN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+(?:com|net|org|xyz|ru|onion|io|co)\b"


def builtin_indicators(spark: SparkSession) -> DataFrame:
    """The built-in indicators: listed ones, and two ranges of documentation addresses made by rule."""
    rows = [(v, kind, c, float(s), list(t), False) for kind, table in (("ip", LISTED_IPS), ("domain", DOMAINS)) for v, c, s, t in table]
    rows += [(f"192.0.2.{i}", "ip", "test_suspicious" if i % 2 else "test_scanner", 55.0 + i % 30, [], False) for i in range(3, 45)]
    rows += [(f"198.51.100.{i}", "ip", "test_c2", 60.0 + i % 25, [], False) for i in range(36)]
    return spark.createDataFrame(rows, INDICATOR)


def dimension(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def upsert_indicators(base: DataFrame, added: DataFrame) -> DataFrame:
    """``base`` with ``added`` rows in place of those of the same indicator and type."""
    both = base.withColumn("__rank", F.lit(1)).unionByName(added.withColumn("__rank", F.lit(0)))
    newest = Window.partitionBy("indicator", "indicator_type").orderBy("__rank", F.desc("score"), "category")
    return both.withColumn("__nth", F.row_number().over(newest)).filter("__nth = 1").drop("__rank", "__nth")


def ip_reputation(df: DataFrame, indicators: DataFrame, column: str = "ip_address") -> DataFrame:
    """``df`` with ``ti_score``, ``ti_category`` and ``ti_techniques`` of its trimmed address; null where unknown."""
    known = indicators.filter("indicator_type = 'ip'").select(F.col("indicator").alias("__ip"), F.col("score").alias("ti_score"), F.col("category").alias("ti_category"), F.col("techniques").alias("ti_techniques"))
    return df.join(dimension(known), F.trim(F.col(column)) == F.col("__ip"), "left").drop("__ip")


def suffixes(domain: Column) -> Column:
    """A domain and all that remains of it label by label: a.b.c, b.c, c."""
    labels = F.split(F.lower(F.trim(domain)), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def domain_reputation(df: DataFrame, indicators: DataFrame, column: str, key: str = "id") -> DataFrame:
    """``key, domain, indicator, score, category`` of the longest known suffix of ``column``: an equality join on suffixes."""
    known = indicators.filter("indicator_type = 'domain'").select("indicator", "score", "category", "techniques")
    tried = df.filter(F.col(column) != "").select(key, F.col(column).alias("domain"), F.explode(suffixes(F.col(column))).alias("indicator"))
    longest = Window.partitionBy(key, "domain").orderBy(F.desc(F.length("indicator")), "indicator")
    hits = tried.join(dimension(known), "indicator").withColumn("__nth", F.row_number().over(longest)).filter("__nth = 1")
    return hits.select(key, "domain", "indicator", "score", "category", "techniques").distinct()


def iocs_of(text: Column) -> Column:
    """Array of (value, kind): the distinct addresses and lower-cased domains found in a text; null for a null text."""
    ips = F.transform(F.regexp_extract_all(text, F.lit(IP), F.lit(0)), lambda v: F.struct(v.alias("value"), F.lit("ip").alias("kind")))
    domains = F.transform(F.regexp_extract_all(text, F.lit(DOMAIN), F.lit(0)), lambda v: F.struct(F.lower(v).alias("value"), F.lit("domain").alias("kind")))
    return F.array_distinct(F.concat(ips, domains))


def extract_iocs(df: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """``key, value, kind``: the distinct addresses and lower-cased domains found in a text."""
    return df.select(key, text.alias("__t")).select(key, F.inline(iocs_of(F.col("__t"))))


def ioc_matches(df: DataFrame, text: Column, indicators: DataFrame, key: str = "id") -> DataFrame:
    """``key, value, kind, indicator, score, category, techniques`` of all extracted values that are known."""
    found = extract_iocs(df, text, key)
    known = dimension(indicators.filter("indicator_type = 'ip'").select(F.col("indicator").alias("value"), "indicator", "score", "category", "techniques"))
    ips = found.filter("kind = 'ip'").join(known, "value").select(key, "value", "kind", "indicator", "score", "category", "techniques")
    names = domain_reputation(found.filter("kind = 'domain'"), indicators, "value", key).withColumnRenamed("domain", "value")
    return ips.unionByName(names.select(key, "value", F.lit("domain").alias("kind"), "indicator", "score", "category", "techniques"))


def signature_hits(text: Column, signatures: Sequence[tuple] = SIGNATURES) -> Column:
    """Array of (signature, technique, severity, score) of all patterns found, in their order."""
    made = [F.when(text.rlike("(?ius)" + p), F.struct(F.lit(n).alias("signature"), F.lit(t).alias("technique"), F.lit(s).alias("severity"), F.lit(SIGNATURE_SCORE[s]).alias("score"))) for n, p, t, s in signatures]
    return F.filter(F.array(*made), lambda h: h.isNotNull())


def _begun(lengths: list[int], held):
    """Each text's windows of so many characters that a bitmap of values' beginnings lets through, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = held.value
        bits = 64 * len(bitmap)
        for batch in batches:
            at, windows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for n in lengths:
                    own = list({t[a : a + n] for a in range(len(t) - n + 1)})
                    places = np.fromiter((zlib.crc32(w.encode()) for w in own), np.int64, len(own)) % bits
                    windows += [own[j] for j in np.flatnonzero(bitmap[places >> 6] >> (places & 63) & 1).tolist()]
                    at += [i] * (len(windows) - len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(windows, pa.string())], ["__text", "__begin"])

    return run


def _joined_matches(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``key, value`` of ``rows(key, __t)`` and ``wanted(__v, value)`` of any number, by joins.

    A value is looked up by as many of its first characters as a power of two allows. Distinct texts give their windows of
    those lengths (no more than the logarithm of the longest value); what a bitmap of at most BITMAP_BITS lets through is
    joined with the values' beginnings, and the pairs that are left are compared in whole.
    """
    wanted = stage(wanted.withColumn("__begin", F.expr("left(__v, shiftleft(1, length(bin(length(__v))) - 1))")), "begins")
    begins = wanted.select("__begin").distinct()
    lengths = sorted(r[0] for r in begins.select(F.length("__begin")).distinct().collect())
    bits = min(BITMAP_BITS, 1 << max(10, (8 * wanted.count()).bit_length()))
    place = begins.select(F.pmod(F.crc32("__begin"), F.lit(bits)).alias("at"))
    words = place.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(bitmap)
    texts = stage(rows.select("__t").distinct().select(F.monotonically_increasing_id().alias("__text"), "__t"), "texts")
    found = texts.select("__text", "__t").mapInArrow(_begun(lengths, held), "__text long, __begin string").join(wanted, "__begin")
    hits = found.select("__text", "__v", "value").join(texts, "__text").filter(F.contains("__t", "__v")).select("__t", "value")
    return rows.join(hits, "__t").select(key, "value")


_AUTOMATA: dict[str, object] = {}


def _automaton(token: str, part):
    """The automaton of a broadcast part, built once in a worker and kept until another part's turn."""
    if token not in _AUTOMATA:
        import ahocorasick

        made = ahocorasick.Automaton()
        for low, values in part.value:
            made.add_word(low, (low, values))
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[token] = made
    return _AUTOMATA[token]


def substring_matches(df: DataFrame, text: str, values: DataFrame, key: str = "id", listed: int = SHORT_LIST, part_chars: int = PART_CHARS) -> DataFrame:
    """``key, value``: custom ``value``s contained in ``text``, without regard to case; each pair once.

    Up to ``listed`` values are tried one after another in a projection. More, of about ``part_chars`` characters in all,
    are an Aho-Corasick automaton in every task: one pass over a text finds them, however many begin alike, and no text is
    shuffled. More yet are joined (:func:`_joined_matches`). Null and empty texts and values match nothing.
    """
    rows = df.filter(F.length(text) > 0).select(key, F.lower(text).alias("__t"))
    wanted = values.select(F.lower("value").alias("__v"), "value").filter("length(__v) > 0").distinct()
    few = wanted.limit(listed + 1).collect()
    if len(few) <= listed:
        table = F.array(*(F.struct(F.lit(r["__v"]).alias("v"), F.lit(r["value"]).alias("value")) for r in few)) if few else F.array().cast("array<struct<v:string,value:string>>")
        return rows.select(key, F.explode(F.filter(table, lambda x: F.contains("__t", x["v"]))["value"]).alias("value")).distinct()
    wanted = stage(wanted, "values")
    if wanted.agg(F.sum(F.length("__v"))).first()[0] > part_chars:
        return _joined_matches(rows, wanted, key).distinct()
    held: dict[str, list[str]] = {}
    for r in wanted.collect():
        held.setdefault(r["__v"], []).append(r["value"])
    token, part = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(sorted(held.items()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(token, part)
        for batch in batches:
            at, hits = [], []
            for i, t in enumerate(batch.column(1)):
                for _, own in {low: own for _, (low, own) in automaton.iter(t.as_py())}.items():
                    at += [i] * len(own)
                    hits += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], [key, "value"])

    return rows.mapInArrow(search, f"`{key}` {dict(df.dtypes)[key]}, value string").distinct()


def bump_severity(severity: Column, score: Column) -> Column:
    """Severity after intelligence: critical from a score of 90 on, high from 70 on unless it is critical already."""
    return F.when(score >= 90, "critical").when((score >= 70) & ~severity.isin("critical"), "high").otherwise(severity)


def enrich(df: DataFrame, text: Column, indicators: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with ``ioc_count``, ``ti_score``, ``ti_categories``, ``ti_techniques`` and the bumped ``severity``."""
    hits = ioc_matches(df, text, indicators, key)
    own = hits.groupBy(key).agg(F.count("*").alias("ioc_count"), F.max("score").alias("ti_score"), F.array_sort(F.collect_set("category")).alias("ti_categories"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("techniques")))).alias("ti_techniques"))
    out = df.join(own, key, "left").withColumn("ioc_count", F.coalesce("ioc_count", F.lit(0)))
    return out.withColumn("severity", F.when(F.col("ti_score").isNull(), F.col("severity")).otherwise(bump_severity(F.col("severity"), F.col("ti_score"))))


def techniques(spark: SparkSession) -> DataFrame:
    """``technique, name, tactic``: the fixed table of techniques."""
    return spark.createDataFrame(TECHNIQUES, "technique string, name string, tactic string")

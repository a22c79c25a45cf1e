"""Incident memory: text similarity, embeddings, clusters; and analysis of batches of text."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.lookback import with_rank
from emberlog.functions.storage import stage
from emberlog.operators.correlation import entity_groups
from emberlog.operators.intel import dimension, iocs_of

# Classifier rules (pattern, category, severity), first that fits.
CATEGORIES = (
    (r"brute.?force|password.?spray|auth.?fail", "brute_force", 6), (r"sql.?inject|' OR |UNION SELECT", "sql_injection", 7),
    (r"cmd.?inject|;\s*ls|;\s*cat|;\s*whoami", "command_injection", 8), (r"exfiltrat|data.?theft|upload.*sensitive", "data_exfiltration", 9),
    (r"lateral.?move|pass.?the.?hash|wmi|psexec", "lateral_movement", 8), (r"escalat|sudo|setuid|privilege", "privilege_escalation", 7),
    (r"ransom|encrypt.*files|\.locked|\.crypt", "ransomware", 10), (r"malware|trojan|backdoor|rootkit", "malware_execution", 8),
    (r"phish|spear.?phish|credential.?harvest", "phishing", 6), (r"port.?scan|nmap|masscan|recon", "recon_scanning", 4),
    (r"beacon|c2|command.?control|call.?home", "c2_communication", 8), (r"dns.?tunnel|iodine|dnscat", "dns_tunnelling", 7),
    (r"web.?shell|webshell|cmd\.php|shell\.aspx", "web_shell", 9), (r"mimikatz|lsass|credential.?dump|hashdump", "credential_dumping", 9),
    (r"persist|startup|crontab|registry.*run", "persistence_mechanism", 6),
)
# Categories with tactic and technique.
CATEGORY_TECHNIQUES = (
    ("brute_force", "Credential Access", "T1110"), ("credential_stuffing", "Credential Access", "T1110"), ("sql_injection", "Initial Access", "T1190"),
    ("command_injection", "Execution", "T1059"), ("xss", "Initial Access", "T1190"), ("path_traversal", "Discovery", "T1083"),
    ("data_exfiltration", "Exfiltration", "T1041"), ("lateral_movement", "Lateral Movement", "T1021"), ("privilege_escalation", "Privilege Escalation", "T1068"),
    ("ransomware", "Impact", "T1486"), ("malware_execution", "Execution", "T1204"), ("phishing", "Initial Access", "T1566"),
    ("recon_scanning", "Reconnaissance", "T1595"), ("c2_communication", "Command and Control", "T1071"), ("insider_threat", "Collection", "T1530"),
    ("supply_chain_attack", "Initial Access", "T1195"), ("denial_of_service", "Impact", "T1498"), ("dns_tunnelling", "Exfiltration", "T1048"),
    ("web_shell", "Persistence", "T1505"), ("persistence_mechanism", "Persistence", "T1053"), ("credential_dumping", "Credential Access", "T1003"), ("unknown", "Unknown", "T0000"),
)
# What is looked for in texts.
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
USER = r"(?i)(?:user|username|account)[=:\s]+([A-Za-z0-9_@.\-]+)"
PROCESS = r"(?i)(?:process|cmd|command|exec)[=:\s]+([A-Za-z0-9_.\-/\\]+)"
FAILURE = r"(?i)\b(fail(?:ed|ure)?|denied|invalid|unauthorized|error|exception)\b"
PRIVILEGE = r"(?i)\b(root|admin(?:istrat(?:or|ive))?|sudo|su\b|privilege|elevated)\b"
STAMP = r"\b(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:?\d{2})?\b"
#: Weights of one block of queries, and vectors of one, that the driver and each worker hold.
BLOCK_TERMS, BLOCK_VECTORS = 1_000_000, 4096
#: Cells of texts and queries, and products of weights, that a task holds at once.
CELLS = 4_000_000


#: Texts are cut into terms so many bytes at a time; a longer one is taken alone.
TEXT_BYTES = 4 << 20
#: Terms, those in most texts, whose number of texts the driver and each worker hold.
VOCABULARY = 1_000_000
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def _counted(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Distinct terms of texts in small letters, without nulls: where each text's end, the terms, and how often each is there."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data if data is not None else b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = _IN_TERM[raw]
    at = np.flatnonzero(inside)
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1] + 1
    first = np.searchsorted(at, bounds[:-1])
    fresh[first[first < len(at)]] = True  # a term doesn't reach into the next text
    begins = np.flatnonzero(fresh)
    places = np.append(begins, len(at)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(raw[inside])).dictionary_encode()
    owner = np.searchsorted(bounds, at[begins], "right") - 1
    each = max(1, len(words.dictionary))
    pairs, counts = np.unique(owner * each + words.indices.to_numpy(), return_counts=True)
    return np.searchsorted(pairs // each, np.arange(len(texts)), "right"), words.dictionary.take(pa.array(pairs % each)), counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        begin = 0
        while begin < len(texts):
            last = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + TEXT_BYTES, "right")))
            ends, terms, counts = _counted(texts.slice(begin, last - begin))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(counts))]
            yield pa.RecordBatch.from_arrays([keys.slice(begin, last - begin), *lists], ["key", "terms", "counts"])
            begin = last


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, terms, counts``: the distinct terms (runs of ASCII letters and digits, lower-cased) of each key's texts.

    Texts are counted in the tasks that read them. Rows that have a key in common count as one text; null keys and texts
    without terms are left out.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    counted = stage(rows.mapInArrow(_count, f"key {dict(df.dtypes)[key]}, terms array<string>, counts array<bigint>").filter("size(terms) > 0"), "terms")
    repeated = stage(counted.groupBy("key").count().filter("count > 1").select("key"), "repeated")
    if repeated.isEmpty():
        return counted
    repeated = dimension(repeated)
    each = counted.join(repeated, "key", "left_semi").select("key", F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("key", F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))
    merged = each.groupBy("key").agg(F.collect_list(F.struct("term", "n")).alias("t")).select("key", F.col("t.term").alias("terms"), F.col("t.n").alias("counts"))
    return stage(counted.join(repeated, "key", "left_anti").unionByName(merged), "terms")


class _Best:
    """The ``k`` highest scores of each query so far, the least key of equal ones first."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)

    def extend(self, at: np.ndarray, scores: np.ndarray, keys: list) -> None:
        """Add scores of queries ``at``, which rise."""
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        negated = (-scores).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                q = int(at[a])
                self.held[q] = heapq.nsmallest(self.k, [*self.held[q], *zip(negated[a:b], keys[a:b])])
                if len(self.held[q]) == self.k:
                    self.least[q] = -self.held[q][-1][0]


def _blocks(queries: DataFrame, rows: int, most: int) -> Iterator[list]:
    """The rows of ``queries`` in blocks of about ``most`` by a hash of ``query``, all of one query in one block."""
    n = -(-rows // most)
    for i in range(n):
        yield queries.filter(F.pmod(F.xxhash64("query"), F.lit(n)) == i).collect()


def _idf(texts: int, holding: Column | np.ndarray, log=F.log) -> Column | np.ndarray:
    return log((texts + 1) / (holding + 1)) + 1


def _known(held: DataFrame, most: int) -> tuple[int, pa.Table]:
    """Terms of ``held(term, df)`` that are in the most texts, ``most`` of them at most, and the ``df`` from which all are there."""
    tiers = held.agg(*[F.count_if(F.col("df") >= 2**i) for i in range(1, 63)]).first()
    least = 2 ** next(i for i, n in enumerate(tiers, 1) if n <= most)
    return least, held.filter(F.col("df") >= least).select("term", "df").toArrow().combine_chunks()


def _column(table: pa.Table, i: int) -> pa.Array:
    """A column of a table as one array, of no values where the table has no rows."""
    column = table.column(i)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _shares(counts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of counts: the list of each count, and its share of its list."""
    sizes, n = pc.list_value_length(counts).to_numpy(), counts.flatten().to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, n / np.bincount(owner, n, len(sizes))[owner]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts and their terms in slices of at most ``CELLS`` terms, or one text."""
    for batch in batches:
        sizes = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64))
        begin = 0
        while begin < len(sizes):
            last = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + CELLS, "right")))
            yield batch.slice(begin, last - begin)
            begin = last


def _places(terms: pa.DictionaryArray, among: pa.Array) -> np.ndarray:
    """Place of each term in ``among``, -1 where it isn't there; each distinct one is looked for once."""
    return pc.fill_null(pc.index_in(terms.dictionary, value_set=among), -1).to_numpy()[terms.indices.to_numpy()]


def _rest(bags: DataFrame, held: DataFrame, texts: int, known) -> DataFrame:
    """``bags`` with ``rest``: the sum of squared weights of those terms of a text that aren't among ``known``."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            terms, (owner, tf) = batch.column(1).flatten(), _shares(batch.column(2))
            own = np.flatnonzero(_places(terms.dictionary_encode(), known.value[0]) < 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[own])), terms.take(pa.array(own)), pa.array(tf[own])], ["key", "term", "tf"])

    weight = F.col("tf") * _idf(texts, F.col("df"))
    rows = bags.select("key", "terms", "counts").mapInArrow(rare, f"key {dict(bags.dtypes)['key']}, term string, tf double")
    sums = rows.join(held, "term").groupBy("key").agg(F.sum(weight * weight).alias("rest"))
    return stage(bags.join(sums, "key", "left").select("key", "terms", "counts", F.coalesce("rest", F.lit(0.0)).alias("rest")), "terms")


def similar_texts(corpus: DataFrame, queries: DataFrame, key: str, text: str, k: int = 5, block_terms: int = BLOCK_TERMS, vocabulary: int = VOCABULARY) -> DataFrame:
    """``query, key, similarity``: the ``k`` texts of ``corpus`` most like each of ``queries(query, text)`` by cosine.

    A weight is tf * idf; tf is the share of the text's terms, idf is ln((N+1)/(df+1)) + 1 over all of ``corpus``. Terms
    that the corpus lacks have an idf of 1; texts with no term in common aren't listed; of equal similarities the
    least ``key`` comes first. Texts are weighed where they are read: tasks hold the ``vocabulary`` terms that are in most
    texts, a term that isn't among them is in one text, or else the squares of such terms are summed by a shuffle of
    those alone. Texts meet a block of queries in one pass, and each task keeps ``k`` a query: no pairs are made.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    context, count = corpus.sparkSession.sparkContext, corpus.count()
    bags = term_counts(corpus, key, text)
    held = stage(bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "held")
    asked = term_counts(queries, "query", "text").select(F.col("key").alias("query"), F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    asked = asked.select("query", F.col("t.terms").alias("term"), F.col("t.counts").alias("n")).join(held, "term", "left").withColumn("idf", F.coalesce(_idf(count, F.col("df")), F.lit(1.0)))
    of_query = Window.partitionBy("query")
    asked = asked.withColumn("q", F.col("n") / F.sum("n").over(of_query) * F.col("idf"))
    asked = stage(asked.select("query", "term", "idf", (F.col("q") / F.sqrt(F.sum(F.col("q") * F.col("q")).over(of_query))).alias("q")), "queries")
    least, often = _known(held, vocabulary)
    known = context.broadcast((_column(often, 0), _idf(count, _column(often, 1).to_numpy(), np.log)))
    bags = bags.withColumn("rest", F.lit(0.0)) if least == 2 else _rest(bags, held, count, known)
    other = _idf(count, 1, np.log) if least == 2 else 0.0
    kind, found = dict(corpus.dtypes)[key], []
    shape = corpus.sparkSession.createDataFrame([], f"query {dict(queries.dtypes)['query']}, key {kind}, similarity double").schema
    for rows in _blocks(asked, asked.count(), block_terms):
        if not rows:
            continue
        names, idf = sorted({r["query"] for r in rows}), {r["term"]: r["idf"] for r in rows}
        at, terms = {q: i for i, q in enumerate(names)}, sorted(idf)
        place = {t: i for i, t in enumerate(terms)}
        entries = sorted((place[r["term"]], at[r["query"]], r["q"]) for r in rows)
        begins = np.searchsorted([e[0] for e in entries], np.arange(len(terms) + 1))
        block = context.broadcast((names, pa.array(terms), np.array([idf[t] for t in terms]), begins, np.array([e[1] for e in entries]), np.array([e[2] for e in entries])))

        def score(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            (often, idfs), (names, terms, asked, begins, owners, weights) = known.value, block.value
            idfs, best = np.append(idfs, other), _Best(len(names), k)
            for batch in _slices(batches):
                keys, words, (text, tf) = batch.column(0), batch.column(1).flatten().dictionary_encode(), _shares(batch.column(2))
                w = tf * idfs[_places(words, often)]
                norms = np.sqrt(np.bincount(text, w * w, len(keys)) + batch.column(3).to_numpy())
                codes = _places(words, terms)
                of = np.flatnonzero(codes >= 0)
                codes, text = codes[of], text[of]
                ws, ends = tf[of] * asked[codes], np.searchsorted(text, np.arange(len(keys)), "right")
                counts = begins[codes + 1] - begins[codes]
                products = np.concatenate([[0], np.cumsum(counts)])
                first = 0
                while first < len(keys):
                    # Texts from ``first`` to ``last``: so many that their products and cells stay bounded, one at least.
                    low = ends[first - 1] if first else 0
                    last = int(np.searchsorted(products[ends], products[low] + CELLS, "right"))
                    last = min(max(last, first + 1), first + max(1, CELLS // len(names)))
                    own = np.arange(low, ends[last - 1])
                    n = counts[own]
                    entry = np.arange(n.sum()) + np.repeat(begins[codes[own]] - (np.cumsum(n) - n), n)
                    cells = np.repeat(text[own] - first, n) + owners[entry] * (last - first)
                    dots = np.bincount(cells, np.repeat(ws[own], n) * weights[entry], (last - first) * len(names)).reshape(len(names), -1)
                    scores = np.round(dots / norms[first:last], 6)
                    q, i = np.nonzero((dots > 0) & (scores >= best.least[:, None]))
                    best.extend(q, scores[q, i], keys.take(pa.array(first + i)).to_pylist())
                    first = last
            out = [(names[q], key, -s) for q, own in enumerate(best.held) for s, key in own]
            yield pa.RecordBatch.from_pylist([dict(zip(("query", "key", "similarity"), r)) for r in out], to_arrow_schema(shape))

        found.append(stage(bags.select("key", "terms", "counts", "rest").mapInArrow(score, shape), "similar"))
    if not found:
        return corpus.sparkSession.createDataFrame([], shape).withColumnRenamed("key", key)
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    merged = _merged(found).withColumn("__nth", F.row_number().over(best)).filter(F.col("__nth") <= k)
    return merged.select("query", F.col("key").alias(key), "similarity")


def _merged(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def hashed_embedding(df: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """``key, bucket, value``: each term adds 1 to sixteen buckets, one per pair of bytes of its SHA-256; L2-normalised."""
    terms = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    rows = df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(F.sha2("term", 256), i * 4 + 1, F.lit(4)), 16, 10).cast("int") % size)
    counts = rows.select(key, "c", F.explode(pairs).alias("bucket")).groupBy(key, "bucket").agg(F.sum("c").alias("n"))
    return counts.select(key, "bucket", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))).alias("value"))


def nearest(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = BLOCK_VECTORS) -> DataFrame:
    """``query, key, distance, similarity``: exact nearest vectors; similarity is max(0, 1 - d / 2) of the squared distance.

    ``queries(query, vector)`` are a stated set, taken in blocks of about ``block`` that every row of the corpus meets in
    products of matrices; each task keeps its best ``k`` a query. Distances are worked out anew for those.
    """
    kind, found = dict(corpus.dtypes)[key], []
    queries = queries.select("query", F.col("vector").cast("array<double>").alias("vector"))
    for rows in _blocks(queries, queries.count(), block):
        held = corpus.sparkSession.sparkContext.broadcast(([r["query"] for r in rows], np.array([r["vector"] for r in rows])))

        def near(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, asked = held.value
            lengths = (asked * asked).sum(axis=1)
            best = _Best(len(names), k)
            for batch in batches:
                for begin in range(0, batch.num_rows, 1024):
                    part = batch.slice(begin, 1024)
                    own = np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, -1)
                    keys = part.column(0).to_pylist()
                    squares = (own * own).sum(axis=1)
                    rough = lengths[:, None] - 2 * asked @ own.T + squares
                    # What may be among the k nearest but for rounding, ties too, is worked out exactly.
                    slack = 8 * (own.shape[1] + 4) * np.finfo(float).eps * (lengths[:, None] + squares.max(initial=0))
                    most = min(k, rough.shape[1])
                    limit = np.minimum(np.partition(rough, most - 1, axis=1)[:, most - 1], -best.least)
                    at, chosen = np.nonzero(rough <= limit[:, None] + 2 * slack)
                    best.extend(at, -((own[chosen] - asked[at]) ** 2).sum(axis=1), [keys[i] for i in chosen.tolist()])
            out = [(names[q], key, d) for q, own in enumerate(best.held) for d, key in own]
            yield pa.RecordBatch.from_pylist([dict(zip(("query", "key", "distance"), r)) for r in out], schema)

        from pyspark.sql.pandas.types import to_arrow_schema

        shape = corpus.sparkSession.createDataFrame([], f"query {dict(queries.dtypes)['query']}, key {kind}, distance double").schema
        schema = to_arrow_schema(shape)
        found.append(stage(corpus.select(key, F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL").mapInArrow(near, shape), "nearest"))
    if not found:
        return corpus.select(F.lit(0).cast("long").alias("query"), key, F.lit(0.0).alias("distance"), F.lit(0.0).alias("similarity")).limit(0)
    best = Window.partitionBy("query").orderBy("distance", "key")
    out = _merged(found).withColumn("__nth", F.row_number().over(best)).filter(F.col("__nth") <= k)
    return out.select("query", F.col("key").alias(key), "distance", F.greatest(F.lit(0.0), 1 - F.col("distance") / 2).alias("similarity"))


def cluster(df: DataFrame, vector: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``cluster`` by k-means, ``k`` clamped to 2..10."""
    made = df.withColumn("__f", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=max(2, min(10, k)), seed=seed, featuresCol="__f", predictionCol="cluster").fit(made)
    return model.transform(made).drop("__f")


def dominant(df: DataFrame, group: str, column: str) -> DataFrame:
    """``group, column``: the most frequent value, the least of equals."""
    counts = df.groupBy(group, column).agg(F.count("*").alias("__n"))
    best = Window.partitionBy(group).orderBy(F.desc("__n"), column)
    return counts.withColumn("__k", F.row_number().over(best)).filter("__k = 1").select(group, column)


def cluster_profile(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """``group, n`` and the dominant value of each of ``columns``."""
    out = df.groupBy(group).agg(F.count("*").alias("n"))
    for c in columns:
        out = out.join(dominant(df, group, c), group)
    return out


def retain_newest(df: DataFrame, time: str, tie: str, n: int = 10_000) -> DataFrame:
    """The newest ``n`` rows, of equal times those with the least ``tie``: the size of the memory."""
    return df.orderBy(F.desc(time), tie).limit(n)


def batch_entities(df: DataFrame, batch: str, text: str) -> DataFrame:
    """Per batch: distinct addresses, users and processes, failure, privilege and multi-source flags, severity."""
    found = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    rows = df.select(batch, text)
    kinds = (("ips", IP, 0), ("users", USER, 1), ("processes", PROCESS, 1))
    values = None
    for name, pattern, group in kinds:
        part = rows.select(batch, F.lit(name).alias("kind"), F.explode(found(pattern, group)).alias("value")).distinct()
        values = part if values is None else values.unionAll(part)
    counts = values.groupBy(batch).pivot("kind", [k for k, _, _ in kinds]).agg(F.count("value"))
    flags = rows.groupBy(batch).agg(F.bool_or(F.col(text).rlike(FAILURE)).alias("failure"), F.bool_or(F.col(text).rlike(PRIVILEGE)).alias("privileged"))
    out = flags.join(counts, batch, "left").select(batch, *(F.coalesce(k, F.lit(0)).alias(f"n_{k}") for k, _, _ in kinds), "failure", "privileged")
    out = out.withColumn("multi_source", F.col("n_ips") > 5)
    return out.withColumn("severity", F.when(F.col("failure") | F.col("privileged") | F.col("multi_source"), "high").otherwise("low"))


def classify(text: Column) -> Column:
    """(category, severity) of the first rule whose pattern is found; unknown, 3 without."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("category"), F.lit(0).alias("severity")))
    for pattern, category, severity in CATEGORIES:
        out = out.when(text.rlike("(?i)" + pattern), F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")))
    return out.otherwise(F.struct(F.lit("unknown").alias("category"), F.lit(3).alias("severity")))


def category_techniques(spark) -> DataFrame:
    """``category, tactic, technique``: the fixed table of categories."""
    return spark.createDataFrame(CATEGORY_TECHNIQUES, "category string, tactic string, technique string")


def written_time(text: Column) -> Column:
    """The first time written in a text, with its fraction and offset (none: UTC); null without one."""
    part = lambda i: F.regexp_extract(F.coalesce(text, F.lit("")), STAMP, i)
    fraction = F.rpad(F.substring(part(3), 1, 6), 6, "0")
    offset = F.coalesce(F.nullif(F.regexp_replace(part(4), r"^([+-]\d{2})(\d{2})$", "$1:$2"), F.lit("")), F.lit("Z"))
    return F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), F.lit("."), fraction, offset), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))


def incident_timeline(df: DataFrame, incident: str, text: str) -> DataFrame:
    """``incident, at, nth``: the first time written in each text, in order of time and text. No incident is one task's."""
    rows = df.select(incident, written_time(F.col(text)).alias("at"), text).filter("at IS NOT NULL")
    return with_rank(rows, "nth", [incident], ["at", text]).select(incident, "at", "nth")


def dwell_hours(timeline: DataFrame, incident: str) -> DataFrame:
    """``incident, dwell_hours``: from the first time of an incident to its last."""
    return timeline.groupBy(incident).agg(F.round((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 3.6e9, 3).alias("dwell_hours"))


def merged_report(df: DataFrame, incident: str, text: str, key: str = "id") -> DataFrame:
    """One row per incident of ``df(key, incident, text, ip_address, user_id, host)``: what the analyses find together.

    ``category`` and ``severity`` are those of the most severe text (the least category of equals); ``techniques`` the
    distinct ones of all categories but the unknown, sorted; ``n_indicators`` the distinct addresses and domains written
    in the texts; ``blast_hosts`` and ``blast_users`` the distinct ones named; ``dwell_hours`` as :func:`dwell_hours`,
    null without a time; failures, privileges and users as :func:`batch_entities`. ``confidence`` is the mean of what
    there is: the share of texts with a known category, and the confidence of the entity groups (addresses and users of
    more than one event) that the incident's events are in.
    """
    # Texts are settled first and each is gone through once: below a generator no filter or use writes the patterns out again.
    t = F.col("__text")
    read = {"kind": classify(t), "at": written_time(t), "iocs": iocs_of(t), "users": F.regexp_extract_all(t, F.lit(USER), F.lit(1)), "failure": t.rlike(FAILURE), "privileged": t.rlike(PRIVILEGE)}
    own = list(dict.fromkeys((incident, "ip_address", "user_id", "host")))
    found = df.select(*own, F.col(text).alias("__text")).select(*own, F.inline(F.array(F.struct(*(c.alias(f"__{n}") for n, c in read.items())))))
    rows = stage(found.select(*own, F.col("__kind.category").alias("category"), F.col("__kind.severity").alias("points"), *(F.col(f"__{n}").alias(n) for n in read if n != "kind")), "report")
    worst = F.min(F.struct((-F.col("points")).alias("points"), "category"))
    base = rows.groupBy(incident).agg(worst["category"].alias("category"), F.max("points").alias("severity"), F.nullif(F.avg(F.when(F.col("category") == "unknown", 0.0).otherwise(1.0)), F.lit(0.0)).alias("known"))
    named = rows.select(incident, "category").distinct().join(F.broadcast(category_techniques(df.sparkSession)), "category").filter("category <> 'unknown'")
    techniques = named.groupBy(incident).agg(F.array_sort(F.collect_set("technique")).alias("techniques"))
    iocs = rows.select(incident, F.inline("iocs")).distinct().groupBy(incident).agg(F.count("*").alias("n_indicators"))
    ends = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("entity")) for k, c in (("ip", "ip_address"), ("user", "user_id"), ("host", "host"))))
    named = rows.select(incident, F.inline(ends)).filter("entity <> ''").distinct()
    blast = named.groupBy(incident).agg(F.count_if(F.col("kind") == "host").alias("blast_hosts"), F.count_if(F.col("kind") == "user").alias("blast_users"))
    grouped = named.join(entity_groups(rows).select("kind", "entity", "confidence"), ["kind", "entity"]).groupBy(incident).agg(F.avg("confidence").alias("grouped"))
    users = rows.select(incident, F.explode("users").alias("value")).distinct().groupBy(incident).agg(F.count("value").alias("n_users"))
    flags = rows.groupBy(incident).agg(F.bool_or("failure").alias("failure"), F.bool_or("privileged").alias("privileged")).join(users, incident, "left").select(incident, "n_users", "failure", "privileged")
    dwell = dwell_hours(rows.filter("at IS NOT NULL"), incident)
    out = base.join(flags, incident, "left")
    for part in (techniques, iocs, blast, grouped, dwell):
        out = out.join(part, incident, "left")
    scores = F.filter(F.array("known", "grouped"), lambda x: x.isNotNull())
    confidence = F.coalesce(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0)), F.lit(0.0))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_indicators", "blast_hosts", "blast_users", "n_users")}
    return out.withColumns(counts).withColumn("techniques", F.coalesce("techniques", F.array().cast("array<string>"))).withColumn("confidence", F.round(confidence, 3)).drop("known", "grouped")


def evaluate_detection(truth: DataFrame, detected: DataFrame, key: str = "id") -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` of two sets of ids."""
    t, d = truth.select(key).distinct().withColumn("__t", F.lit(True)), detected.select(key).distinct().withColumn("__d", F.lit(True))
    counts = t.join(d, key, "full").agg(F.count_if(F.col("__t") & F.col("__d")).alias("tp"), F.count_if(F.col("__t").isNull()).alias("fp"), F.count_if(F.col("__d").isNull()).alias("fn"))
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def throughput(df: DataFrame, latency: str, window: str, slide: str) -> DataFrame:
    """Per sliding window of event time: events a second, mean latency and its 95th percentile by nearest rank.

    Rows are counted once, in panes that windows are made of: their number, sum and counts by value. Windows add up panes. For
    the percentile, values are dealt by ranges; sums by pane and range say which range holds a window's rank, and only that
    one's values of the window's panes are looked into.
    """
    width, step = (pd.Timedelta(x).value // 1000 for x in (window, slide))
    pane = math.gcd(width, step)
    down = lambda x, by: ((x - F.pmod(x, F.lit(by))) / by).cast("long")
    rows = df.filter("ts IS NOT NULL").select(down(F.unix_micros("ts"), pane).alias("pane"), F.col(latency).alias("l"))
    first, last = down((F.col("pane") + 1) * pane - width + (step - 1), step), down(F.col("pane") * pane, step)
    in_windows = lambda panes: panes.withColumn("w", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    sums = in_windows(rows.groupBy("pane").agg(F.count("*").alias("n"), F.sum("l").alias("s"), F.count("l").alias("k")))
    totals = sums.groupBy("w").agg(F.sum("n").alias("n"), (F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("mean"))
    values = rows.filter("l IS NOT NULL").groupBy("pane", "l").agg(F.count("*").alias("c"))
    values = stage(values.repartitionByRange("l").withColumn("part", F.spark_partition_id()), "latencies")
    ranges = in_windows(values.groupBy("pane", "part").agg(F.sum("c").alias("c"))).groupBy("w", "part").agg(F.sum("c").alias("s"))
    up = Window.partitionBy("w").orderBy("part")
    ranges = ranges.withColumn("upto", F.sum("s").over(up)).withColumn("size", F.sum("s").over(Window.partitionBy("w")))
    rank = F.least(F.floor(F.col("size") * 0.95), F.col("size") - 1)
    held = ranges.select("w", "part", (F.col("upto") - F.col("s")).alias("base"), "upto", rank.alias("rank")).filter("base <= rank AND rank < upto")
    panes = F.sequence(F.col("w") * (step // pane), F.col("w") * (step // pane) + (width // pane - 1))
    inside = values.join(held.withColumn("pane", F.explode(panes)), ["pane", "part"]).groupBy("w", "l", "base", "rank").agg(F.sum("c").alias("c"))
    running = F.col("base") + F.sum("c").over(Window.partitionBy("w").orderBy("l"))
    p95 = inside.withColumn("running", running).filter("running > rank").groupBy("w").agg(F.min("l").alias("p95"))
    at = F.timestamp_micros(F.col("w") * step + width)
    return totals.join(p95, "w", "left").select(at.alias("at"), (F.col("n") / (width / 1e6)).alias("per_second"), "mean", "p95")


def source_health(logs: DataFrame, quarantine: DataFrame, source: str = "source", size: str = "message") -> DataFrame:
    """Per source: accepted, errors, error rate, bytes, last seen, over logs and quarantined rows."""
    ok = logs.select(source, F.lit(0).alias("e"), F.octet_length(size).alias("b"), "ts")
    bad = quarantine.select(source, F.lit(1).alias("e"), F.lit(0).alias("b"), F.col("ts"))
    out = ok.unionByName(bad).groupBy(source).agg(F.count_if(F.col("e") == 0).alias("accepted"), F.sum("e").alias("errors"), F.sum("b").alias("bytes"), F.max("ts").alias("last_seen"))
    return out.withColumn("error_rate", F.round(F.col("errors") / (F.col("accepted") + F.col("errors")), 6))

"""Secrets in texts: fixed patterns, and strings that a character Markov model finds random."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.samples import sample_texts

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 12
#: A run is taken whole, so asking for its least length in the pattern is the same as dropping shorter matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: What a candidate of the model is made of; all other characters end it.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A candidate is random if its log-likelihood ratio, in nats, is so high for the whole string and for each character.
LEAST_RATIO, LEAST_MEAN = 12.0, 0.5
#: Documents whose words, and digests of whose words, train the models.
SAMPLE_ROWS = 100
SEED = 5
#: Tasks that make and count the training strings.
TRAIN_PARTS = 12
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans of the matches for which ``keep(match's group)`` holds, in code points.

    Matches and the gaps between them alternate, so a running sum of their lengths gives their places.
    """
    gaps, found, kept = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPANS).alias("spans"))
    start = start.withField("spans", F.array().cast(_SPANS))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        spans = F.concat(state["spans"], span) if keep is None else F.when(keep(x["kept"]), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    rows = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("match"), kept.alias("kept")), lambda x: x["match"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(rows, start, step, lambda s: s["spans"])).otherwise(F.array().cast(_SPANS))


def _codes(string: Column) -> Column:
    return F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, random against ordinary, from ``samples(string, is_random)``.

    Two first-order Markov models, each smoothed with its own share of the second character; pairs are counted in Spark
    and the driver holds the alphabet's pairs only. Entry ``a * (len(ALPHABET) + 1) + b`` belongs to characters number ``a`` and ``b``,
    counted from 1; 0 stands for any other. Null strings and labels are left out.
    """
    k = len(ALPHABET) + 1
    codes = samples.filter("string IS NOT NULL AND is_random IS NOT NULL").select("is_random", _codes(F.col("string")).alias("c"))
    pairs = codes.select("is_random", F.explode(F.transform("c", lambda a, i: a * k + F.get("c", i + 1))).alias("pair")).filter("pair IS NOT NULL")
    counts = {(r.is_random, r.pair): r.n for r in pairs.groupBy("is_random", "pair").agg(F.count("*").alias("n")).collect()}

    def log_likelihood(label: bool) -> list[float]:
        n = [[counts.get((label, a * k + b), 0) for b in range(k)] for a in range(k)]
        share = [(sum(row[b] for row in n) + 1) / (sum(map(sum, n)) + k) for b in range(k)]
        return [math.log((n[a][b] + k * share[b]) / (sum(n[a]) + k)) for a in range(k) for b in range(k)]

    return [r - o for r, o in zip(log_likelihood(True), log_likelihood(False))]


def labelled_samples(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``string, is_random`` from at most ``sample_rows`` documents (:func:`sample_texts`).

    Ordinary strings are their words of letters, digits and joining marks, by themselves and joined as identifiers are;
    random ones are digests of the same words, written in hexadecimal, base 64 and base 64 without its marks.
    """
    texts = sample_texts(docs, sample_rows, SEED)
    # Without what the fixed patterns find: those words aren't ordinary.
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("w"))
    strings = F.array(F.col("w"), F.upper("w"), F.concat("w", F.initcap("w")), *(F.concat("w", F.lit(mark), "w") for mark in "_-/"))
    ordinary = F.transform(strings, lambda s: F.struct(s.alias("string"), F.lit(False).alias("is_random")))
    digests = F.flatten(F.transform(F.slice(strings, 1, 3), lambda s: F.array(F.sha2(s, 224), F.base64(F.unhex(F.sha2(s, 256))), F.regexp_replace(F.base64(F.unhex(F.sha2(s, 384))), "[+/=]", ""))))
    random = F.transform(digests, lambda s: F.struct(s.alias("string"), F.lit(True).alias("is_random")))
    # So few bytes would be put together in one task, however many strings are made of them.
    return words.distinct().repartition(TRAIN_PARTS).select(F.inline(F.concat(ordinary, random)))


def _is_random(string: Column, ratios: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    k = len(ALPHABET) + 1
    pairs = F.transform(F.array(_codes(string)), lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda a, i: F.get(table, a * k + F.get(c, i + 1))))[0]
    return F.transform(F.array(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)), lambda s: (s >= LEAST_RATIO) & (s >= LEAST_MEAN * (F.length(string) - 1)))[0]


def with_spans(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Each row as ``__row``, its text as ``__text``, and arrays of spans: ``__base`` of the fixed patterns, ``__all``."""
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    text = F.col("__text")
    df = df.select("*", _spans(text, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_CHARS, 1).alias("__assign"), _spans(text, ACCESS, 1).alias("__access"), _spans(text, HEX, 2).alias("__hex"))
    df = df.select("__row", "__text", "__assign", "__access", "__hex", F.sort_array(F.concat("__assign", "__access", "__hex")).alias("__base"))
    df = df.select("*", _spans(text, CANDIDATE, 3, lambda v: _is_random(v, ratios)).alias("__random"))
    apart = F.filter("__random", lambda m: ~F.exists("__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return df.select("__row", "__text", "__assign", "__access", "__hex", "__base", F.sort_array(F.concat("__base", apart)).alias("__all"))


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs(doc_id, text)``.

    The fixed patterns' matches stay as they are, leftmost and non-overlapping for each kind. The model adds, as kind
    ``markov``, runs of 20 or more characters of its alphabet that it finds random and that no base span overlaps.
    ``ratios`` come from :func:`train`, by default on :func:`labelled_samples` of ``docs``. Null and empty texts have no
    spans; rows that repeat have the same ones; nothing is shuffled. Native expressions throughout.
    """
    df = with_spans(docs, ratios or train(labelled_samples(docs)))
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return df.select(F.col("__row.doc_id").alias("doc_id"), *counts, F.sha2(_written("__base"), 256).alias("base_sha256"), _written("__all").alias("spans"))


def redact_secrets(docs: DataFrame, ratios: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; spans that overlap become one. All rows stay, with
    their other columns, whatever their names; null texts stay null and empty ones empty; rows that repeat are changed
    alike; no rows give none.
    """
    df = with_spans(docs, ratios or train(labelled_samples(docs)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], F.substring("__text", state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("__all", start, step, lambda s: F.concat(s["out"], F.substring("__text", s["at"] + 1, F.length("__text"))))
    text = F.when(F.size("__all") > 0, clean).otherwise(F.col("__row.text").cast("string"))
    return df.select(*(text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))

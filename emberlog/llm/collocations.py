"""Collocations of two to four words by partitioned frequent-phrase mining: local support, union, exact global counts.

Documents are dealt to shards. A shard that holds a share of a language's words is mined for all phrases that reach that
share of the support. A phrase that fails everywhere is short of the support as a whole, as the local limits less one
add up to less than it; so the union of what shards find holds every frequent phrase, and one more pass counts the union
exactly. A shard isn't a task: its texts are counted wherever they lie, and the counts of a phrase meet by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.storage import stage
from emberlog.llm.memory import give_back
from emberlog.llm.prefilter import bitmap_of, may_hold

#: Shards: local support is about the support divided by these; beyond that, more of them mine noise.
SHARDS = 6
LONGEST = 4
#: Texts are taken together up to so many bytes; a longer one is cut where a phrase can't go on.
BLOCK_BYTES = 3 << 20
# Bytes that end a piece, bytes between words, upper-case letters that are made small.
_KIND = np.zeros(256, np.uint8)
_KIND[[*b".,;:!?\n\v\f\r"]] = 2
_KIND[[*b" \t"]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _hashes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, mixed. No word is empty."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    raw, lengths = np.frombuffer(words.buffers()[2], np.uint8)[: bounds[-1]], np.diff(bounds)
    powers = np.ones(int(lengths.max(initial=1)), np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, _MIX[0]), out=powers[1:])
    terms = (raw.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(raw)) - np.repeat(bounds[:-1], lengths)]
    return _mixed(np.add.reduceat(terms, bounds[:-1])) if len(words) else np.zeros(0, np.uint64)


def _first_bytes(raw: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Where words begin: at bytes of words after others, or first in their text."""
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(raw)]] = False
    return np.flatnonzero(inside & ~before)


class Words:
    """The words of several texts: codes into ``words``, their document, and whether the next word follows in its piece."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, docs: np.ndarray):
        kind = _KIND[raw]
        inside = kind == 0
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        starts, ends = _first_bytes(raw, bounds, inside), np.flatnonzero(inside & ~after) + 1
        text = np.searchsorted(bounds, starts, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.follows = np.zeros(len(starts), bool)
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        self.doc = docs[text]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        data = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]]))
        encoded = data.dictionary_encode()
        self.words, self.codes = encoded.dictionary, encoded.indices.to_numpy()

    def keys(self, languages: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one word, two, ...: a 64-bit key of the phrase and its language from each word on, and where one is."""
        own = _hashes(self.words)[self.codes]
        key, there = _mixed(languages[self.doc] ^ own), np.ones(len(own), bool)
        for n in range(1, LONGEST + 1):
            yield key, there
            key, there = key.copy(), there.copy()
            key[: len(own) - n] = _mixed(key[: len(own) - n] * _MIX[0] + own[n:])
            there[len(own) - n :] = False
            there[: len(own) - n] &= self.follows[n - 1 : len(own) - 1]


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A string column without nulls in blocks of about BLOCK_BYTES: bytes, where texts or their parts begin and the last ends, their rows."""
    raw_offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    bounds, docs = [], []
    for i, (a, b) in enumerate(zip(raw_offsets[:-1].tolist(), raw_offsets[1:].tolist())):
        while b - a > BLOCK_BYTES:  # cut after the first end of a piece that comes after a block
            ends = np.flatnonzero(_KIND[data[a + BLOCK_BYTES : b]] == 2)
            if not len(ends):
                break
            cut = a + BLOCK_BYTES + int(ends[0]) + 1
            bounds.append((a, cut))
            docs.append(i)
            a = cut
        bounds.append((a, b))
        docs.append(i)
    at = 0
    while at < len(bounds):
        end = at + 1
        while end < len(bounds) and bounds[end][1] - bounds[at][0] <= BLOCK_BYTES:
            end += 1
        first, last = bounds[at][0], bounds[end - 1][1]
        if last > first:
            yield data[first:last], np.array([first, *(b for _, b in bounds[at:end])], np.int64) - first, np.array(docs[at:end])
        at = end


def _languages(langs: pa.Array) -> np.ndarray:
    distinct = langs.dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(x.encode(), 11) for x in distinct.dictionary.to_pylist()], np.uint64)[distinct.indices.to_numpy()]


def _salts(shards: int) -> np.ndarray:
    """What a key is xor-ed with in each shard, as signed values."""
    return _mixed(np.arange(1, shards + 1, dtype=np.uint64) * _MIX[0]).view(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for raw, bounds, docs in _blocks(batch.column(2)):
            starts = _first_bytes(raw, bounds, _KIND[raw] == 0)
            n += np.bincount(docs[np.searchsorted(bounds, starts, "right") - 1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["shard", "lang", "n"])
    give_back()


def _local(n: int, shards: int, frequent) -> Callable:
    """Counts, block by block, of phrases of ``n`` words whose first and last words but one may be frequent in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, languages = batch.column(0).to_numpy(), _languages(batch.column(1))
            salts = _salts(shards)[shard]
            for block in (Words(*x) for x in _blocks(batch.column(2))):
                last = None
                for m, (key, there) in enumerate(block.keys(languages), 1):
                    if m == n:
                        break
                    last = key, there
                at = np.flatnonzero(there)
                if frequent is not None and len(at):
                    key0, there0 = last
                    kept = there0.copy()
                    kept[there0] = may_hold(frequent.value, key0[there0].view(np.int64) ^ salts[block.doc[there0]])
                    at = at[kept[at] & kept[at + 1]]
                _, first, counts = np.unique(key[at].view(np.int64) ^ salts[block.doc[at]], return_index=True, return_counts=True)
                docs = block.doc[at[first]]
                columns = [pa.array(shard[docs]), batch.column(1).take(pa.array(docs)), pa.array(key[at[first]].view(np.int64)), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "lang", "key", "n"])
        give_back()

    return run


def _global(candidates) -> Callable:
    """Counts, block by block, of the phrases whose keys may be candidates, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = _languages(batch.column(1))
            for block in (Words(*x) for x in _blocks(batch.column(2))):
                for n, (key, there) in enumerate(block.keys(languages), 1):
                    at = np.flatnonzero(there)
                    at = at[may_hold(candidates.value, key[at].view(np.int64))]
                    if not len(at):
                        break  # a candidate's parts are candidates
                    _, first, inverse, counts = np.unique(key[at], return_index=True, return_inverse=True, return_counts=True)
                    codes = np.stack([block.codes[at + i] for i in range(n)])
                    if (codes != codes[:, first[inverse]]).any():  # a collision of keys: words decide
                        rows = np.vstack([languages[block.doc[at]].view(np.int64), codes.astype(np.int64)])
                        _, first, counts = np.unique(rows, axis=1, return_index=True, return_counts=True)
                    words = [block.words.take(pa.array(c)) for c in codes[:, first]]
                    phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")
                    columns = [batch.column(1).take(pa.array(block.doc[at[first]])), phrase, pa.array(np.full(len(first), n, np.int32)), pa.array(counts.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n"])
        give_back()

    return run


def frequent_phrases(docs: DataFrame, support: int = 30, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, a`` of all phrases of one to four words that occur ``support`` times or more in a language,
    and ``lang, total``, the words of each language.

    ``docs`` has ``lang`` and ``text``; null languages are ``und``, null texts empty; repeated rows count each; other
    columns are left out; no rows give none. Within a shard longer phrases are looked for only where both parts a word
    shorter may be frequent in that shard, so that a pass counts few phrases besides the frequent ones. Keys are 64-bit
    hashes and only choose what is counted: the last pass counts words, and every place of a phrase or none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A shard is pieces of the files read, so that a task sees few shards; rows that come from no file are one shard.
    shard = F.pmod(F.xxhash64(F.input_file_name(), F.input_file_block_start()), F.lit(shards)).cast("int")
    salts = F.array(*(F.lit(int(x)) for x in _salts(shards)))
    given = docs.select(shard.alias("shard"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    context = docs.sparkSession.sparkContext
    sized = stage(given.mapInArrow(_word_counts, "shard int, lang string, n long").groupBy("shard", "lang").agg(F.sum("n").alias("n")), "phrase-words")
    totals = sized.groupBy("lang").agg(F.sum("n").alias("total")).filter("total > 0")
    # The least whole number that is the shard's share of the support or more.
    least = F.expr(f"(CAST(n AS DECIMAL(20,0)) * {int(support)} + total - 1) DIV total")
    limits = sized.filter("n > 0").join(totals, "lang").select("shard", "lang", least.alias("least"))
    frequent, found = None, None
    for n in range(1, LONGEST + 1):
        rows = given.mapInArrow(_local(n, shards, frequent), "shard int, lang string, key long, n long")
        counted = rows.groupBy("shard", "lang", "key").agg(F.sum("n").alias("n"))
        own = F.col("key").bitwiseXOR(F.get(salts, F.col("shard"))).alias("own")
        local = stage(counted.join(limits, ["shard", "lang"]).filter("n >= least").select("key", own), f"phrases-{n}")
        frequent = context.broadcast(bitmap_of(local.select(F.col("own").alias("hash"))))
        found = local.select("key") if found is None else found.unionByName(local.select("key"))
    union = context.broadcast(bitmap_of(found.select(F.col("key").alias("hash"))))
    counts = given.mapInArrow(_global(union), "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a"))
    return stage(counts.filter(F.col("a") >= support), "phrases"), totals


def _words(phrase: str, a: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), a, n), " ")


def collocations(docs: DataFrame, support: int = 30, most: int = 2000, covered: int = 80) -> DataFrame:
    """The first ``most`` phrases of two to four words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its weakest cut, ``n`` all words of the language;
    ``score`` is 2 000 000 ``a`` / (``l`` + ``r``), rounded down, least over the cuts, of equal ones the first. A phrase
    goes if a longer frequent one that holds it has ``covered`` per cent of its count. Order: score and count, falling,
    then the phrase's bytes. See :func:`frequent_phrases` for nulls, repeats and empty tables.
    """
    frequent, totals = frequent_phrases(docs, support)
    candidates = frequent.filter("words > 1")
    part = frequent.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("a").alias("count"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", _words("phrase", F.lit(1), F.col("k"))).withColumn("right", _words("phrase", F.col("k") + 1, F.col("words")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.withColumnRenamed("count", name), (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).drop("of", "part")
    wide = lambda c: f"CAST({c} AS DECIMAL(20,0))"
    scored = cuts.withColumn("score", F.expr(f"({wide('a')} * CAST(2000000 AS DECIMAL(7,0))) DIV ({wide('l')} + {wide('r')})"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # A phrase within a longer one: its places, from the first word on.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, n), " "))))
    within = candidates.filter("words > 2").select(F.col("lang").alias("of"), F.explode(F.array_distinct(inner)).alias("part"), F.col("a").alias("longer"))
    within = within.groupBy("of", "part").agg(F.max("longer").alias("longer"))
    kept = best.join(within, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left")
    kept = kept.filter(F.expr(f"longer IS NULL OR {wide('longer')} * 100 < {wide('a')} * {int(covered)}"))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")

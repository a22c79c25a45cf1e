"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity of weighted shingles."""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.memory import give_back
from emberlog.llm.tokens import texts_of

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of 64 bits in blocks of 8; within RADIUS, one block at least differs in NEAR bits or fewer.
BLOCKS, NEAR = 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Characters of benchmark texts that a worker holds at once; a larger benchmark is taken in several such parts.
PART_CHARS = 4_000_000
_WORD = re.compile(r"\w+")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FILTER_BITS = 20


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def _shingles(words: list[str], k: int) -> np.ndarray:
    """A 64-bit value for each ``k`` words in a row; comparable within one Python process."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = own[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += own[j : n + j]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ out >> np.uint64(29)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(counts: np.ndarray, of: int) -> np.ndarray:
    return np.packbits(2 * counts > of, axis=1, bitorder="little").reshape(-1, 8)


_NEIGHBOURS = [0] + [sum(1 << b for b in c) for r in range(1, NEAR + 1) for c in combinations(range(8), r)]


class _Size:
    """The items of one number of words: fingerprints, and for each block and value the items near it there."""

    def __init__(self, k: int, n: int):
        self.k, self.m = k, n - k + 1
        self.items: list[tuple] = []  # id, words, bag of shingles

    def finish(self) -> None:
        sums = np.stack([_bits(_shingles(words, self.k)).sum(axis=0, dtype=np.int64) for _, words, _ in self.items])
        self.prints = _prints(sums, self.m)
        self.near: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
        for i, fp in enumerate(self.prints.tolist()):
            for block, value in enumerate(fp):
                for flip in _NEIGHBOURS:
                    self.near[block][value ^ flip].append(i)

    def candidates(self, fp: np.ndarray) -> list[int]:
        """Items whose fingerprints differ from ``fp`` in RADIUS bits or fewer: all of them."""
        found = np.array(sorted({i for block, value in enumerate(fp.tolist()) for i in self.near[block].get(value, ())}), np.int64)
        return found[np.bitwise_count(self.prints[found] ^ fp).sum(axis=1) <= RADIUS].tolist() if len(found) else []


def _bag(words: list[str], k: int) -> Counter:
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


class Index:
    """Benchmark items ``(item_id, text)`` in a worker's memory."""

    def __init__(self, items: list[tuple], shingle_words: int, similarity: float):
        self.similarity = similarity
        sizes: dict[int, _Size] = {}
        known: dict[int, list] = defaultdict(list)
        for key, text in items:
            words = words_of(text or "")
            if len(words) >= (k := shingle_words):
                size = sizes.setdefault(len(words), _Size(k, len(words)))
                size.items.append((key, words, _bag(words, k)))
                known[k].append(_shingles(words, k))
        self.by_k: dict[int, list[tuple[int, _Size]]] = defaultdict(list)
        for n, size in sorted(sizes.items()):
            size.finish()
            self.by_k[size.k].append((n, size))
        self.known = {k: np.unique(np.concatenate(x)) for k, x in known.items()}
        self.filter = {k: np.zeros(1 << _FILTER_BITS, bool) for k in known}
        for k, x in self.known.items():
            self.filter[k][x >> np.uint64(64 - _FILTER_BITS)] = True

    def matches(self, text: str) -> list[tuple]:
        """``(item_id, similarity, first word, words)`` of the best window for each item that the text holds.

        A window as similar as asked shares that part of its shingles with an item at least, so a window with fewer
        shingles known from the benchmark needs no fingerprint.
        """
        words = words_of(text)
        best: dict[tuple, tuple] = {}
        for k, sizes in self.by_k.items():
            hashes = _shingles(words, k)
            hit = self.filter[k][hashes >> np.uint64(64 - _FILTER_BITS)]
            if not hit.any():
                continue
            at = np.flatnonzero(hit)
            known = self.known[k]
            real = known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]
            hit[at[~real]] = False
            total = np.concatenate([[0], np.cumsum(hit)])
            for n, size in sizes:
                m = size.m
                if total[-1] < self.similarity * m:
                    continue
                if len(hashes) < m:  # a text shorter than the items is its own window
                    self._windows(words, hashes, len(words), size, np.array([0]), best)
                    continue
                starts = np.flatnonzero(total[m:] - total[:-m] >= self.similarity * m - 1e-9)
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 4096) + 1) if len(starts) else ():
                    for i in range(0, len(part), 4096):
                        self._windows(words, hashes, n, size, part[i : i + 4096], best)
        return [(key, s, -start, n) for (key, _), (s, start, n) in best.items()]

    def _windows(self, words, hashes, n, size, starts, best) -> None:
        own = n - size.k + 1
        low, high = int(starts[0]), int(starts[-1]) + own
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(hashes[low:high]), axis=0, dtype=np.int32)])
        prints = _prints(sums[starts - low + own] - sums[starts - low], own)
        for start, fp in zip(starts.tolist(), prints):
            bag = None
            for i in size.candidates(fp):
                key, item, wanted = size.items[i]
                bag = bag if bag is not None else _bag(words[start : start + n], size.k)
                shared = sum(min(c, wanted[s]) for s, c in bag.items() if s in wanted)
                similarity = shared / (own + size.m - shared)
                if similarity >= self.similarity:
                    mark = (key, id(item))
                    best[mark] = max(best.get(mark, (0, 0, 0)), (similarity, -start, n))


_HELD: dict[str, Index] = {}


def _index(token: str, items, shingle_words: int, similarity: float) -> Index:
    """The index of a broadcast part, built once in a worker."""
    if token not in _HELD:
        _HELD.clear()
        _HELD[token] = Index(items.value, shingle_words, similarity)
    return _HELD[token]


def _parts(benchmark: DataFrame, part_chars: int) -> Iterator[tuple]:
    """The benchmark in parts of about ``part_chars`` characters, each broadcast by itself."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // part_chars)
    for i in range(n):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, part_chars: int = PART_CHARS) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: each item that a document holds, and the window most like it.

    An item of ``n`` words is compared with every window of ``n`` words, or with the whole of a shorter text: the similarity is the weighted Jaccard of
    their bags of ``shingle_words`` words in a row, case and punctuation aside. Items of fewer words match nothing: too
    many documents hold them by chance.
    Documents aren't shuffled; the benchmark is taken in parts of bounded size, each against all documents. Null and
    empty texts and items match nothing; rows and items that repeat are matched each; null ids stay null.
    """
    found = None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
    for token, items in _parts(benchmark, part_chars):

        def run(batches: Iterator[pa.RecordBatch], token=token, items=items) -> Iterator[pa.RecordBatch]:
            index = _index(token, items, shingle_words, similarity)
            for batch in batches:
                got = [(key, *m) for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))) for m in index.matches(text)]
                if got:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of ``docs`` for which :func:`benchmark_matches` has nothing, all columns as they were, whatever their names.

    Null and empty texts stay; rows that repeat go or stay alike; null ids are ids like others; an empty benchmark keeps
    all; no rows give none.
    """
    at, schema = docs.columns.index("text"), docs.schema
    for token, items in _parts(benchmark, part_chars):

        def run(batches: Iterator[pa.RecordBatch], token=token, items=items) -> Iterator[pa.RecordBatch]:
            index = _index(token, items, shingle_words, similarity)
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(text) for text in texts_of(batch.column(at))], pa.bool_()))
            give_back()

        docs = docs.mapInArrow(run, schema)
    return docs

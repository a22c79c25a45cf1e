"""Packing as a cutting-stock problem: patterns of lengths by column generation, documents assigned to them by rank.

Lengths are put in classes of GRAIN tokens. A linear program says how often each pattern of classes is used; a knapsack
over the capacity, by dynamic programming, prices patterns with the program's duals and adds the best until none can lower
the number of sequences. Patterns are used a whole number of times. Documents, ranked within their class, the longest
first, take the places. What stays without a place is cut to fill the room that is left, and then sequences of its own,
the last of them powers of two: so no sequence needs padding. The program sees counts of lengths, never documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.lookback import in_ranges
from emberlog.functions.storage import stage
from emberlog.llm.memory import give_back, small_batches
from emberlog.llm.prefilter import possible
from emberlog.llm.tokens import slabs
from emberlog.llm.word_tokens import WORD_TOKENIZER, word_encoder

#: Tokens of a class of lengths: 256 classes, and so as many rows of the program, for 4096.
GRAIN = 16
#: The program ends when its dual bound is within this share of its value.
TOLERANCE = 1e-4
#: Tokens of a stretch in which room and documents that fill it meet.
STRETCH = 512
#: Cut documents that are broadcast at most; more are joined by a shuffle of those that may be among them.
BROADCAST_CUT = 20_000


def _knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how many of each size, any number of each, fit into ``room``. ``sizes`` rise."""
    best, chosen = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if fitting[w]:
            worth = best[w - sizes[: fitting[w]]] + values[: fitting[w]]
            i = int(worth.argmax())
            if worth[i] > best[w]:
                best[w], chosen[w] = worth[i], i
    pattern, w = np.zeros(len(sizes)), room
    while w > 0:
        if chosen[w] < 0:
            w -= 1
        else:
            pattern[chosen[w]] += 1
            w -= sizes[chosen[w]]
    return float(best[room]), pattern


def generate_columns(sizes: Sequence[int], demand: Sequence[int], room: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (a row each, pieces of each size), how often the linear program uses them, and a lower bound of the sum.

    ``sizes`` rise from 1 to ``room`` at most and ``demand`` is positive; all demand is met.
    """
    sizes, demand = np.asarray(sizes, np.int64), np.asarray(demand, np.float64)
    m = len(sizes)
    patterns = np.diag((room // sizes).astype(np.float64))
    inverse = np.diag(1 / patterns.diagonal())
    # Slightly uneven demand: no two rows leave the basis at once, and the program can't go round.
    used = inverse @ (demand * (1 + 1e-9 * np.arange(1, m + 1)))
    bound, steps = 0.0, 0
    while True:
        duals = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = _knapsack(sizes, duals, room)
        bound = max(bound, float(duals @ demand) / max(worth, 1.0))
        if worth <= 1 + 1e-9 or used.sum() - bound <= TOLERANCE * bound:
            break
        direction = inverse @ pattern
        rows = np.flatnonzero(direction > 1e-9)
        out = rows[(used[rows] / direction[rows]).argmin()]
        patterns[out] = pattern
        steps += 1
        if steps % 100:
            own = inverse[out] / direction[out]
            inverse -= np.outer(direction, own)
            inverse[out] = own
        else:
            inverse = np.linalg.inv(patterns.T)
        used = np.maximum(inverse @ (demand * (1 + 1e-9 * np.arange(1, m + 1))), 0)
    return patterns.astype(np.int64), used, bound


def plan(lengths: dict[int, int], capacity: int, grain: int) -> tuple[list[tuple], int]:
    """Places for documents of ``lengths`` (length -> number): rows ``class, at, n, each, first, nth`` and the number of sequences.

    The documents of ranks ``at`` to ``at + n`` of a class go ``each`` to a sequence, to sequences from ``first`` on, as
    their ``nth`` part. No more sequences than all tokens fill are planned, so that what has no place fills the rest.
    """
    demand: dict[int, int] = {}
    for length, n in lengths.items():
        demand[-(-length // grain)] = demand.get(-(-length // grain), 0) + n
    total = sum(length * n for length, n in lengths.items())
    if total < capacity:
        return [], 0
    sizes = sorted(demand)
    patterns, used, _ = generate_columns(sizes, [demand[s] for s in sizes], capacity // grain)
    times = np.floor(used * min(1.0, total // capacity / used.sum()) + 1e-6).astype(np.int64)
    places, taken, first = [], dict.fromkeys(sizes, 0), 0
    for pattern, n in zip(patterns.tolist(), times.tolist()):
        if n and any(pattern):
            for nth, (size, each) in enumerate(zip(sizes, pattern)):
                if each:
                    places.append((size, taken[size], each * n, each, first, nth))
                    taken[size] += each * n
            first += n
    while first > total // capacity:  # rounding can't be off by more than its tolerance
        first -= 1
        places = [(s, at, min(n, each * max(0, first - f)), each, f, nth) for s, at, n, each, f, nth in places]
    return [p for p in places if p[2] > 0], first


PIECE = "doc_id long, doc_tokens long, rest int, rest_crc32 long, full array<long>, ids array<int>, part int, row long, nth long, full_at long"


def _encoded(capacity: int, tokenizer: str, end_id: int):
    """A row for each document: its full pieces' checksums, its rest's ids, and its place among the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, part = word_encoder(tokenizer), np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        seen, row, full_at = np.zeros(capacity, np.int64), 0, 0
        for batch in batches:
            for at, texts in slabs(batch.column(1)):
                got = coder.encode_batch(texts, end)
                sizes = np.diff(got.ends, prepend=0)
                rest, fulls = sizes % capacity, sizes // capacity
                begins = got.ends - sizes
                crc = lambda a, b: zlib.crc32(got.ids[a:b])  # noqa: B023, E731
                full = [[crc(b + i * capacity, b + (i + 1) * capacity) for i in range(n)] for b, n in zip(begins.tolist(), fulls.tolist())]
                rests = [crc(e - r, e) for e, r in zip(got.ends.tolist(), rest.tolist())]
                order = np.argsort(rest, kind="stable")
                lengths, firsts, counts = np.unique(rest[order], return_index=True, return_counts=True)
                nth = np.empty(len(rest), np.int64)
                nth[order] = np.arange(len(rest)) - np.repeat(firsts, counts) + np.repeat(seen[lengths], counts)
                seen[lengths] += counts
                inside = np.arange(len(got.ids)) >= np.repeat(got.ends - rest, sizes)
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(rest)]).astype(np.int32), pa.array(got.ids[inside].view(np.int32)))
                n = len(sizes)
                columns = [batch.column(0).slice(at, n), pa.array(sizes), pa.array(rest.astype(np.int32)), pa.array(rests, pa.int64()), pa.array(full, pa.list_(pa.int64())), ids, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(nth), pa.array(full_at + np.cumsum(fulls) - fulls)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECE.split(", ")])
                row, full_at = row + n, full_at + int(fulls.sum())
        give_back()

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut rests ``doc_id, doc_tokens, ids, cuts`` to pieces."""
    for batch in batches:
        out = []
        for doc, tokens, ids, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            raw = ids.values.to_numpy().view(np.uint32)
            out += [(doc, tokens - len(raw) + c["start"], c["length"], zlib.crc32(raw[c["start"] : c["start"] + c["length"]]), tokens, c["sequence_id"], c["offset"]) for c in cuts]
        columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PLACED.split(", ")])


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _laid(df: DataFrame, order: list[str], amount: str) -> tuple[DataFrame, int]:
    """``df`` with ``begin``, the sum of ``amount`` over the rows before in ``order``, and the whole sum."""
    rows = in_ranges(df, order)
    sums = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.sum(amount).alias("n")).collect())
    bases, total = [], 0
    for part, n in sums:
        bases.append((part, total))
        total += n
    within = F.sum(amount).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    base = df.sparkSession.createDataFrame(bases, "__p int, __base long")
    return rows.join(F.broadcast(base), F.col("__part") == F.col("__p")).withColumn("begin", F.col("__base") + within).drop("__part", "__at", "__p", "__base"), total


def _own_sequences(total: int, begin: int, first: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """``sequence_id, offset, room, begin`` of sequences for ``total`` tokens: full ones, then powers of two."""
    sizes = [capacity] * (total // capacity) + [1 << i for i in reversed(range(capacity.bit_length())) if (total % capacity) >> i & 1]
    out = []
    for i, size in enumerate(sizes):
        out.append((first + i, 0, size, begin))
        begin += size
    return out


def pack_cutting_stock(docs: DataFrame, capacity: int = 4096, tokenizer: str = WORD_TOKENIZER, end_id: int = 2, grain: int = GRAIN) -> DataFrame:
    """Pieces of all ``docs(doc_id, text)`` in sequences without padding: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    A document of over ``capacity`` ids gives full pieces, sequences of their own, and a rest; rests are packed by the
    plan, and those without a place are cut. Null and empty texts are one id; rows that repeat are packed each; null ids
    stay null; other columns are left out; no rows give none. The driver holds counts by length, one number for each
    partition, and fewer sequences than there are classes; ``grain`` must divide ``capacity``.
    """
    if capacity % grain:
        raise ValueError("the grain must divide the capacity")
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark):
        rows = stage(given.mapInArrow(_encoded(capacity, tokenizer, end_id), PIECE), "rests")
    counts = stage(rows.filter("rest > 0").groupBy(F.col("rest").alias("length"), F.col("part").alias("task")).agg(F.count("*").alias("n")), "rest-counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, planned = plan(lengths, capacity, grain)
    size = F.ceil(F.col("length") / grain)
    earlier = Window.partitionBy(size).orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", size.cast("long").alias("size"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    narrow = rows.filter("rest > 0").select("doc_id", "doc_tokens", F.col("rest").cast("long").alias("rest"), "rest_crc32", "part", "row", "nth")
    ranked = narrow.join(bases, (F.col("rest") == F.col("length")) & (F.col("part") == F.col("task"))).withColumn("rank", F.col("base") + F.col("nth"))
    known = F.broadcast(spark.createDataFrame(places, "class long, at long, n long, each long, first long, place long"))
    own = F.col("rank") - F.col("at")
    ranked = ranked.join(known, (F.col("size") == F.col("class")) & (own >= 0) & (own < F.col("n")), "left").withColumn("sequence_id", F.col("first") + F.floor(own / F.col("each")))
    columns = ("doc_id", "doc_tokens", "rest", "rest_crc32", "part", "row", "sequence_id", "place", "rank")
    ranked = stage(ranked.select(*columns), "rests-ranked")
    inside = Window.partitionBy("sequence_id").orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.filter("sequence_id IS NOT NULL").withColumn("offset", F.sum("rest").over(inside) - F.col("rest"))
    room = ranked.filter("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.sum("rest").alias("offset")).withColumn("room", F.lit(capacity) - F.col("offset")).filter("room > 0")
    room, left = _laid(room, ["sequence_id"], "room")
    cut, tokens = _laid(ranked.filter("sequence_id IS NULL").select("part", "row", "rest"), ["part", "row"], "rest")
    more = spark.createDataFrame(_own_sequences(max(0, tokens - left), left, planned, capacity), "sequence_id long, offset long, room long, begin long")
    pieces = _filled(room.select("sequence_id", "offset", "room", "begin").unionByName(more), cut)
    pieces = stage(pieces.groupBy("part", "row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts")), "rests-cut")
    whole = rows.select("doc_id", "doc_tokens", "ids", F.col("part").alias("p"), F.col("row").alias("r"))
    if pieces.count() <= BROADCAST_CUT:
        pieces = F.broadcast(pieces)
    else:
        keyed = lambda part, row: (F.col(part).cast("long") * (1 << 40)) + F.col(row)
        whole = whole.filter(possible(pieces.select(keyed("part", "row").alias("k")), "k")(keyed("p", "r")))
    cut_rows = whole.join(pieces, (F.col("part") == F.col("p")) & (F.col("row") == F.col("r"))).select("doc_id", "doc_tokens", "ids", "cuts").mapInArrow(_cut, PLACED)
    fulls = rows.filter("size(full) > 0").select("doc_id", "doc_tokens", "part", "full_at", F.posexplode("full").alias("i", "crc"))
    # Sequences of one piece are numbered below zero, by task.
    alone = -1 - (F.col("part").cast("long") * (1 << 40) + F.col("full_at") + F.col("i"))
    fulls = fulls.select("doc_id", (F.col("i") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = placed.select("doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return fulls.unionByName(placed).unionByName(cut_rows)


def _filled(room: DataFrame, cut: DataFrame) -> DataFrame:
    """``part, row, start, length, sequence_id, offset``: where each stretch of ``cut(part, row, rest, begin)`` lies in
    ``room(sequence_id, offset, room, begin)``, both laid end to end on one line."""
    reach = lambda begin, n: F.explode(F.sequence(F.floor(F.col(begin) / STRETCH), F.floor((F.col(begin) + F.col(n) - 1) / STRETCH)))
    a = room.withColumn("stretch", reach("begin", "room"))
    b = cut.select("part", "row", "rest", F.col("begin").alias("from")).withColumn("s", reach("from", "rest"))
    low, high = F.greatest("begin", "from"), F.least(F.col("begin") + F.col("room"), F.col("from") + F.col("rest"))
    met = a.join(b, F.col("stretch") == F.col("s")).filter((low < high) & (F.floor(low / STRETCH) == F.col("stretch")))
    return met.select("part", "row", (low - F.col("from")).alias("start"), (high - low).alias("length"), "sequence_id", (F.col("offset") + low - F.col("begin")).alias("offset"))

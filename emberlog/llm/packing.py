"""Best-fit packing of tokenised documents into sequences of bounded length, in bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.storage import stage
from emberlog.llm.memory import gathered, give_back, small_batches
from emberlog.llm.names import unused
from emberlog.llm.tokens import DEFAULT_TOKENIZER, encoder, slabs

#: A sweep takes documents of at least this share of the longest that waits, and all once that is a sixth of the capacity.
SWEEP_SHARE, SWEEP_ALL = (2, 3), 6
#: Ranges of sizes that are swept apart before their leftovers meet.
RANGES = 16
#: Steps that are broadcast at most; there are about as many as lengths and rounds, whatever the number of rows.
BROADCAST_STEPS = 1_000_000
#: Texts are encoded together up to so many bytes: the more, the fewer words are encoded again.
TEXT_BYTES = 8 << 20
GAP, WAITING, PLACED, FILLED, LATER, SUMMARY = range(6)
#: A run of ``n`` equal things. Gaps: sequences ``at``, ``at + 1``, ...; ``size`` is what a sweep sorts by, ``left`` the
#: room in each, ``slots`` how many documents each may take in this sweep. Documents: ranks ``at``, ``at + 1``, ... of
#: length ``size``. Placed: ranks from ``at`` on are in sequences from ``sequence`` on, ``slots`` in each, from ``offset`` on.
RUN = "kind int, size long, at long, n long, slots long, left long, sequence long, offset long"
_RUN = [f.split()[0] for f in RUN.split(", ")]
STEP = ("size", "at", "n", "slots", "sequence", "offset")


def _pieces(tokenizer: str, capacity: int, end_id: int, keep_ids: bool, text_bytes: int = TEXT_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.uint32(end_id).tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
        for batch in gathered(batches, 1, text_bytes):
            for at, texts in slabs(batch.column(1), text_bytes):
                got = coder.encode_batch(texts, end)
                sizes = np.diff(got.ends, prepend=0)
                pieces = -(-sizes // capacity)
                first = sizes - (pieces - 1) * capacity  # only the first piece may be short
                owner = np.repeat(np.arange(len(sizes)), pieces)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(nth == 0, 0, first[owner] + (nth - 1) * capacity)
                length = np.where(nth == 0, first[owner], capacity)
                stops = np.cumsum(length)
                crcs = [zlib.crc32(got.ids[a:b]) for a, b in zip((stops - length).tolist(), stops.tolist())]
                keys = batch.column(0).slice(at, len(texts)).take(pa.array(owner))
                columns = [keys, pa.array(nth, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], stops]).astype(np.int32), pa.array(got.ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    return run


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Encode ``docs(doc_id, text)``, end each with ``end_id`` and cut those of over ``capacity`` ids.

    Returns ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``. All pieces of a cut document are
    full but the first. Null and empty texts are one piece of the end id; rows that repeat give pieces that repeat; null
    ids stay null; other columns are left out. No rows: none.
    """
    return _given(docs).mapInArrow(_pieces(tokenizer, capacity, end_id, keep_ids), _schema(keep_ids))


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _schema(keep_ids: bool) -> str:
    return "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids


def sweep(runs: Iterable[tuple], capacity: int) -> Iterator[tuple]:
    """One successor sweep over runs in descending order of size, gaps before documents of the same size.

    The gaps passed so far are those that are large enough, and the last of them is the smallest: it is the successor of
    the document at hand, which so gets the best fit that no longer document, nor one before it, has claimed. A gap
    takes at most its ``slots`` in a sweep.
    """
    free: list[list[int]] = []
    for kind, size, at, n, slots, left, sequence, offset in runs:
        if kind == GAP:
            free.append([size, at, n, slots, left])
            continue
        if kind != WAITING:
            yield kind, size, at, n, slots, left, sequence, offset
            continue
        while n and free:
            own, first, m, slots, left = free[-1]
            each, gaps = (slots, min(m, n // slots)) if n >= slots else (n, 1)
            yield PLACED, size, at, each * gaps, each, 0, first, capacity - left
            at, n, left = at + each * gaps, n - each * gaps, left - each * size
            free[-1][1:3] = first + gaps, m - gaps
            if m == gaps:
                free.pop()
            if each < slots:
                free.append([own, first, 1, slots - each, left])
            elif left:
                yield FILLED, left, first, gaps, 0, left, 0, 0
        if n:
            yield WAITING, size, at, n, 0, 0, 0, 0
    for own, first, n, slots, left in free:
        yield GAP, own, first, n, slots, left, 0, 0


def least_of_sweep(longest: int, capacity: int) -> int:
    """The shortest documents that a sweep takes."""
    return -(-longest * SWEEP_SHARE[0] // SWEEP_SHARE[1]) if longest * SWEEP_ALL > capacity else 1


def summary(runs: list[tuple], capacity: int) -> tuple:
    """What the next round needs to know: ``at`` the longest document that waits, ``n`` sequences to open for it.

    Documents longer than all gaps, of those that the next sweep takes, need a sequence each if no two fit together,
    else as many as hold their ids at least.
    """
    docs, gaps = [r for r in runs if r[0] in (WAITING, LATER)], [r[5] for r in runs if r[0] in (GAP, FILLED)]
    longest, widest = max((r[1] for r in docs), default=0), max(gaps, default=0)
    stuck = [(size, n) for _, size, _, n, *_ in docs if size > widest and size >= least_of_sweep(longest, capacity)] if longest > widest else []
    alone, total = sum(n for size, n in stuck if 2 * size > capacity), sum(size * n for size, n in stuck)
    return SUMMARY, 0, longest, alone or -(-total // capacity), 0, 0, 0, 0


def _swept(capacity: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> pa.RecordBatch:
            rows = list(sweep(held, capacity))
            columns = list(zip(*rows, *[summary(rows, capacity)] * last)) or [[]] * len(_RUN)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.int32()) for i, c in enumerate(columns)], _RUN)

        for batch in batches:
            for new, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if new != part:
                    if part is not None:
                        yield done()
                    part, held = new, []
                held.append(row)
        yield done()

    return run


def _dealt(runs: DataFrame, part: Column | None = None) -> DataFrame:
    """``runs`` with the range ``part`` before them, or all in one, sorted for a sweep; of a gap's rows the one begun comes last."""
    dealt = runs.select((F.lit(0) if part is None else part).cast("int").alias("part"), *_RUN)
    dealt = dealt.repartition(1) if part is None else dealt.repartition("part")
    return dealt.sortWithinPartitions("part", F.desc("size"), "kind", F.desc("slots"), "at")


def _round(state: DataFrame, capacity: int, longest: int, opened: int, new: int) -> DataFrame:
    """One superstep: open ``new`` sequences, sweep each range of sizes by itself, then what is left over together."""
    if new:
        added = [F.lit(x).cast(t.split()[1]).alias(t.split()[0]) for x, t in zip((GAP, capacity, opened, new, 0, capacity, 0, 0), RUN.split(", "))]
        state = state.unionByName(state.sparkSession.range(1).select(*added))
    kind = F.when(F.col("kind") == GAP, F.lit(GAP)).when(F.col("size") >= least_of_sweep(longest, capacity), F.lit(WAITING)).otherwise(F.lit(LATER))
    slots = F.when(F.col("kind") == GAP, F.greatest(F.lit(1), F.floor(F.col("left") / longest)))
    runs = state.withColumn("slots", F.coalesce(slots, F.lit(0)).cast("long")).withColumn("kind", kind)
    local = _dealt(runs, F.floor(F.col("size") * RANGES / (capacity + 1))).mapInArrow(_swept(capacity, False), RUN)
    return _dealt(local).mapInArrow(_swept(capacity, True), RUN)


def best_fit(counts: DataFrame, capacity: int) -> DataFrame:
    """Steps ``size, at, n, slots, sequence, offset`` that place ``counts(size, n)``, documents of equal length as one run.

    Documents and gaps are runs, sorted by ranges of size. A round matches each document with its successor among the
    gaps; where several claim one gap, the longest and then the least rank wins, and the others go on to the next gap or
    round. Then gaps shrink by what they took, and the next round begins. Documents longer than all gaps open new
    sequences (:func:`summary`). Runs number about as many as lengths, not rows; the driver sees one row of a round,
    which says whether documents wait.
    """
    waiting = counts.select(F.lit(WAITING).alias("kind"), "size", F.lit(0).cast("long").alias("at"), "n", *(F.lit(0).cast("long").alias(c) for c in ("slots", "left", "sequence", "offset")))
    # No gaps and nothing that a sweep may take yet: this only sums up.
    swept = stage(_dealt(waiting.withColumn("kind", F.lit(LATER))).mapInArrow(_swept(capacity, True), RUN), "pack-round")
    opened, steps = 0, []
    while True:
        row = swept.filter(F.col("kind") == SUMMARY).select("at", "n").first()
        if row is None or not row["at"]:  # an empty input may have no summary
            break
        longest, new = row
        gaps = swept.filter(F.col("kind").isin(GAP, FILLED)).withColumn("kind", F.lit(GAP)).withColumn("size", F.col("left"))
        state = gaps.unionByName(swept.filter(F.col("kind").isin(WAITING, LATER)))
        swept = stage(_round(state, capacity, longest, opened, new), "pack-round")
        steps.append(swept.filter(F.col("kind") == PLACED))
        opened += new
    found = steps[0] if steps else swept.limit(0)
    for more in steps[1:]:
        found = found.unionByName(more)
    return found.select(*STEP)


def _numbered(at: int, names: list[str]):
    """Add the task and each row's place among the task's rows of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            nth = []
            for length in batch.column(at).to_pylist():
                nth.append(seen.get(length, 0))
                seen[length] = nth[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], names)

    return run


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give each row of ``pieces`` a place: its columns plus ``sequence_id`` and ``offset`` (long), by :func:`best_fit`.

    ``length`` says how much room a row needs, from 1 to ``capacity``; other lengths, null too, raise an error. Rows are
    written down with their task and their place among its rows of that length; counts per length and task give each
    row its rank, so that no length, however many rows share it, is one task's, and rows that are alike are dealt like
    others. Null ids, ties and repeated rows are rows like any other; no rows give none. Columns of ``pieces`` that are
    named ``sequence_id`` or ``offset`` are replaced; other names never clash.
    """
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    given = pieces.select(*(f"`{c}`" for c in kept))
    return _packed(given, None, given.dtypes, capacity)


def _packed(given: DataFrame, made: Callable | None, dtypes: list[tuple[str, str]], capacity: int) -> DataFrame:
    """Pack the rows of ``given``, or those that ``made`` makes of its batches, with columns of ``dtypes``."""
    kept = [n for n, _ in dtypes]
    length, part, nth, task, base, *step = unused([*kept, "sequence_id", "offset"], "own_length", "part", "nth", "task", "base", *STEP)
    numbered = _numbered(kept.index("length"), [*kept, part, nth])
    schema = ", ".join(f"`{n}` {t}" for n, t in dtypes) + f", `{part}` int, `{nth}` long"
    with small_batches(given.sparkSession):
        rows = stage(given.mapInArrow(numbered if made is None else lambda batches: numbered(made(batches)), schema), "pieces")
    sized = stage(rows.groupBy(F.col("length").cast("long").alias(length), F.col(part).alias(task)).agg(F.count("*").alias("n")), "piece-counts")
    if bad := sized.filter(~F.coalesce(F.col(length).between(1, capacity), F.lit(False))).first():
        raise ValueError(f"lengths must be from 1 to {capacity}: {bad[length]}")
    earlier = Window.partitionBy(length).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.select(length, task, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(base))
    ranked = rows.join(bases, (F.col("length").cast("long") == F.col(length)) & (F.col(part) == F.col(task)))
    steps = stage(best_fit(sized.groupBy(F.col(length).alias("size")).agg(F.sum("n").alias("n")), capacity), "pack-steps")
    named = steps.toDF(*step)
    if steps.count() <= BROADCAST_STEPS:
        named = F.broadcast(named)
    size, at, n, each, sequence, offset = map(F.col, step)
    own = F.col(base) + F.col(nth) - at
    found = ranked.join(named, (F.col(length) == size) & own.between(0, n - 1))
    return found.select(*(f"`{c}`" for c in kept), (sequence + F.floor(own / each)).alias("sequence_id"), (offset + own % each * size).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 0, keep_ids: bool = False, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """:func:`pack` of the :func:`token_pieces` of ``docs``, which are numbered by the task that cuts them. Texts are encoded
    together up to ``text_bytes``: the more, the less time and the more memory."""
    dtypes = [tuple(c.split()) for c in _schema(keep_ids).split(", ")]
    return _packed(_given(docs), _pieces(tokenizer, capacity, end_id, keep_ids, text_bytes), dtypes, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, ``sequence_id, ids``, of what :func:`pack_documents` placed with ``keep_ids``.

    A sequence gathers at most its capacity of ids. Rows without ``ids`` add none; no rows give none.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.filter(parts, lambda p: p["ids"].isNotNull()), lambda p: p["ids"])).alias("ids"))

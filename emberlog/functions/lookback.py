"""Look-back windows in arrival order (time, then id), exact where times tie, with no task bound to one key.

A key may hold most of the rows, so windows are dealt by pieces of a key: pieces of time, or of the global order, each
with a halo of the rows before it that its windows reach into.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from emberlog.functions.storage import stage

#: A piece of time is so many windows long: rows of the last one are also dealt to the piece after.
PIECE_WINDOWS = 8
_POSITION = (1 << 33) - 1
#: Numbers below have a square that is finite.
SQUARED_FINITE = 1e150


def with_trailing_counts(df: DataFrame, counts: Mapping[str, Sequence[str]], window_us: int, include_self: bool = True) -> DataFrame:
    """``df`` with, under each name of ``counts``, how many rows of the same keys came in the last ``window_us`` microseconds
    up to this one, both ends included; of rows of the same time those count that come before it by ``id``.

    The first keys must be among those of all others. Pieces of one key and time are dealt apart. Rows without a time
    form one piece of their key. Each row comes a second time, as the mark that it leaves the windows, with its keys alone:
    a running sum of rows less marks is the count, and takes the same time a row however many rows a window holds.
    """
    width = PIECE_WINDOWS * max(window_us, 1)
    own, end = F.floor(F.col("us") / width), F.floor((F.col("us") + window_us) / width)
    kept = {"us", *(k for keys in counts.values() for k in keys)}
    copy = lambda piece, leaves: F.struct(piece.alias("__piece"), F.lit(leaves).alias("__leaves"))
    stay = F.transform(F.sequence(own, end), lambda p: copy(p, 0))
    timed = F.concat(stay, F.array(copy(end, 1)))
    copies = F.when(F.col("us").isNull(), F.array(copy(F.lit(None).cast("long"), 0))).otherwise(timed)
    rows = df.withColumn("__home", own).select("*", F.inline(copies))
    there = F.col("__leaves") == 0
    # A row leaves after the last microsecond of its window, before any row of the next one.
    at = F.when(there, F.col("us")).otherwise(F.col("us") + window_us + 1).alias("__time")
    rows = rows.select(*(F.col(f"`{c}`") if c in kept else F.when(there, F.col(f"`{c}`")).alias(c) for c in df.columns), "__home", "__piece", "__leaves", at)
    for name, keys in counts.items():
        frame = Window.partitionBy(*keys, "__piece").orderBy("__time", F.col("__leaves").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(name, F.sum(F.when(there, 1).otherwise(-1)).over(frame) - (0 if include_self else 1))
    return rows.filter(there & F.col("__home").eqNullSafe(F.col("__piece"))).drop("__home", "__piece", "__leaves", "__time")


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` written down in ranges of ``order``: ``__part`` numbers them in order, ``__at`` the rows of each, from 0."""
    place = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(sorted_rows.select("*", F.shiftright(place, 33).cast("int").alias("__part"), place.bitwiseAND(F.lit(_POSITION)).alias("__at")), "ordered")


def with_rank(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``name``, a row's number among those of the same keys in ``order``, from 1. Null keys are keys like others.

    Rows are dealt by ranges of keys and order: a row's number is that within its range plus the rows of its keys in the
    ranges before, of which there is one count each.
    """
    rows = in_ranges(df, [*keys, *order])
    own = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__part", *keys).orderBy("__at"))
    found = joined(rows.withColumn("__in", within), own.select(*keys, "__part", before.alias("__base")), [*keys, "__part"])
    return found.select(*(f"`{c}`" for c in df.columns), (F.col("__in") + F.col("__base")).cast("long").alias(name))


def joined(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``table`` where all ``keys`` are the same; nulls are the same."""
    other = table.select(*(F.col(f"`{c}`").alias(f"__k_{c}" if c in keys else c) for c in table.columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`__k_{k}`"))
    return rows.join(other, same, how).drop(*(f"__k_{k}" for k in keys))


def with_global_position(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``pos``, its place in one global order, from 0, without bringing all rows to one task.

    Rows are dealt by ranges and written down; only a count per range reaches the driver.
    """
    part = in_ranges(df, order)
    counts = sorted((r["__part"], r["n"]) for r in part.groupBy("__part").agg(F.count("*").alias("n")).collect())
    bases, at = [], 0
    for p, n in counts:
        bases.append((p, at))
        at += n
    base = df.sparkSession.createDataFrame(bases, "__part int, __base long")
    return part.join(F.broadcast(base), "__part").withColumn("pos", F.col("__base") + F.col("__at")).drop("__part", "__base", "__at")


def with_halo(df: DataFrame, rows_before: int, bucket_rows: int = 20_000) -> DataFrame:
    """Rows with ``pos`` dealt to ``bucket``s, each with copies of the ``rows_before`` rows ahead of it (``owned`` false).

    A window of that many rows, partitioned by ``bucket`` and ordered by ``pos``, is then exact for the owned rows.
    """
    if rows_before >= bucket_rows:
        bucket_rows = rows_before + 1
    own = F.floor(F.col("pos") / bucket_rows)
    ahead = F.when(F.col("pos") % bucket_rows >= bucket_rows - rows_before, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("bucket", F.explode(ahead)).withColumn("owned", F.col("bucket") == own)


def with_previous(df: DataFrame, columns: Mapping[str, str], keys: Sequence[str], order: Sequence[str] = ("us", "id")) -> DataFrame:
    """``df`` with, under each name of ``columns``, a column's value in the row before of the same keys; null without one."""
    placed = with_halo(with_global_position(df, [*keys, *order]), 1)
    before = Window.partitionBy("bucket", *keys).orderBy("pos")
    return placed.select("*", *(F.lag(c).over(before).alias(n) for n, c in columns.items())).filter("owned").drop("bucket", "owned", "pos")


def sliding_moments(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of the ``n`` values of each row of ``x`` from ``first`` on; NaN where ``n`` is 0.

    States of a mean and a sum of squares around it are merged (Chan) along a tree of blocks of 1, 2, 4, ... values; a
    frame is the blocks of the bits of its length. A value, however large, so touches only the frames that hold it. Frames with
    infinities or NaN have a deviation of NaN and the mean that numpy gives; in those where nothing changes it is 0.
    """
    mean, spread = np.full((2, len(x), len(n)), np.nan)
    for i, own in enumerate(x):  # one after another, so that what a row takes stays in the processor's cache
        if len(own) and abs(own[0]) < SQUARED_FINITE and (own == own[0]).all():
            mean[i], spread[i] = np.where(n > 0, own[0], np.nan), np.where(n > 0, 0.0, np.nan)
        else:
            mean[i : i + 1], spread[i : i + 1] = _sliding_moments(x[i : i + 1], first, n)
    return mean, spread


def _sliding_moments(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    odd = ~np.isfinite(x)
    counts = lambda flags: np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(flags, axis=1)], axis=1)
    within = lambda sums, a, b: sums[:, b] - sums[:, a]
    end, held = first + n, np.zeros(len(n), np.int64)
    mean, squares = np.zeros((len(x), len(n))), np.zeros((len(x), len(n)))
    block, around, size, at = np.where(odd, 0.0, x), np.zeros(x.shape), 1, end.copy()
    with np.errstate(over="ignore", invalid="ignore"):
        while True:
            own = np.flatnonzero(n & size)
            at[own] -= size
            before, total = held[own], held[own] + size
            step = mean[:, own] - block[:, at[own]]
            squares[:, own] += around[:, at[own]] + step * step * (before * (size / total))
            mean[:, own] = block[:, at[own]] + step * (before / total)
            held[own] = total
            if 2 * size > int(n.max(initial=0)):
                break
            step = block[:, size:] - block[:, :-size]
            around = around[:, :-size] + around[:, size:] + step * step * (size / 2)
            block, size = block[:, :-size] + step / 2, 2 * size
        spread = np.sqrt(squares / np.maximum(n, 1))
    if odd.any():
        low, high, none = (within(counts(f), first, end) for f in (x == -np.inf, x == np.inf, np.isnan(x)))
        mean = np.where(none + low * high > 0, np.nan, np.where(high > 0, np.inf, np.where(low > 0, -np.inf, mean)))
        spread = np.where(low + high + none > 0, np.nan, spread)
    changes = np.zeros(x.shape, bool)
    changes[:, 1:] = x[:, 1:] != x[:, :-1]
    changed = counts(changes)
    still = (within(changed, np.minimum(first + 1, end), end) == 0) & ~np.isnan(spread)
    return np.where(n > 0, mean, np.nan), np.where(n > 0, np.where(still, 0.0, spread), np.nan)


def _mean_z(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The mean |z| of each column of values, of those that are numbers; NaN without one. Added up in their order."""
    total, known = np.zeros(x.shape[1]), np.zeros(x.shape[1], np.int64)
    with np.errstate(invalid="ignore", over="ignore"):
        for own, middle, deviation in zip(x, mean, spread):
            z = np.abs(own - middle) / (deviation + 1e-6)
            there = ~np.isnan(z)
            total, known = np.where(there, total + z, total), known + there
        return np.where(known > 0, total / np.maximum(known, 1), np.nan)


def _moments(keys: int, columns: int, last: int, skip: int, as_z: bool):
    """Moments of rows ``bucket, keys..., numbers..., row, pos, owned`` that come sorted: the ``row`` of owned ones with
    ``n``, and numbers, means and deviations or their mean z after."""

    def of_bucket(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in batch.columns[1 : 1 + keys]:
            codes = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        at = np.arange(batch.num_rows)
        first = np.maximum.accumulate(np.where(new, at, 0))
        own = np.flatnonzero(batch.column("__owned").to_numpy(zero_copy_only=False))
        high = own - skip
        low = np.minimum(np.maximum(first[own], high - last + 1), high + 1)
        n = high + 1 - low
        x = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[1 + keys : 1 + keys + columns]], float).reshape(columns, -1)
        mean, spread = sliding_moments(x, low, n)
        x = x[:, own]
        if as_z:
            z = _mean_z(x, mean, spread)
            out, names = [pa.array(z, mask=np.isnan(z))], ["z"]
        else:
            out = [*map(pa.array, x), *(pa.array(v, mask=n == 0) for pair in zip(mean, spread) for v in pair)]
            names = [*(f"__x{i}" for i in range(columns)), *(f"m{i}" for i in range(2 * columns))]
        return pa.RecordBatch.from_arrays([batch.column("__row").take(pa.array(own)), pa.array(n, pa.int64()), *out], ["__row", "n", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and b > a and held[0].column(0)[0].as_py() != bucket[a]:
                    yield of_bucket(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield of_bucket(pa.Table.from_batches(held))

    return run


def _trailing(df: DataFrame, columns: Sequence[str], last: int, keys: Sequence[str], order: Sequence[str], include_self: bool, as_z: bool) -> tuple[DataFrame, list[str]]:
    """Rows as :func:`_moments` gives them, and the columns that ``__row`` holds. Doubles are carried once, as the numbers."""
    types = dict(df.dtypes)
    carried = [c for c in df.columns if c not in columns or (types[c] != "double" and not as_z)]
    placed = with_halo(with_global_position(df, [*keys, *order]), last if not include_self else last - 1)
    given = [F.col("bucket").alias("__bucket"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns))]
    kept = [F.struct(F.lit(None).cast("boolean").alias("__none"), *(F.col(f"`{c}`") for c in carried)).alias("__row"), F.col("pos").alias("__pos"), F.col("owned").alias("__owned")]
    rows = placed.select(*given, *kept).repartition("__bucket").sortWithinPartitions("__bucket", *(f"__k{i}" for i in range(len(keys))), "__pos")
    names = ["z"] if as_z else [*(f"__x{i}" for i in range(len(columns))), *(f"m{i}" for i in range(2 * len(columns)))]
    schema = StructType([rows.schema["__row"], StructField("n", LongType()), *(StructField(n, DoubleType()) for n in names)])
    return rows.mapInArrow(_moments(len(keys), len(columns), last, 0 if include_self else 1, as_z), schema), carried


def with_trailing_moments(df: DataFrame, columns: Sequence[str], last: int, keys: Sequence[str] = (), order: Sequence[str] = ("us", "id"), include_self: bool = True) -> DataFrame:
    """``df`` with ``n``, and ``{column}_mean`` and ``{column}_dev`` (population deviation) of each number in ``columns``
    over the ``last`` rows of the same keys, the row itself included or those before it. The columns hold no nulls.

    A row's cost grows with the logarithm of the frame; a task holds one bucket of rows at a time. What an odd value does to
    a frame is in :func:`sliding_moments`.
    """
    found, carried = _trailing(df, columns, last, keys, order, include_self, False)
    given = [F.col(f"__row.`{c}`").alias(c) if c in carried else F.col(f"__x{list(columns).index(c)}").alias(c) for c in df.columns]
    named = [F.col(f"m{2 * i + j}").alias(f"{c}_{what}") for i, c in enumerate(columns) for j, what in enumerate(("mean", "dev"))]
    return found.select(*given, "n", *named)


def trailing_z(df: DataFrame, columns: Sequence[str], last: int, keys: Sequence[str] = (), order: Sequence[str] = ("us", "id"), include_self: bool = True) -> DataFrame:
    """``df`` without ``columns`` and with ``n`` and ``z``: the mean over them of |x - mean| / (deviation + 1e-6), as
    :func:`with_trailing_moments` has these, of those that are numbers; null without one. Only ``z`` leaves the task."""
    found, carried = _trailing(df, columns, last, keys, order, include_self, True)
    return found.select(*(F.col(f"__row.`{c}`").alias(c) for c in carried), "n", "z")


def with_earlier_counts(df: DataFrame, counts: Mapping[str, Sequence[str]], order: Sequence[str] = ("us", "id"), sums: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with, under each name of ``counts``, how many rows of the same keys come before it in ``order``.

    A name in ``sums`` gets the sum of that column over those rows instead. Rows are dealt by ranges of the order; a
    row's count is that of its keys in the ranges before and within its own. Null keys are keys like others.
    """
    rows = in_ranges(df, order)
    weights = {name: F.coalesce(F.col((sums or {})[name]), F.lit(0)) if name in (sums or {}) else F.lit(1) for name in counts}
    narrow = rows.select("__part", "__at", *(F.col(k) for k in dict.fromkeys(k for keys in counts.values() for k in keys)), *(w.alias(f"__w{i}") for i, w in enumerate(weights.values())))
    for i, (name, keys) in enumerate(counts.items()):
        own = narrow.groupBy(*keys, "__part").agg(F.sum(f"__w{i}").alias("__n"))
        before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        bases = own.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
        within = F.sum(f"__w{i}").over(Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
        narrow = joined(narrow.withColumn("__in", F.coalesce(within, F.lit(0))), bases, [*keys, "__part"]).withColumn(f"__c{i}", F.col("__in") + F.col("__base")).drop("__in", "__base")
    # Wide rows are shuffled once, whatever the number of counts.
    found = narrow.select(F.col("__part").alias("__p"), F.col("__at").alias("__a"), *(F.col(f"__c{i}").alias(n) for i, n in enumerate(counts)))
    return rows.join(found, (F.col("__part") == F.col("__p")) & (F.col("__at") == F.col("__a"))).select(*(f"`{c}`" for c in df.columns), *counts)

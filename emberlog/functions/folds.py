"""A fold whose state is where the current group began, as a parallel prefix of step functions."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.lookback import in_ranges


def first_below(last: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each place ``i`` the first ``j`` after it with ``last[j] < limits[i]``; ``len(last)`` without one."""
    out = np.full(len(last), len(last))
    # Places after i that are less than all between i and them, the nearest and largest last.
    places: list[int] = []
    values: list[int] = []
    for i in range(len(last) - 1, -1, -1):
        at = bisect_left(values, limits[i])
        out[i] = places[at - 1] if at else len(last)
        while values and values[-1] >= last[i]:
            places.pop()
            values.pop()
        places.append(i)
        values.append(int(last[i]))
    return out


def step_function(numbers: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a range makes of the start ``s`` of the group before it, ``s`` less than all its ``numbers``: pieces
    ``(upto, start)`` by rising ``upto``, of which the first with ``s <= upto`` holds; a start of -1 leaves ``s`` as it is.

    A block with ``last < s`` is the first of a new group; from there on nothing depends on ``s``.
    """
    following = first_below(last, numbers)
    ends = np.empty(len(last), np.int64)
    for i in range(len(last) - 1, -1, -1):
        ends[i] = numbers[i] if following[i] == len(last) else ends[following[i]]
    least = np.minimum.accumulate(last)
    record = np.flatnonzero(np.concatenate([[True], least[1:] < least[:-1]]))
    # Up to the least ``last`` all join; then the records, from the last and least on, break the group.
    upto = np.concatenate([last[record][::-1], [np.iinfo(np.int64).max]])
    start = np.concatenate([[-1], ends[record][::-1]])
    same = np.concatenate([start[1:] != start[:-1], [True]])
    return upto[same], start[same]


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, table in _parts(batches):
        upto, start = step_function(table.column(0).to_numpy(), table.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([upto.tolist()], pa.list_(pa.int64())), pa.array([start.tolist()], pa.list_(pa.int64()))], ["part", "upto", "start"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``number, start, new`` of rows ``part, number, last, before``; ``before`` is the start that comes into the range."""
    for _, table in _parts(batches):
        numbers, last, before = (table.column(i).to_pylist() for i in range(3))
        start, out, new = before[0], [], []
        for number, seen in zip(numbers, last):
            new.append(start is None or seen < start)
            start = number if new[-1] else start
            out.append(start)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(out, pa.int64()), pa.array(list(map(int, new)), pa.int64())], ["number", "start", "new"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows that come sorted by their first column, a part at a time: its number, the other columns."""
    part, held = None, []
    for batch in batches:
        own = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b == a:
                continue
            if held and own[a] != part:
                yield part, pa.Table.from_batches(held)
                held = []
            part = int(own[a])
            held.append(batch.slice(a, b - a).select(list(range(1, batch.num_columns))))
    if held:
        yield part, pa.Table.from_batches(held)


def group_starts(rows: DataFrame, number: str, last: str) -> DataFrame:
    """``number, start`` for rows with unique rising ``number`` (0 or more): the row where the group of each began.

    A row joins the group before it if ``last``, a lesser number or -1, isn't less than that group's start, and else begins
    one. Ranges of rows say what they make of any start (:func:`step_function`); the driver goes through these functions,
    one of them at a time, for the start that comes into each range; then ranges are folded by themselves. No task has more
    than a range.
    """
    spark = rows.sparkSession
    given = in_ranges(rows.select(F.col(number).cast("long").alias("number"), F.col(last).cast("long").alias("last")), ["number"])
    dealt = given.repartition("__part").sortWithinPartitions("__part", "__at")
    functions = dealt.select("__part", "number", "last").mapInArrow(_functions, "part int, upto array<long>, start array<long>")
    start, befores = None, []
    for row in functions.orderBy("part").toLocalIterator():
        befores.append((row["part"], start))
        # Before the first row there is no group: any start that is greater than all ``last`` says so.
        at = bisect_left(row["upto"], start) if start is not None else len(row["upto"]) - 1
        start = row["start"][at] if row["start"][at] >= 0 else start
    known = F.broadcast(spark.createDataFrame(befores, "__p int, before long"))
    rows = given.join(known, F.col("__part") == F.col("__p")).repartition("__part").sortWithinPartitions("__part", "__at")
    return rows.select("__part", "number", "last", "before").mapInArrow(_starts, "number long, start long, new long")

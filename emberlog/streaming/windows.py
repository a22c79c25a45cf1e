"""Look-back windows of a stream, event by event, equal to those of a batch."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog.functions.lookback import sliding_moments

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as processors with several states ask for."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


#: Events of one entry of a list state, and entries of one call.
CHUNK_ROWS, CHUNKS = 10_000, 16


def _put(state, *columns: Sequence) -> None:
    """Let a list state hold the columns, in entries of bounded size."""
    entries = [tuple(list(c[i : i + CHUNK_ROWS]) for c in columns) for i in range(0, len(columns[0]), CHUNK_ROWS)]
    if not entries:
        state.clear()
        return
    state.put(entries[:CHUNKS])
    for i in range(CHUNKS, len(entries), CHUNKS):
        state.appendList(entries[i : i + CHUNKS])


def _held(state, columns: int) -> list[list]:
    out: list[list] = [[] for _ in range(columns)]
    for entry in state.get():
        for own, more in zip(out, entry):
            own += more
    return out


class _Trailing(StatefulProcessor):
    """Events wait until the watermark has passed them; then they are taken in order of time and id.

    A call to the state costs far more than the few events of a usual key, so a batch calls it a fixed number of times a key,
    however long the span of its events: it appends what comes without reading, and what waits, and what windows still reach, is read
    and written whole. That is what came within the lateness and a window. One timer a key says when its first waiting
    event is due. A key without events and state costs nothing.
    """

    def __init__(self, columns: Sequence[str], kinds: Sequence[type], window_us: int, history: int):
        self.columns, self.kinds, self.window, self.history = list(columns), list(kinds), max(1, window_us), history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<long>, id array<string>, own array<string>")
        self.past = handle.getListState("past", "us array<long>, own array<string>")
        self.due = handle.getValueState("due", "ms long")
        self.counts = handle.getValueState("counts", "last array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for pdf in rows:
            us = pdf["us"].tolist()
            self.waiting.appendValue((us, pdf["id"].tolist(), pdf["own"].tolist()))
            least = min(us) if least is None else min(least, min(us))
        if least is not None:
            at, before = least // 1000 + 1, self.due.get()
            if before is None or at < before[0]:
                if before is not None:
                    self.handle.deleteTimer(before[0])
                self.due.update((at,))
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(zip(*_held(self.waiting, 3)), key=lambda e: e[:2])
        ready = bisect_right(events, now, key=lambda e: e[0])
        _put(self.waiting, *(zip(*events[ready:]) if ready < len(events) else ((), (), ())))
        if ready < len(events):
            at = events[ready][0] // 1000 + 1
            self.due.update((at,))
            self.handle.registerTimer(at)
        else:
            self.due.clear()
        if ready:
            yield self._taken(key, events[:ready], now)

    def _taken(self, key, ready: list[tuple], now: int) -> pd.DataFrame:
        us, names = np.array([e[0] for e in ready], np.int64), [e[1] for e in ready]
        held, held_own = _held(self.past, 2)
        before = len(held)
        times = np.concatenate([np.array(held, np.int64), us])
        owns = [*held_own, *(e[2] for e in ready)]
        places = np.arange(before, len(times))
        starts = np.searchsorted(times, us - self.window, "left")
        same = np.zeros(len(us), np.int64)
        number: dict = {}
        codes = np.array([number.setdefault(o, len(number)) for o in owns], np.int64)
        for code in np.unique(codes[before:]):
            own = np.flatnonzero(codes == code)
            mine = codes[before:] == code
            same[mine] = np.searchsorted(own, places[mine]) - np.searchsorted(own, starts[mine])
        out = {"id": names, "us": us, "own": owns[before:], "before": places - starts, "same": same}
        if self.history:
            known = self.counts.get()
            last = list(known[0]) if known is not None else []
            values = np.array([*last, *(places - starts + 1)], float)
            ends = np.arange(len(last), len(values)) + 1
            n = np.minimum(ends, self.history)
            mean, spread = sliding_moments(values[None, :], ends - n, n)
            out |= {"n": n, "mean": mean[0], "dev": spread[0]}
            self.counts.update(([int(v) for v in values[-(self.history - 1) :]] if self.history > 1 else [],))
        else:
            out |= {"n": 0, "mean": 0.0, "dev": 0.0}
        # What comes later is after the watermark.
        kept = int(np.searchsorted(times, now - self.window, "left"))
        if kept < len(times) or before:
            _put(self.past, times[kept:].tolist(), owns[kept:])
        given = {c: [None if pd.isna(k) else kind(k)] * len(us) for c, k, kind in zip(self.columns, key, self.kinds)}
        return pd.DataFrame(given | out)


def trailing_counts(events: DataFrame, keys: Sequence[str], window_us: int, own: str | None = None, history: int = 0, late: str = "10 minutes") -> DataFrame:
    """Each event, once the watermark has passed it, with what a batch's look-back windows say of it.

    ``keys..., id, us, own, before, same, n, mean, dev``: ``before`` events of the same keys come before it, by time and id,
    in the last ``window_us`` microseconds (both ends included); ``same`` of them have the same ``own``. With ``history``,
    ``n``, ``mean`` and ``dev`` are the number, mean and population deviation of the last ``history`` counts of the key's
    events (``before`` + 1), its own included. ``keys`` are strings. What comes more than ``late`` behind is left out and counted as
    late. Start the stream under :func:`rocksdb`.
    """
    value = F.col(own).cast("string") if own else F.lit(None).cast("string")
    shaped = events.withWatermark("ts", late).select(*keys, F.col("id").cast("string").alias("id"), "us", value.alias("own"), "ts")
    schema = ", ".join(f"`{k}` string" for k in keys) + ", id string, us long, own string, before long, same long, n long, mean double, dev double"
    return shaped.groupBy(*keys).transformWithStateInPandas(_Trailing(keys, [str] * len(keys), window_us, history), schema, "append", "EventTime")


def threshold_hits(events: DataFrame, key: str, n: int, window_us: int, late: str = "10 minutes") -> DataFrame:
    """``key, id, us, n`` of each event that makes ``n`` or more in its key's trailing window: the batch rule, exactly."""
    counted = trailing_counts(events, [key], window_us, late=late)
    return counted.select(key, "id", "us", (F.col("before") + 1).alias("n")).filter(F.col("n") >= n)


def user_deviation(events: DataFrame, window_us: int = 3_600_000_000, least: int = 10, late: str = "10 minutes") -> DataFrame:
    """``id, us, user_id, event_type, deviation``: how rare an event's type was among the user's before it, as
    :func:`emberlog.operators.scoring.user_deviation` says of a batch. Events of no user score 0 at once."""
    known = F.coalesce(F.col("user_id"), F.lit("")) != ""
    counted = trailing_counts(events.filter(known), ["user_id"], window_us, "event_type", late=late)
    rare = F.greatest(F.lit(0.0), 1 - 5 * F.col("same") / F.greatest("before", F.lit(1)))
    scored = counted.select("id", "us", "user_id", F.col("own").alias("event_type"), F.when(F.col("before") >= least, rare).otherwise(0.0).alias("deviation"))
    return scored.unionByName(events.filter(~known).select(F.col("id").cast("string").alias("id"), "us", "user_id", "event_type", F.lit(0.0).alias("deviation")))


def frequency_anomaly(events: DataFrame, window_us: int = 60_000_000, history: int = 100, least: int = 20, late: str = "10 minutes") -> DataFrame:
    """``id, us, source, event_type, recent, frequency_score``, as :func:`emberlog.operators.scoring.frequency_anomaly` of a batch."""
    counted = trailing_counts(events, ["source", "event_type"], window_us, history=history, late=late)
    recent = F.col("before") + 1
    z = F.abs(recent - F.col("mean")) / (F.col("dev") + 1e-6)
    return counted.select("id", "us", "source", "event_type", recent.alias("recent"), F.when(F.col("n") >= least, F.least(F.lit(1.0), z / 5)).otherwise(0.0).alias("frequency_score"))

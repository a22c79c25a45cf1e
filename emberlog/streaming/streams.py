"""Streaming forms: event time, watermarks, and results that a restart repeats exactly."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.functions.normalize import normalize_logs
from emberlog.functions.storage import new_path
from emberlog.operators.correlation import PRIVILEGE_WORDS, SESSION_POINTS
from emberlog.sources.logs import split_valid


def ingest(lines: DataFrame, logs_path: str, quarantine_path: str, checkpoint: str, **normalize) -> StreamingQuery:
    """Normalise a stream of ``value`` lines into two tables. Each micro-batch owns a folder, so a repeated one replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Both tables are made of lines that are read and normalised once; what is kept for that goes with the batch.
        rows = normalize_logs(batch, **normalize).persist(StorageLevel.DISK_ONLY)
        try:
            ok, bad = split_valid(rows)
            ok.write.mode("overwrite").parquet(f"{logs_path}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        finally:
            rows.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding_counts(events: DataFrame, key: str, window: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Events per key and sliding window: the cheap form of the threshold rule (exact: ``windows.threshold_hits``)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by gap; one is given out when the watermark has passed its end."""
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


SESSION = "key string, start_us long, end_us long, n long, burst_activity boolean, privilege_escalation boolean, abnormal_duration boolean, impossible_travel boolean"
_STATE = "start long, end long, n long, burst boolean, privileged boolean, travel boolean, country string, country_us long, us array<long>, id array<string>, is_privileged array<boolean>, place array<string>"


def session_anomalies(events: DataFrame, timeout_us: int = 1_800_000_000, raw: str = "message", burst_per_minute: float = 60, travel_hours: float = 1500 / 700, late: str = "10 minutes") -> DataFrame:
    """Sessions as they close, with the four anomalies and the risk of a batch's ``session_summary``.

    Keys are address, user and host; an event with neither address nor user is a session by itself. Events wait in the
    key's state until the watermark has passed them, so that they are taken in order of time and id; a timer closes a
    session when the watermark has passed its end by the time-out. Sessions that are open when a stream stops stay in
    its checkpoint; an event of a later time closes them.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, n, burst, privileged, travel, country, country_us, *held = state.get if state.exists else (0, 0, 0, False, False, False, None, 0, [], [], [], [])
        waiting = list(zip(*map(list, held)))
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += [*zip(pdf["us"].tolist(), pdf["id"], pdf["privileged"].tolist(), pdf["country"])]
        waiting.sort(key=lambda e: e[:2])
        now, out = state.getCurrentWatermarkMs() * 1000, []

        def close() -> None:
            out.append((k[0], start, end, n, burst, privileged, (end - start) / 1e6 > 8 * 3600, travel))

        ready = bisect_right([e[0] for e in waiting], now)
        for us, _, is_privileged, place in waiting[:ready]:
            if n and us - end > timeout_us:
                close()
                n = 0
            if not n:
                start, burst, privileged, travel, country = us, False, False, False, None
            end, n = us, n + 1
            seconds = (end - start) / 1e6
            burst = burst or (seconds >= 1 and n / (seconds / 60) > burst_per_minute)
            privileged = privileged or bool(is_privileged)
            if place:
                travel = travel or (country not in (None, place) and (us - country_us) / 3.6e9 < travel_hours)
                country, country_us = place, us
        waiting = waiting[ready:]
        if n and not waiting and now > end + timeout_us:
            close()
            n = 0
        if n or waiting:
            state.update((start, end, n, burst, privileged, travel, country, country_us, *(list(c) for c in (zip(*waiting) if waiting else ([], [], [], [])))))
            due = waiting[0][0] if waiting else end + timeout_us
            state.setTimeoutTimestamp(max(due, now) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSION.split(", ")])

    text = F.lower(F.coalesce(F.nullif(F.col(raw), F.lit("")), "event_type", F.lit("")))
    privileged = F.lit(False)
    for w in PRIVILEGE_WORDS:
        privileged = privileged | text.contains(w)
    empty = (F.coalesce("ip_address", F.lit("")) == "") & (F.coalesce("user_id", F.lit("")) == "")
    key = F.concat_ws("|", F.coalesce("ip_address", F.lit("")), F.coalesce("user_id", F.lit("")), F.coalesce("host", F.lit("")), F.when(empty, F.col("id")))
    shaped = events.withWatermark("ts", late).select(key.alias("key"), "us", "id", privileged.alias("privileged"), F.coalesce("country", F.lit("")).alias("country"), "ts")
    found = shaped.groupBy("key").applyInPandasWithState(run, SESSION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    points = sum((F.when(F.col(c), v).otherwise(0.0) for c, v in SESSION_POINTS.items()), F.lit(0.0))
    return found.withColumn("risk", F.round(F.least(F.lit(10.0), points + F.least(F.lit(2.0), F.col("n") * 0.02)), 2))


def for_each_batch(stream: DataFrame, path: str, checkpoint: str, made: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run a batch plan on each micro-batch and write its rows below ``path``; a repeated batch replaces itself.

    What is stateless per event gives the same rows as in one batch, whatever joins and groups by event it uses.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicate(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key, as long as the watermark holds it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def with_baseline(events: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """A stream beside a batch table of usual behaviour (bounded state): rows of keys without one have nulls."""
    return events.join(baseline, keys, "left")


def metrics(events: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Events a second per sliding window."""
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.end").alias("at"), (F.col("n") / seconds).alias("per_second"))


class LateRows(StreamingQueryListener):
    """Counts rows that came after the watermark and were left out, over all batches of all queries since it was added:
    ``rows[query id]``. A batch leaves out what is behind the watermark of the batch before it. Add it with ``spark.streams.addListener`` before a query starts."""

    def __init__(self):
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        dropped = sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)
        self.rows[str(event.progress.id)] = self.rows.get(str(event.progress.id), 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were left out, over the batches whose progress the query still holds
    (``spark.sql.streaming.numRecentProgressUpdates``); :class:`LateRows` counts all."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, each batch written to its own folder, and read the last state of it."""
    spark = stream.sparkSession
    path, last = new_path(spark, name), {"id": 0}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        # What is written tells whether there was anything: to ask the batch is to run it, and its state, once more.
        if mode == "complete" and not spark.read.schema(stream.schema).parquet(f"{path}/batch={batch_id}").isEmpty():
            last["id"] = batch_id

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", new_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    got = spark.read.schema(stream.schema).parquet(f"{path}/batch={last['id']}" if mode == "complete" else path)
    return got.select(stream.columns)

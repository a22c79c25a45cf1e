"""Memory of Python workers, which serve one task after another and keep what their allocators have got."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of a batch of whole texts that goes to a Python worker, where many would only wait there.
TEXT_ROWS = 512
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What is written inside goes to Python workers in batches of at most ``rows``: a batch lies in the JVM and in the
    worker as a whole. The session's setting is put back after."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def give_back() -> None:
    """Return to the system what a task has freed: to be called where its last batch is done."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def gathered(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of the string column ``at``: what repeats in a batch is worked out once."""
    held, bytes_ = [], 0
    for batch in batches:
        held.append(batch)
        bytes_ += batch.column(at).nbytes
        if bytes_ >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, bytes_ = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()

"""A uniform shuffle into shards of exact size through a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.storage import stage
from emberlog.llm.names import unused

#: Rows of one shard that one task permutes after the exchange, about.
BUCKET_ROWS = 4096
#: Partitions whose row counts every worker holds, 8 bytes each; 100 TB in parts of 128 MB are 0.8 million. More are merged.
MOST_PARTITIONS = 8_000_000
_POSITION = (1 << 33) - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good; also for totals beyond numpy's limit of a thousand million.

    There, the distribution is written out around its mode, 12 standard deviations to each side.
    """
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(draws, good)
    mode = (draws + 1) * (good + 1) // (total + 2)
    wide = 10 + int(12 * math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))))
    low, high = max(low, mode - wide), min(high, mode + wide)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def split_counts(rng: np.random.Generator, counts: list[int], draws: int) -> list[int]:
    """``draws`` without replacement from ``counts`` of each colour: how many of each."""
    left, out = sum(counts), []
    for n in counts:
        got = hypergeometric(rng, n, left - n, draws) if n and draws else 0
        out.append(got)
        left, draws = left - n, draws - got
    return out


def shard_sizes(rows: int, shards: int, seed: int) -> list[int]:
    """Sizes at most one apart; the shards that get one more are drawn too."""
    extra = set(np.random.default_rng([seed, 0]).permutation(shards)[: rows % shards].tolist())
    return [rows // shards + (s in extra) for s in range(shards)]


def matrix_row(before: np.ndarray, sizes: list[int], part: int, seed: int) -> list[int]:
    """Rows that partition ``part`` sends to each shard; ``before`` has the rows before each partition, and all rows last.

    The matrix is drawn down a binary tree of partition ranges: at each node, how many of its shards' rows come from
    the left half. Each draw's seed is its range, so every task that walks by draws the same, and no one needs the
    whole matrix.
    """
    low, high, counts = 0, len(before) - 1, list(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        left = split_counts(np.random.default_rng([seed, 1, low, high]), counts, int(before[middle] - before[low]))
        if part < middle:
            high, counts = middle, left
        else:
            low, counts = middle, [c - x for c, x in zip(counts, left)]
    return counts


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: a uniformly random order cut into ``shards`` of sizes at most one apart.

    The rows are written to the shared folder with their partition and place in it, so every later read agrees on both,
    whatever executors are lost. How many rows of each partition go to each shard is drawn from the one distribution
    that a uniform permutation has; each partition's rows are permuted against those counts, exchanged, and permuted
    again in their shard, in buckets of about ``bucket_rows`` by a random key whose counts give the places. Slots run
    from 0 in each shard. One full exchange; no column's values matter, so null, repeated, empty and hot ones are like
    any other. No rows: none. Columns of ``docs`` named ``shard`` or ``slot`` are replaced; other names never clash.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    part, at, key, bucket, nth, base, to, of = unused([*kept, "shard", "slot"], "part", "at", "key", "bucket", "nth", "base", "to", "of")
    place = F.monotonically_increasing_id()
    rows = stage(docs.select(*(f"`{c}`" for c in kept), F.shiftright(place, 33).alias(part), place.bitwiseAND(F.lit(_POSITION)).alias(at)), "shards")
    found = rows.groupBy(part).agg(F.count("*").alias("n")).toArrow()
    if found.num_rows > MOST_PARTITIONS:
        return shard_rows(rows.select(*(f"`{c}`" for c in kept)).coalesce(MOST_PARTITIONS), shards, seed, bucket_rows)
    parts = found.column(0).to_numpy()
    counts = np.zeros(int(parts.max(initial=-1)) + 1, np.int64)
    counts[parts] = found.column(1).to_numpy()
    before = np.concatenate([[0], np.cumsum(counts)])
    total = int(before[-1])
    sizes = shard_sizes(total, shards, seed)
    held = docs.sparkSession.sparkContext.broadcast(before)

    @F.pandas_udf("int")
    def shard_of(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        @lru_cache(maxsize=4)  # kept from one batch of the task to the next
        def labels(p: int) -> np.ndarray:
            own = np.repeat(np.arange(shards, dtype=np.int32), matrix_row(held.value, sizes, p, seed))
            return np.random.default_rng([seed, 2, p]).permutation(own)

        for p, i in columns:
            p, i = p.to_numpy(), i.to_numpy()
            out = np.empty(len(p), np.int32)
            for value in np.unique(p).tolist():
                mine = p == value
                out[mine] = labels(value)[i[mine]]
            yield pd.Series(out)

    buckets = max(1, -(-total // (shards * bucket_rows)))
    own_bucket = F.pmod(F.shiftright(F.xxhash64(F.lit(seed), part, at), 16), F.lit(buckets))
    dealt = rows.withColumn("shard", shard_of(part, at)).withColumn(key, F.xxhash64(F.lit(seed), part, at)).withColumn(bucket, own_bucket)
    # The same labels, from the two narrow columns alone: only counts are exchanged.
    earlier = Window.partitionBy(to).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.select(shard_of(part, at).alias(to), own_bucket.alias(of)).groupBy(to, of).agg(F.count("*").alias("n"))
    bases = sized.select(to, of, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(base))
    within = Window.partitionBy("shard", bucket).orderBy(key, part, at)
    slotted = dealt.withColumn(nth, F.row_number().over(within) - 1).join(bases, (F.col("shard") == F.col(to)) & (F.col(bucket) == F.col(of)))
    return slotted.select(*(f"`{c}`" for c in kept), "shard", (F.col(base) + F.col(nth)).alias("slot"))

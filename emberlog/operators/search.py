"""Searches and counts over logs, alerts and incidents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, equal: Mapping[str, object] | None = None, start: str | None = None, end: str | None = None, any_tag: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """Rows that meet all given conditions, newest first; a list as a value means any of it."""
    for name, value in (equal or {}).items():
        df = df.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    if start:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col("ts") < F.lit(end).cast("timestamp"))
    if any_tag:
        df = df.filter(F.arrays_overlap("tags", F.array(*map(F.lit, any_tag))))
    return df.orderBy(F.desc("us"), tie)


def paginate(df: DataFrame, page: int, size: int, order: Sequence[Column]) -> DataFrame:
    """One page of a total order with ``total``, ``pages``, ``has_next``, ``has_prev``."""
    total = df.count()
    pages = -(-total // size)
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.select("*", F.lit(total).alias("total"), F.lit(pages).alias("pages"), F.lit(page < pages).alias("has_next"), F.lit(page > 1).alias("has_prev"))


def severity_distribution(df: DataFrame) -> DataFrame:
    """Rows per severity, in lower case."""
    return df.groupBy(F.lower(F.coalesce("severity", F.lit("unknown"))).alias("severity")).agg(F.count("*").alias("n"))


def kpis(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row of counts: critical and high alerts, all alerts, incidents."""
    counted = alerts.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.count("*").alias("alerts"))
    return counted.join(F.broadcast(incidents.agg(F.count("*").alias("incidents"))), F.lit(True))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``name, n``: the rows of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order."""
    return df.orderBy(*order).limit(n)

"""A bounded sample of documents that doesn't depend on how their files are laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.storage import stage

#: Rows that pass for each that is asked for, and how the share grows where most of them repeat.
SPARE, GROWTH = 8.0, 32


def sample_texts(docs: DataFrame, rows: int, seed: int) -> DataFrame:
    """``text`` (null: empty) of at most ``rows`` of ``docs(doc_id, text)``: those with the least seeded hash of both.

    Rows that repeat count once, however often they do: the sample is the same. A share of all rows, several times as many
    as asked for, passes before any are compared; where repeats leave too few distinct ones, the share grows and another
    pass follows. The sample is written to the shared folder and no text reaches the driver. Null ids are ids like
    others; no rows give none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), text)
    share = min(1.0, SPARE * rows / max(docs.count(), 1))
    while True:
        low = int(share * 2**64) - 2**63
        few = docs.select(text.alias("text"), hashed.alias("h")).filter(F.col("h") < low if share < 1 else F.lit(True))
        found = stage(few.groupBy("h").agg(F.first("text").alias("text")), "sample-rows")
        if share == 1 or found.count() >= rows:
            return stage(found.orderBy("h").limit(rows).select("text"), "sample")
        share = min(1.0, share * GROWTH)

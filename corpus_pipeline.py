"""A training-corpus pipeline: each stage is one operator of ``emberlog.llm`` over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.functions.storage import stage
from emberlog.llm.decontaminate import drop_contaminated
from emberlog.llm.near_copies import drop_near_copies
from emberlog.llm.packing import pack_documents
from emberlog.llm.quality import keep_quality
from emberlog.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts have no words and go; rows that repeat share a
    verdict; other columns, whatever their names, stay as they are; no rows give none."""
    return keep_quality(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id: texts whose five-word shingles
    have a Jaccard similarity of 0.8 or more are linked. Of rows that share an id the first read stays; rows without an
    id stay only if none of their group has one; null and empty texts are equal; no rows give none."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null and empty texts hold none; rows that repeat go or stay alike; an
    empty benchmark keeps all; no rows give none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays. Null texts stay null, empty ones empty; rows that
    repeat are changed alike; no rows give none."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of a document gets its sequence and its place in it. Null and empty texts are one id; rows that repeat
    are packed each; null ids stay null; other columns are left out; no rows give none."""
    return pack_documents(docs, text_bytes=PACKED_BYTES)


#: Packing follows stages whose memory the executors still hold, so fewer texts are encoded together than by itself.
PACKED_BYTES = 2 << 20

STAGES = [("quality rules", quality), ("near-dedup", dedup), ("decontamination", decontaminate), ("secret scan", secrets), ("packing", packing)]

#: The stages run a tokenizer, a search over fingerprints and models fitted on the data: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"stage-{i + 1}")
    return docs

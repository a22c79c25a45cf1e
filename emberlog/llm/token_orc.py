"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.storage import new_path, stage
from emberlog.llm.memory import give_back
from emberlog.llm.tokens import DEFAULT_TOKENIZER, encoder, slabs


#: Texts are encoded together up to so many bytes: a word that many of them have is encoded once, and a worker holds about
#: twenty times as much.
ENCODED_BYTES = 8 << 20


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.uint32(end_id).tobytes()
        for batch in batches:
            for begin, texts in slabs(batch.column(1), ENCODED_BYTES):
                got = coder.encode_batch(texts, end)
                ids = pa.ListArray.from_arrays(np.concatenate([[0], got.ends]).astype(np.int32), pa.array(got.ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), ids], ["doc_id", "ids"])
        give_back()

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 0, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Encode ``docs(doc_id, text)`` and write ``(doc_id, ids)`` to ORC files in ascending ``doc_id`` order.

    Texts are dealt by ranges of ``doc_id`` first and encoded after: a text is smaller than its ids. A file holds one
    range; in it, rows ascend, so that stripe and row-group statistics on ``doc_id`` hardly overlap and the Bloom filter
    settles the rest of a point lookup. Null text: the end id alone. Null ids: before all others. Rows of one id keep
    the order in which they are read, and may be dealt over several files that follow each other. No rows: no data
    files. Other columns are left out.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("nth")]
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("nth"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(_encode(tokenizer, end_id), "doc_id long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.encoding.strategy", "COMPRESSION")
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, ids)``; a filter on ``doc_id`` skips files' stripes and row groups by their statistics and Bloom filters.

    Null and repeated ids come back as they were written, a row each; no files of that kind give no rows."""
    return spark.read.schema("doc_id long, ids array<int>").option("pathGlobFilter", "*.orc").orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        ends, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64()), *batch.columns[2:]], ["doc_id", "n_tokens", "ids_crc32", "file", "split", "row"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it when the files are read one after another by their numbers, each
    from its first row to its last: also among rows of one ``doc_id``, or without one, it is the place where the ids are.
    Only a row per file meets in one task. No files: no rows.
    """
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")]
    read = read_token_orc(spark, path).select("doc_id", "ids", *place)
    rows = stage(read.mapInArrow(_digest, "doc_id long, n_tokens long, ids_crc32 long, file string, split long, row long"), "token-index")
    number = [F.regexp_extract("file", r"part-(\d+)-", 1).cast("long"), F.regexp_extract("file", r"\.c(\d+)\.", 1).try_cast("long")]
    before = Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A split is read by one task, from its first row to its last.
    within = Window.partitionBy("file").orderBy("split", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(files, "file")
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_orc_index(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Write ``docs`` with :func:`write_token_orc` below the shared folder and return :func:`token_index` of the files."""
    path = new_path(docs.sparkSession, "token-orc")
    write_token_orc(docs, path, tokenizer)
    return token_index(docs.sparkSession, path)

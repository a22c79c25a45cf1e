"""Reading, splitting, quarantining and writing logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.normalize import normalize_logs

GLOB = "*.{log,txt,json,csv}"
# The keys under which a webhook's list stands, and header words that are dropped.
WEBHOOK_LISTS = ("events", "logs", "records", "data", "alerts")
SENSITIVE_HEADERS = "authorization|cookie|api-key|token|secret"


def read_log_files(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """``value, source``: the non-blank lines of all matching files below ``path``; the source is the file's stem."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return df.select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("source")).filter(F.trim("value") != "")


def stream_log_files(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """The same as a stream: each new file is read once, which the query's checkpoint remembers."""
    df = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return df.select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("source")).filter(F.trim("value") != "")


def ingest_payloads(df: DataFrame, data: str = "data", format: str = "format") -> DataFrame:
    """``df`` once for each record of its payload: JSON lists fan out, other text by lines; ``nth`` counts them from 0."""
    listed = F.from_json(F.col(data), "array<string>")
    lines = F.filter(F.split(F.col(data), r"\R"), lambda x: F.trim(x) != "")
    is_list = (F.col(format).isin("json", "auto")) & F.trim(F.col(data)).startswith("[")
    parts = F.when(is_list, listed).when((F.col(format) == "json") | ((F.col(format) == "auto") & F.trim(F.col(data)).startswith("{")), F.array(data)).otherwise(lines)
    return df.select("*", F.posexplode(parts).alias("nth", "value"))


def unnest_webhook(df: DataFrame, body: str = "body", headers: str | None = None) -> DataFrame:
    """``df`` once for each item of the first list found in its JSON body, or once with the body; sensitive headers go."""
    lists = [F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>") for k in WEBHOOK_LISTS]
    out = df.select("*", F.explode(F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), F.array(body))).alias("value"))
    return out if headers is None else out.withColumn(headers, F.map_filter(headers, lambda k, v: ~F.lower(k).rlike(SENSITIVE_HEADERS)))


def split_valid(df: DataFrame, error: str = "parse_error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return df.filter(F.col(error).isNull()), df.filter(F.col(error).isNotNull())


def to_quarantine(bad: DataFrame, raw: str = "raw_log", attempts: int = 1) -> DataFrame:
    """Quarantine rows: an id from the record, the record, its error, attempts, and when."""
    return bad.select(F.sha2(F.col(raw), 256).alias("entry_id"), F.col(raw).alias("record"), F.col("source"), F.col("parse_error").alias("error"), F.lit(attempts).alias("attempts"), F.current_timestamp().alias("failed_at"))


def quarantine_snapshot(entries: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The newest ``n`` entries with the first 200 characters of their record."""
    return entries.orderBy(*order).limit(n).withColumn("preview", F.substring("record", 1, 200))


def replay_quarantine(entries: DataFrame, n: int, order: Sequence[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Try the oldest ``n`` entries again: (rows that now parse, entries that failed again, entries left alone)."""
    tried = entries.orderBy(*order).limit(n)
    parsed = normalize_logs(tried.select("entry_id", "attempts", F.col("record").alias("value"), "failed_at"))
    ok, bad = split_valid(parsed)
    again = bad.select("entry_id", F.col("raw_log").alias("record"), "source", F.col("parse_error").alias("error"), (F.col("attempts") + 1).alias("attempts"), "failed_at")
    return ok, again, entries.join(tried.select("entry_id"), "entry_id", "left_anti")


def batch_receipt(df: DataFrame, batch: str, error: str = "parse_error") -> DataFrame:
    """Per batch: accepted and rejected rows, and rejected ones by error."""
    kinds = df.groupBy(batch, F.coalesce(error, F.lit("")).alias("error")).agg(F.count("*").alias("n"))
    own = F.array_sort(F.collect_list(F.when(F.col("error") != "", F.concat_ws("=", "error", "n"))))
    return kinds.groupBy(batch).agg(F.sum(F.when(F.col("error") == "", F.col("n")).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("error") != "", F.col("n")).otherwise(0)).alias("rejected"), F.array_join(own, ",").alias("errors"))


def write_partitioned(df: DataFrame, path: str, time: str = "ts") -> None:
    """Append to Parquet partitioned by day."""
    df.withColumn("event_date", F.to_date(time)).write.mode("append").partitionBy("event_date").parquet(path)


def current_view(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), F.struct(*order)).alias("r")).select(key, "r.*")


def load_reference_table(spark: SparkSession, path: str, builtin: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A stored table over a built-in one: stored rows take the place of built-in ones with equal keys."""
    both = spark.read.parquet(path).withColumn("__rank", F.lit(0)).unionByName(builtin.withColumn("__rank", F.lit(1)))
    return both.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy("__rank"))).filter("__nth = 1").drop("__rank", "__nth")

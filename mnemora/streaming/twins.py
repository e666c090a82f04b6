"""Streams over files: counts by day, pending counters, captures, ingestion; all with the batch operators' meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.shared import scratch


def file_stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """A stream of the Parquet files at a path, a file or a folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    single = path.endswith(".parquet")
    return reader.option("pathGlobFilter", name if not _is_folder(spark, path) else "*.parquet").parquet(path if _is_folder(spark, path) else folder) if single else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    from mnemora.shared import hadoop

    fs, p = hadoop(spark, path)
    return fs.getFileStatus(p).isDirectory()


def daily_counts(events: DataFrame) -> DataFrame:
    """Counts in windows of a day of the ``ts`` column."""
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def pending_counts(observations: DataFrame, key: str = "user_id", ident: str = "event_id") -> DataFrame:
    """Counters that outlive micro-batches: sightings and the first of each key."""
    return observations.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("first_id"))


def new_captures(captures: DataFrame, forgotten: DataFrame, delay: str = "1 day") -> DataFrame:
    """Captures (id, ts, ...) once each, without those that are forgotten (a static table)."""
    return captures.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"]).join(forgotten.select("id"), "id", "left_anti")


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands all that is there to a function by micro-batches; what a checkpoint has seen is not read again."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def finished(spark: SparkSession, sf_dir: str, table: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of a plan over a table read as a stream, when all files are read: the last complete output, as a table."""
    out, last = scratch(spark, "stream"), []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{n}")
        last.append(n)

    q = plan(file_stream(spark, f"{sf_dir}/{table}.parquet")).writeStream.outputMode("complete").foreachBatch(keep)
    q.option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/{max(last)}")


def incremental(spark: SparkSession, path: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Files that arrived since the last run, as upserts: at least once, so each must be idempotent by key."""
    run_once(file_stream(spark, path), each, checkpoint)

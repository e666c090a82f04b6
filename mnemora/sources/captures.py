"""The spool of captured memories: JSON lines, a file for each UTC day, with tombstones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.text import memory_id

ENTRY = "kind string, id string, ts string, title string, content string, importance double, scope string, tags array<string>, reason string"


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """entries, tombstones and errors (file, line) of a spool, in the order of file name and line."""
    raw = spark.read.text(folder, pathGlobFilter="*.json*", recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value"))
    raw = raw.filter(F.trim("value") != "")
    rows = raw.withColumn("x", F.from_json("value", ENTRY + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("x._corrupt").isNotNull() | F.col("x.id").isNull() | F.col("x.ts").isNull()
    good = rows.filter(~bad).select("file", "at", *[f"x.{c.split()[0]}" for c in ENTRY.split(", ")])
    return {
        "entries": good.filter(F.coalesce("kind", F.lit("memory")) != "tombstone"), "tombstones": good.filter(F.col("kind") == "tombstone").select("id", "ts", "reason"),
        "errors": rows.filter(bad).select("file", "at", "value"),
    }


def append(entries: DataFrame, folder: str) -> None:
    """Adds entries as JSON lines, in a folder for each day of their ts."""
    entries.withColumn("day", F.substring("ts", 1, 10)).write.mode("append").partitionBy("day").json(folder)


def canonical_ids(entries: DataFrame) -> DataFrame:
    """Entries whose malformed ids are replaced by ones made of id and time."""
    good = F.col("id").rlike(r"^mem_[0-9a-f]{12}\z")
    return entries.withColumn("id", F.when(good, F.col("id")).otherwise(memory_id(F.col("id"), F.lit("|"), F.col("ts"))))

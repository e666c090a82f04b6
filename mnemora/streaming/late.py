"""Sightings that come late, out of order or twice: kept right by state for each key.

A key's summary (sightings, first and last time) follows event time, not the order of arrival. Each change of it is two rows of
a change log: the summary that is superseded, taken back, and the one in its place. Spark's own deduplication holds ids against a second
delivery for as long as the watermark lets one in; event-time timers mark keys that have long been silent. State lies in the checkpoint, so a restarted stream goes on
where it was; a batch that is replayed writes its part of the log anew, in place of the first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from mnemora.shared import ship

#: The state store that ``transformWithState`` needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SUMMARY = StructType([*[StructField(c, LongType()) for c in ("n", "first_seen", "last_reinforced", "seq")], StructField("dormant", BooleanType())])
LOG = "key string, change string, n long, first_seen timestamp, last_reinforced timestamp, dormant boolean, seq long"


class Sightings(StatefulProcessor):
    """Sums up the sightings of a key, each of which comes once: one read, one write and one timer a key and batch, however many there are. silent_ms: a key that long without a sighting is dormant until the next."""

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", SUMMARY)

    def _log(self, key: str, old, new):
        import pandas as pd

        def row(change: str, s) -> tuple:
            return (key, change, s[0], pd.Timestamp(s[1], unit="us"), pd.Timestamp(s[2], unit="us"), s[4], s[3])

        return pd.DataFrame([*([row("-", old)] if old else []), row("+", new)], columns=["key", "change", "n", "first_seen", "last_reinforced", "dormant", "seq"])

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        old = self.summary.get()
        old = tuple(old) if old else None
        n, first, last, seq, dormant = old or (0, None, None, 0, False)
        for pdf in rows:
            low, high = int(pdf["at"].min()), int(pdf["at"].max())
            n += len(pdf)
            first, last = (low if first is None else min(first, low)), (high if last is None else max(last, high))
        dormant = dormant and last == old[2]
        new = (n, first, last, seq + 1, dormant)
        self.summary.update(new)
        if not old or last != old[2]:
            self.handle.registerTimer((last + 1000 * self.silent_ms) // 1000 + 1)  # the millisecond after that instant
        yield self._log(str(key[0]), old, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = 1000 * expiredTimerInfo.getExpiryTimeInMs()
        old = tuple(self.summary.get())
        if not old[4] and old[2] + 1000 * self.silent_ms < now:
            new = (*old[:3], old[3] + 1, True)
            self.summary.update(new)
            yield self._log(str(key[0]), old, new)

    def close(self) -> None:
        pass


def change_log(sightings: DataFrame, delay: str = "7 days", silent: str = "30 days") -> DataFrame:
    """The change log of a stream (key, id, ts): rows '+' as they come to hold and '-' as they cease to. Sightings more than the delay behind the latest are dropped, as the watermark says."""
    spark = sightings.sparkSession
    ship(spark)
    spark.conf.set(*PROVIDER)
    ms = int(spark.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {silent}")) / 1000).cast("long")).first()[0])
    s = sightings.select(F.col("key").cast("string").alias("key"), F.col("id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts")).filter("key is not null and id is not null and ts is not null")
    s = s.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key", "id"]).select("key", "ts", F.unix_micros("ts").alias("at"))
    return s.groupBy("key").transformWithStateInPandas(Sightings(ms), outputStructType=LOG, outputMode="Append", timeMode="EventTime")


def keep(log: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a change log to a table, a folder a batch, until the stream's input is read; a batch that runs twice is there once."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def holding(spark: SparkSession, path: str) -> DataFrame:
    """The rows that hold at the end of a change log: of each key the latest one put in place. Equals what is left when rows taken back cancel those put in."""
    log = spark.read.schema(f"{LOG}, batch long").parquet(path).filter("change = '+'")
    last = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("key", "n", "first_seen", "last_reinforced", "dormant", "seq")

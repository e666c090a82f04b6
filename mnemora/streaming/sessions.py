"""Sessions on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.config import CHUNK_GAP_MINUTES


def gap_sessions(events: DataFrame, gap_minutes: int = CHUNK_GAP_MINUTES) -> DataFrame:
    """(user_id, events, started): an event exactly a gap later still belongs to the session, as in batch."""
    # the window ends before start + gap; one microsecond more takes in the event at the gap itself
    window = F.session_window("ts", f"{gap_minutes} minutes 1 microseconds")
    return events.groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started")).drop("w")

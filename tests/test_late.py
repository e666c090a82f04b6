"""Late, repeated and reordered sightings, with restarts, against the plain result."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemora.plans import catalog
from mnemora.streaming import late, twins

T0 = datetime.datetime(2026, 1, 1)
DDL = "key string, id long, ts timestamp"


def sightings(n=60):
    rng = random.Random(2)
    return [(rng.choice("abcde"), i, T0 + datetime.timedelta(hours=rng.randint(0, 200), minutes=rng.randint(0, 59))) for i in range(n)]


def plain(rows):
    out: dict = {}
    for key, ident, at in set(rows):
        out.setdefault(key, []).append(at)
    return {k: (len(v), min(v), max(v)) for k, v in out.items()}


def feed(spark, folder, parts, first):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{folder}/{first + i:03d}.parquet")


def run(spark, tmp_path, **k):
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    late.keep(late.change_log(stream, **k), str(tmp_path / "log"), str(tmp_path / "state"))


@pytest.mark.parametrize("order", ["in order", "reversed", "shuffled"])
def test_any_order_and_a_restart_give_the_same(spark, tmp_path, order):
    rows = sorted(sightings(), key=lambda r: r[2])
    if order == "reversed":
        rows.reverse()
    elif order == "shuffled":
        random.Random(7).shuffle(rows)
    parts = [rows[:20] + rows[:3], rows[20:40] + rows[5:15], rows[40:] + rows[38:42]]  # some come twice, in one file or a later one
    feed(spark, tmp_path / "in", parts[:2], 0)
    run(spark, tmp_path, delay="10 days", silent="30 days")
    feed(spark, tmp_path / "in", parts[2:], 2)
    run(spark, tmp_path, delay="10 days", silent="30 days")  # from the checkpoint
    got = {r["key"]: (r["n"], r["first_seen"], r["last_reinforced"]) for r in late.holding(spark, str(tmp_path / "log")).collect()}
    assert got == plain(rows)
    # the log by itself: what is taken back cancels what was put in, and one row a key is left
    left = Counter()
    for r in spark.read.parquet(str(tmp_path / "log")).collect():
        left[r["key"], r["n"], r["first_seen"], r["last_reinforced"], r["seq"]] += 1 if r["change"] == "+" else -1
    assert {k[0]: k[1:4] for k, n in left.items() if n} == plain(rows) and set(left.values()) <= {0, 1}


def test_timers_mark_the_silent_and_forget_ids(spark, tmp_path):
    hour = lambda h: T0 + datetime.timedelta(hours=h)
    feed(spark, tmp_path / "in", [[("a", 1, hour(0)), ("b", 2, hour(1))], [("b", 3, hour(30))], [("b", 4, hour(60))]], 0)
    run(spark, tmp_path, delay="5 hours", silent="10 hours")
    rows = {r["key"]: (r["n"], r["dormant"]) for r in late.holding(spark, str(tmp_path / "log")).collect()}
    assert rows == {"a": (1, True), "b": (3, False)}
    feed(spark, tmp_path / "in", [[("a", 5, hour(61)), ("a", 9, hour(2))]], 3)
    run(spark, tmp_path, delay="5 hours", silent="10 hours")
    rows = {r["key"]: (r["n"], r["last_reinforced"], r["dormant"]) for r in late.holding(spark, str(tmp_path / "log")).collect()}
    assert rows["a"] == (2, hour(61), False)  # what came behind the watermark is dropped


def test_query(spark, sf_dir, same):
    same(catalog.QUERIES["stream_late_events"](spark, sf_dir), catalog.ORACLES["stream_late_events"])


def test_empty_and_null_rows(spark, tmp_path):
    feed(spark, tmp_path / "in", [[(None, 1, T0), ("a", None, T0), ("a", 1, None)]], 0)
    run(spark, tmp_path)
    assert late.holding(spark, str(tmp_path / "log")).count() == 0


def test_a_key_costs_a_few_calls_of_its_state_however_many_its_sightings(spark, tmp_path):
    """One read, one write and one timer a key and batch; ids are held by Spark's deduplication, not call by call."""
    import pandas as pd

    calls: list = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, new):
            calls.append("update")
            self.held = new

    class Handle:
        def getValueState(self, *a):
            return State()

        def registerTimer(self, at):
            calls.append(at)

    p = late.Sightings(1000)
    p.init(Handle())
    out = list(p.handleInputRows(("a",), iter([pd.DataFrame({"at": range(1_000_000, 1_005_000)}), pd.DataFrame({"at": [7]})]), None))
    assert calls == ["get", "update", 1_004_999 // 1000 + 1000 + 1] and p.summary.held == (5001, 7, 1_004_999, 1, False)
    assert [len(x) for x in out] == [1]
    stream = spark.readStream.schema(DDL).parquet(str(tmp_path))
    plan = late.change_log(stream)._jdf.queryExecution().analyzed().toString()
    assert plan.index("TransformWithState") < plan.index("DeduplicateWithinWatermark")

"""Tables by key as a sorted base and small deltas: upserts and deletes write what changes, reads merge, compaction folds in.

A run is an immutable Parquet folder of whole rows with two more columns: ``_p``, the partition that Spark's own hash
partitioning gives the key (or the part of it that rows are dealt by) among ``parts``, and ``_gone``, true where the row only says that its key is deleted. The
files of a run hold contiguous ranges of ``_p`` and are sorted by it and the key; a base also has a list of its
files with their ranges, so that a key opens one file. The newest run that names a key decides it.

A table's state is a small JSON value: ``{"base": run or None, "deltas": [run, ...]}``, a run being its path, ``parts``,
bytes, the version of the schema it was written in, and, of a base, the path of its list of files. Whoever holds the state commits it;
nothing here overwrites a file. The rows of one delta should name a key once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from mnemora.shared import drop_path, hadoop

#: A base is rewritten when its deltas have this share of its bytes (or of FLOOR, where it is smaller); deltas are folded when there are more than so many.
SHARE, FLOOR, DELTAS = 0.25, 1 << 20, 8
#: Beyond so many files a lookup reads the whole base.
LOOKED_UP = 256

State = dict
EMPTY: State = {"base": None, "deltas": []}


def runs(state: State) -> list[dict]:
    return [*([state["base"]] if state["base"] else []), *state["deltas"]]


class KeyedTable:
    """One table's runs. schema: what reads give; keys: columns that tell rows apart; by: those of them that rows are dealt and looked up by (all of them, if not given); upgrade(rows, version): rows of an older schema brought to the present one."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: StructType, keys: tuple[str, ...], version: int = 0, upgrade: Callable[[DataFrame, int], DataFrame] | None = None, by: tuple[str, ...] = ()):
        self.spark, self.folder, self.name, self.schema, self.keys = spark, folder, name, schema, tuple(keys)
        self.by = tuple(by) or self.keys
        self.version, self.upgrade = version, upgrade or (lambda rows, version: rows)

    # writing

    def _parts(self) -> int:
        conf = self.spark.conf
        return int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions"))

    def _run(self, rows: DataFrame, sizes: bool = False) -> dict:
        parts = self._parts()
        path = f"{self.folder}/{self.name}-{uuid.uuid4().hex}"
        p = F.pmod(F.hash(*self.by), F.lit(parts))
        # adaptive execution joins neighbouring partitions to files of its advisory size, so each has a contiguous range
        rows.withColumn("_p", p).repartition(*self.by).sortWithinPartitions("_p", *self.by, *[k for k in self.keys if k not in self.by]).write.parquet(path)
        fs, at = hadoop(self.spark, path)
        run = {"path": path, "parts": parts, "bytes": fs.getContentSummary(at).getLength(), "schema": self.version}
        if sizes:
            run["files"] = f"{path}-files"
            own = self.spark.read.parquet(path)
            own.groupBy(F.input_file_name().alias("file")).agg(F.min("_p").alias("low"), F.max("_p").alias("high"), F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(run["files"])
        return run

    def _whole(self, rows: DataFrame, gone: bool = False) -> DataFrame:
        kinds = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        return rows.select(*kinds, F.lit(gone).alias("_gone"))

    def replaced(self, rows: DataFrame) -> State:
        """The state after rows take the place of all there are."""
        return {"base": self._run(self._whole(rows), sizes=True), "deltas": []}

    def changed(self, state: State, rows: DataFrame | None = None, gone: DataFrame | None = None) -> State:
        """The state after rows replace those of equal keys, and the rows of the keys in gone are deleted. A key in both stays, with its new row."""
        delta = None
        if not runs(state):  # the first rows are the base
            return state if rows is None else self.replaced(rows)
        if gone is not None:
            delta = self._whole(gone.select(*self.keys).distinct(), gone=True)
            delta = delta if rows is None else delta.join(rows.select(*self.keys), list(self.keys), "left_anti").select(delta.columns)
        if rows is not None:
            delta = self._whole(rows) if delta is None else self._whole(rows).unionByName(delta)
        return state if delta is None else {"base": state["base"], "deltas": [*state["deltas"], self._run(delta)]}

    # reading

    def _raw(self, run: dict, paths: list[str] | None = None) -> DataFrame:
        """Rows of a run in the present schema, with _gone and _p. An older run lacks columns that came later: upgrade says what stands in them."""
        schema = StructType([*self.schema.fields, StructField("_p", IntegerType()), StructField("_gone", BooleanType())])
        df = self.spark.read.schema(schema).parquet(*(paths or [run["path"]]))
        df = df.withColumn("_gone", F.coalesce("_gone", F.lit(False)))
        if run.get("schema", 0) < self.version:
            df = self.upgrade(df, run.get("schema", 0)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], "_p", "_gone")
        return df

    def _newest(self, deltas: DataFrame) -> DataFrame:
        """Of the rows of deltas (with _n, the number of the delta) the newest of each key."""
        one = F.struct("_n", *[f.name for f in self.schema], "_gone")
        # null-safe by key: two nulls are one key in a group
        return deltas.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(F.max_by(one, F.col("_n")).alias("_r")).select("_r.*")

    def _union(self, state: State, only: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame | None:
        parts = [only(self._raw(run)).withColumn("_n", F.lit(i)) for i, run in enumerate(state["deltas"])]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    @staticmethod
    def _equal(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & a[k].eqNullSafe(b[k])
        return out

    def _merged(self, base: DataFrame | None, deltas: DataFrame | None) -> DataFrame:
        columns = [f.name for f in self.schema]
        if base is None and deltas is None:
            return self.spark.createDataFrame([], self.schema)
        if deltas is None:
            return base.filter("not _gone").select(*columns)
        new = self._newest(deltas)
        live = new.filter("not _gone").select(*columns)
        if base is None:
            return live
        named = new.select(*self.keys)
        return base.join(named, self._equal(base, named, self.keys), "left_anti").filter("not _gone").select(*columns).unionByName(live)

    def rows(self, state: State) -> DataFrame:
        """All rows. The base is not shuffled while Spark finds the deltas small enough to broadcast their keys."""
        return self._merged(self._raw(state["base"]) if state["base"] else None, self._union(state))

    def files_of(self, state: State, keys: DataFrame) -> list[str] | None:
        """Files of the base that may hold some keys; None where there are more than LOOKED_UP, or no list."""
        base = state["base"]
        if not base or "files" not in base:
            return None
        p = keys.select(F.pmod(F.hash(*[F.col(k).cast(self.schema[k].dataType) for k in self.by]), F.lit(base["parts"])).alias("_p")).distinct()
        ranges = self.spark.read.parquet(base["files"]).select("file", F.explode(F.sequence("low", "high")).alias("_p"))
        found = ranges.join(p, "_p").select("file").distinct().limit(LOOKED_UP + 1).collect()
        return None if len(found) > LOOKED_UP else [r["file"] for r in found]

    def lookup(self, state: State, keys: DataFrame) -> DataFrame:
        """The rows that have some values in the columns that rows are dealt by (a table with these columns)."""
        wanted = keys.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.by]).distinct()
        only = lambda df: df.join(wanted, self._equal(df, wanted, self.by), "left_semi")
        base, files = None, self.files_of(state, wanted)
        if files is None and state["base"]:
            base = only(self._raw(state["base"]))
        elif files:
            base = only(self._raw(state["base"], files))
        return self._merged(base, self._union(state, only))

    def changes(self, deltas: list[dict]) -> tuple[DataFrame, DataFrame]:
        """What some deltas say in the end: rows that they write and keys that they delete."""
        union = self._union({"base": None, "deltas": deltas})
        if union is None:
            none = self.spark.createDataFrame([], self.schema)
            return none, none.select(*self.keys)
        new = self._newest(union)
        return new.filter("not _gone").select(*[f.name for f in self.schema]), new.filter("_gone").select(*self.keys)

    # compaction

    def compacted(self, state: State, all_of_it: bool = False) -> State:
        """The state with deltas folded: into the base when they are large beside it, else the newest ones of similar sizes into one; as it is when there is little to gain."""
        deltas, base = state["deltas"], state["base"]
        if not deltas:
            return state
        if all_of_it or base is None or sum(d["bytes"] for d in deltas) > SHARE * max(base["bytes"], FLOOR):
            return self.replaced(self.rows(state))
        if len(deltas) <= DELTAS:
            return state
        at, size = len(deltas) - 1, deltas[-1]["bytes"]
        while at and (deltas[at - 1]["bytes"] <= 2 * size or len(deltas) - at < 2):
            at -= 1
            size += deltas[at]["bytes"]
        kept = self._newest(self._union({"base": None, "deltas": deltas[at:]})).drop("_n")
        return {"base": base, "deltas": [*deltas[:at], self._run(kept)]}


def vacuum(spark: SparkSession, folder: str, keep: list[State]) -> int:
    """Deletes the runs under a folder that none of some states names; how many."""
    used = {p.rsplit("/", 1)[-1] for s in keep for r in runs(s) for p in (r["path"], r.get("files")) if p}
    fs, at = hadoop(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    old = [n for n in names if n not in used]
    for n in old:
        drop_path(spark, f"{folder}/{n}")
    return len(old)

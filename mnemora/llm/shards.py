"""Shards with size-tiered compaction (operator 7), DataFrame functions and the file system only.

A store is a folder: ``data/`` with immutable Parquet files and ``manifests/vN.json``, the list of
live files with their sizes, rows and level. Arrivals are appended as small files. A file belongs to
tier ``floor(log(bytes / floor_bytes, fanout))``; a tier with ``fanout`` files or more is a run: its
files are read together and rewritten as files of about the target size, without a shuffle.
Files at the target size rest. Each step writes its files first and then commits the next
version by renaming its manifest into place, which fails where that version is there already; the
loser retries on the newer one. Readers hold the version that they opened; ``vacuum`` removes files that no kept version names.

Defined cases: an append of no rows commits a version without new files; null values, repeated
rows, extra columns and any text pass through unchanged; the schema is the first append's.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop, scratch, text_of

MB = 1 << 20


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 * MB, floor_bytes: int = MB, fanout: int = 4):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.floor, self.fanout = target_bytes, floor_bytes, fanout

    # manifests

    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "files": []}
        text = self.spark.read.text(f"{self.path}/manifests/v{have[-1] if version is None else version:020d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> bool:
        """Creates the manifest of its version; False where another writer did so first."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, final = hadoop(self.spark, f"{self.path}/manifests/v{manifest['version']:020d}.json")
        fs.mkdirs(final.getParent())
        draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        refuse = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, refuse)
        except Exception:
            fs.delete(draft, False)
            if fs.exists(final):
                return False
            raise
        return True

    def _swap(self, added: list[dict], gone: list[str], schema: str | None) -> dict:
        """Commits the live files with some added and some gone, on whatever version is the newest by then."""
        while True:
            now = self.manifest()
            live = {f["path"]: f for f in now["files"]}
            if not set(gone) <= set(live):
                raise RuntimeError("another writer has merged these files already")
            files = [f for p, f in live.items() if p not in set(gone)] + added
            new = {"version": now["version"] + 1, "schema": now["schema"] or schema, "files": sorted(files, key=lambda f: f["path"])}
            if self._commit(new):
                return new

    def _write(self, df: DataFrame, level: int) -> list[dict]:
        """Writes df as files of data/; Spark's commit protocol keeps those of lost or repeated tasks out."""
        run = f"{self.path}/data/run-{uuid.uuid4().hex}"
        df.write.parquet(run)
        fs, p = hadoop(self.spark, run)
        found = [{"path": s.getPath().toString(), "bytes": s.getLen(), "level": level} for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
        if not found:
            return []
        rows = {r["f"]: r["n"] for r in self.spark.read.schema(df.schema).parquet(run).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for f in found:
            f["rows"] = rows.get(f["path"].rsplit("/", 1)[1], 0)
        return [f for f in found if f["rows"]]

    # operations

    def append(self, df: DataFrame) -> dict:
        """Adds df as small immutable files, one for each of its partitions that has rows."""
        return self._swap(self._write(df, 0), [], df.schema.json())

    def tier(self, size: int) -> int:
        return int(math.log(max(1, size / self.floor), self.fanout))

    def due(self) -> list[list[dict]]:
        """Runs to merge: the files of each tier that has fanout files or more, none of them at the target size."""
        tiers: dict[int, list[dict]] = {}
        for f in self.manifest()["files"]:
            if f["bytes"] < 0.75 * self.target:
                tiers.setdefault(self.tier(f["bytes"]), []).append(f)
        return [fs for _, fs in sorted(tiers.items()) if len(fs) >= self.fanout]

    def compact(self) -> int:
        """Merges runs until none is due; the number of merges. Every merge lowers the number of files, so this ends."""
        merges = 0
        while runs := self.due():
            for run in runs:
                out = max(1, round(sum(f["bytes"] for f in run) / self.target))
                if out >= len(run):
                    return merges
                rows = self.read(files=run).coalesce(out)
                self._swap(self._write(rows, 1 + max(f["level"] for f in run)), [f["path"] for f in run], None)
                merges += 1
        return merges

    def read(self, version: int | None = None, files: list[dict] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        files = m["files"] if files is None else files
        schema = StructType.fromJson(json.loads(m["schema"]))
        return self.spark.read.schema(schema).parquet(*[f["path"] for f in files]) if files else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files that none of the last ``keep`` versions names; the number deleted. Not while writers run."""
        named = {f["path"] for v in self.versions()[-keep:] for f in self.manifest(v)["files"]}
        fs, p = hadoop(self.spark, f"{self.path}/data")
        gone = 0
        for run in fs.listStatus(p):
            for s in fs.listStatus(run.getPath()):
                if s.getPath().getName().startswith("part-") and s.getPath().toString() not in named:
                    gone += bool(fs.delete(s.getPath(), False))
        return gone


def report(docs: DataFrame, store_path: str | None = None, target_bytes: int = 64 * MB, arrivals: int = 4) -> DataFrame:
    """All rows of docs through a store, in ``arrivals`` appends, each followed by a compaction.

    Returns per row of the last version: doc_id, n_chars (of the text), text_sha256, shard (its file),
    shard_level, shard_rows and version. A row arrives in append ``hash(doc_id) mod arrivals``.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, store_path or scratch(spark, "shards"), target_bytes)
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.filter(lot == k))
        store.compact()
        store.vacuum()
    m = store.manifest()
    files = spark.createDataFrame([(f["path"].rsplit("/", 1)[1], f["level"], f["rows"]) for f in m["files"]] or [], "shard string, shard_level int, shard_rows long")
    rows = store.read()
    own = rows.select("doc_id", F.length(text_of(rows)).cast("long").alias("n_chars"), F.sha2(text_of(rows), 256).alias("text_sha256"), F.col("_metadata.file_name").alias("shard")) if m["files"] else rows.select(
        "doc_id", F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("text_sha256"), F.lit("").alias("shard"))
    return own.join(files, "shard", "left").select("doc_id", "n_chars", "text_sha256", "shard", "shard_level", "shard_rows", F.lit(m["version"]).cast("long").alias("version"))

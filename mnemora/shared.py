"""Tables in the folder that the cluster shares: results that several plans read, and ends of lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes what a query shuffled when the query ends, not when the driver's memory is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of our own in local mode; on a cluster that is an error, for executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="mnemora-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def hadoop(spark: SparkSession, path: str):
    """(FileSystem, Path) of Hadoop for a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended already; the folder is the cluster's to clean then
            return


def kept(df: DataFrame, label: str, lean: bool = False) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path: to be dropped once nothing reads it any more. lean: compressed further, and what its writing shuffled is removed at once."""
    spark = df.sparkSession
    path = scratch(spark, label)
    if not lean:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str, lean: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, lost executors cost nothing before it."""
    return kept(df, label, lean)[0]


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows, found by reading no more than that."""
    return df.limit(rows + 1).count() <= rows


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that were started elsewhere. On a cluster without the folder, give the package by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep) and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)

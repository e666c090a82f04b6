"""Folders of many small files: listed and read by tasks, many files each."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.shared import hadoop, ship, written

#: Files that a task reads, about, and bytes of them that it holds at a time.
FILES, BYTES = 2048, 8 << 20
PLACE = "root string, shown string, rel string, modified long"


def below(spark: SparkSession, *inputs: str, suffix: str = ".md") -> DataFrame:
    """(path, content, modified) of the files under folders, or of single files, whose names end so. Names that begin with ``_`` or ``.`` are left out, with all that is under them, and empty files, as by Spark's reader.

    Spark's own reader counts each file as 4 MB, so it makes a task of every 32 files, and it lists all of them on the driver. It still reads
    stores that Arrow can't open.
    """
    roots = [_root(spark, p) for p in inputs]
    if not all(_opens(uri) for uri, _ in roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(list(inputs))
        return files.select("path", "content", F.col("modificationTime").alias("modified"))
    ship(spark)
    read = dealt(_listed(spark, roots, suffix), "root", "rel").mapInPandas(_contents, "path string, content binary, modified long")
    return read.withColumn("modified", F.timestamp_millis("modified"))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows that each stand for a file, dealt to tasks by their number: they are small beside the work that a file is."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // FILES + 1)
    return rows.repartition(tasks, *by)


def _root(spark: SparkSession, path: str) -> tuple[str, str]:
    """A path as a URI, and as Spark shows it."""
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    whole = fs.makeQualified(p)
    return whole.toUri().toString(), whole.toString()


def _opens(uri: str) -> bool:
    from pyarrow import fs, lib

    try:
        fs.FileSystem.from_uri(uri)
    except (lib.ArrowException, OSError):
        return False
    return True


def _listed(spark: SparkSession, roots: list[tuple[str, str]], suffix: str) -> DataFrame:
    """The files (PLACE), a job for each level of folders; a task lists whole folders."""

    def run(batches: Iterator) -> Iterator:
        import posixpath

        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            for root, shown, rel in zip(pdf["root"], pdf["shown"], pdf["rel"], strict=True):
                system, base = fs.FileSystem.from_uri(root)
                own = system.get_file_info(base + rel)
                inside = system.get_file_info(fs.FileSelector(own.path)) if own.type == fs.FileType.Directory else [own]
                rows = []
                for x in inside:
                    name, folder = posixpath.basename(x.path), x.type == fs.FileType.Directory
                    if not (name.startswith(".") or name.startswith("_") and "=" not in name) and (folder or x.size and name.endswith(suffix)):
                        rows.append((root, shown, x.path[len(base) :], int((x.mtime_ns or 0) // 1_000_000), folder))
                yield pd.DataFrame(rows, columns=["root", "shown", "rel", "modified", "folder"])

    level, files = spark.createDataFrame([(*r, "", 0) for r in roots], PLACE), []
    while True:
        found = written(level.repartition(4 * spark.sparkContext.defaultParallelism, "root", "rel").mapInPandas(run, f"{PLACE}, folder boolean"), "listing")
        files.append(found.filter("not folder").drop("folder"))
        level = found.filter("folder").drop("folder")
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, files)


def _contents(batches: Iterator) -> Iterator:
    import pandas as pd
    from pyarrow import fs

    systems: dict = {}
    for pdf in batches:
        rows, size = [], 0
        for root, shown, rel, modified in zip(pdf["root"], pdf["shown"], pdf["rel"], pdf["modified"], strict=True):
            if root not in systems:
                systems[root] = fs.FileSystem.from_uri(root)
            system, base = systems[root]
            with system.open_input_stream(base + rel, compression=None) as f:
                content = f.read()
            rows.append((shown + rel, content, modified))
            size += len(content)
            if size >= BYTES:
                yield pd.DataFrame(rows, columns=["path", "content", "modified"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["path", "content", "modified"])

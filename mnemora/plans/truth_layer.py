"""The folder of canonical files and the store, kept in step.

The files are the truth and the store is a view of them: captures are promoted to files, what the store has learnt
of a memory's salience is written back, and the folder is compiled into nodes and edges. A rebuild makes a
store of the folder and the spool alone, in one commit or not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.text import edge_id, node_id, truncate
from mnemora.operators import store_ops, truth
from mnemora.schemas import TABLES
from mnemora.shared import hadoop, ship, written
from mnemora.sources import captures, memory_files
from mnemora.sources import files as files_source
from mnemora.store import GraphStore, full

SPOOL = ".capture"
#: The node types that kinds of memories become; all others are concepts.
NODE_TYPES = {"decision": "decision", "lesson": "lesson", "event": "event"}
LABEL, EXCERPT = 120, 200


class NotCompiled(RuntimeError):
    """Files or entries that a rebuild could not take."""


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes (path, text) below a folder that all executors share, each file whole and then renamed into place; how many. A repeated task writes the same again."""

    def run(batches: Iterator) -> Iterator:
        import posixpath
        import uuid

        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                to = posixpath.join(base, path)
                draft = posixpath.join(posixpath.dirname(to), f".{uuid.uuid4().hex}")
                system.create_dir(posixpath.dirname(to), recursive=True)
                with system.open_output_stream(draft) as out:
                    out.write(text.encode())
                system.move(draft, to)
            yield pd.DataFrame({"path": pdf["path"]})

    ship(rows.sparkSession)
    return rows.select("path", "text").mapInPandas(run, "path string").count()


def _spool(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    fs, p = hadoop(spark, f"{folder}/{SPOOL}")
    if fs.exists(p):
        found = captures.read(spark, f"{folder}/{SPOOL}")
        return found | {"entries": captures.canonical_ids(found["entries"])}
    entries = spark.createDataFrame([], f"file string, at long, {captures.ENTRY}")
    return {"entries": entries, "tombstones": entries.select("id", "ts", "reason"), "errors": entries.select("file", "at", F.col("content").alias("value"))}


def _read(store: GraphStore, folder: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Files, spool and the ids that are forgotten."""
    spool = _spool(store.spark, folder)
    return written(memory_files.read(store.spark, folder), "files"), spool, truth.forgotten_ids(spool["tombstones"], store.table("forgotten"))


def migrate_tombstones(store: GraphStore, folder: str) -> None:
    """What the store has forgotten and the spool does not know yet goes into the spool."""
    known = _spool(store.spark, folder)["tombstones"].select("id")
    new = written(store.table("forgotten").join(known, "id", "left_anti").select(F.lit("tombstone").alias("kind"), "id", "ts", "reason"), "tombstones")
    if new.limit(1).count():
        captures.append(new, f"{folder}/{SPOOL}")


def promote(store: GraphStore, folder: str) -> dict:
    """Captures become files, once; ``files`` written and ``errors`` (id, error) of those that found no free path."""
    files, spool, gone = _read(store, folder)
    marks = store.table("meta").filter(F.col("key").startswith("promoted:")).select(F.substring("key", 10, 100).alias("id"))
    todo = written(truth.to_promote(spool["entries"], gone, files.filter("id is not null"), marks), "promoted")
    paths = written(truth.target_paths(todo, files), "paths")
    placed = todo.join(paths.filter("path is not null"), "id")
    kind = F.when(F.col("kind").isin(*memory_files.KINDS), F.col("kind")).otherwise("fact")
    rows = files_source.dealt(placed, "id").select(
        "path", "id", kind.alias("type"), F.lit("active").alias("status"), "title", F.substring("ts", 1, 10).alias("created"), F.lit(None).cast("string").alias("last_reinforced"),
        F.lit(0).cast("long").alias("reinforcement_count"), "importance", "scope", "tags", F.array().cast("array<string>").alias("links"), F.lit(None).cast("string").alias("source"),
        F.concat(F.coalesce("content", "title"), F.lit("\n")).alias("body"),
    )
    n = write_files(memory_files.serialized(rows), folder)
    store.upsert(meta=placed.select(F.concat(F.lit("promoted:"), "id").alias("key"), F.col("path").alias("value")))
    return {"files": n, "errors": paths.filter("path is null").select("id", F.lit("no free path").alias("error"))}


def write_back_salience(store: GraphStore, folder: str) -> int:
    """Rewrites the files whose nodes have more reinforcements, or later ones, than they state; how many."""
    files = written(memory_files.read(store.spark, folder), "files").filter("error is null")
    now = truth.salience(files, store.table("nodes"))
    was = files.select(F.col("path").alias("_p"), F.col("reinforcement_count").alias("_r"), F.coalesce("last_reinforced", "created").alias("_l"))
    more = now.join(was, F.col("path") == F.col("_p")).filter("reinforcement_count > _r or not last_reinforced <=> _l").drop("_p", "_r", "_l")
    return write_files(memory_files.serialized(written(more, "salience")), folder)


def compiled(files: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """nodes (memories and what they link to), edges, and errors (path, error) of the files of a folder."""
    good = files.filter("error is null")
    live = truth.compiled(good, gone)
    twice = truth.duplicate_ids(good).select("id", "first_path")
    errors = files.filter("error is not null").select("path", "error").unionByName(
        good.join(twice, "id").filter("path <> first_path").select("path", F.concat(F.lit("the id is taken by "), "first_path").alias("error"))
    )
    kind = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), NODE_TYPES.items(), F.when(F.lit(False), "")).otherwise("concept")
    text = F.coalesce("claim", "title", F.lit(""))
    memory = live.select(
        "id", truncate(F.coalesce("title", "claim", "id"), LABEL).alias("label"), kind.alias("type"), F.array().cast("array<string>").alias("aliases"), F.col("created").alias("first_seen"),
        F.coalesce("last_reinforced", "created").alias("last_reinforced"), F.lit(1).cast("long").alias("mention_count"), "reinforcement_count", F.array("path").alias("source_files"),
        F.array(F.struct(F.col("path").alias("file"), truncate(text, EXCERPT).alias("text"), F.col("created").alias("date"))).alias("excerpts"), "status", F.col("path").alias("canonical_path"),
    )
    link = live.select("id", "path", "created", F.explode(F.array_distinct(F.concat("wikilinks", "links"))).alias("to")).filter("trim(to) <> ''").withColumn("target", node_id(F.col("to")))
    entities = link.groupBy(F.col("target").alias("id")).agg(
        F.min_by("to", "path").alias("label"), F.lit("concept").alias("type"), F.min("created").alias("first_seen"), F.max("created").alias("last_reinforced"), F.count(F.lit(1)).alias("mention_count"),
        (F.count(F.lit(1)) - 1).alias("reinforcement_count"), F.sort_array(F.collect_set("path")).alias("source_files"),
    )
    edges = link.dropDuplicates(["id", "target"]).select(
        edge_id(F.col("id"), F.col("target"), F.lit("explicit")).alias("id"), F.col("id").alias("source"), "target", F.lit("explicit").alias("type"), F.lit(False).alias("directed"), F.lit(1.0).alias("weight"),
        F.lit(1.0).alias("base_weight"), F.lit(0).cast("long").alias("reinforcement_count"), F.col("created").alias("first_formed"), F.col("created").alias("last_reinforced"), F.lit(1.0).alias("stability"),
        F.array(F.struct(F.col("path").alias("file"), F.col("created").alias("date"), F.lit("").alias("context"))).alias("evidence"),
    )
    return {"memories": full(memory, "nodes"), "entities": full(entities, "nodes"), "edges": full(edges, "edges").dropDuplicates(["id"]), "errors": errors}


def compile_folder(store: GraphStore, folder: str) -> dict:
    """Brings the store up to the files: memories of files, entities that are not there yet, edges that files state and no longer state, memories whose files are gone. ``errors``: files not taken, whose memories stay."""
    files, _, gone = _read(store, folder)
    c = {k: written(v, k) for k, v in compiled(files, gone).items()}
    nodes, edges = store.table("nodes"), store.table("edges")
    ledger = store.table("meta").filter(F.col("key").startswith("compiled:")).select(F.substring("key", 10, 1000).alias("path"))
    missing = truth.deleted_files(ledger, files)
    # a memory goes where its file was compiled before and is gone, or now holds another id
    owned = nodes.filter("canonical_path is not null").select("id", F.col("canonical_path").alias("path"))
    readable = files.filter("error is null").select("path", F.col("id").alias("_i"))
    dead = owned.join(missing, "path", "left_semi").select("id").unionByName(owned.join(readable, "path").filter("id <> _i").select("id")).unionByName(gone.select("id")).distinct()
    dead = written(dead.join(c["memories"].select("id"), "id", "left_anti"), "dead")
    left = truth.forget({"nodes": nodes, "edges": edges, "embeddings": store.table("embeddings"), "episode_entities": store.table("episode_entities")}, dead)
    stale = truth.stale_edges(left["edges"], c["memories"], c["edges"]).select("id")
    kept_edges = left["edges"].join(stale, "id", "left_anti").select(edges.columns)
    new_nodes = c["memories"].unionByName(c["entities"].join(left["nodes"].select("id"), "id", "left_anti").select(c["entities"].columns))
    marks = files.select(F.concat(F.lit("compiled:"), "path").alias("key"), F.lit("").alias("value"))
    meta = store.table("meta").filter(~F.col("key").startswith("compiled:")).unionByName(marks)
    tables = {
        "nodes": store_ops.upsert(left["nodes"], new_nodes, ["id"]), "edges": kept_edges.unionByName(c["edges"].join(kept_edges.select("id"), "id", "left_anti").select(edges.columns)),
        "embeddings": left["embeddings"], "episode_entities": left["episode_entities"], "meta": meta,
    }
    version = store.commit({t: full(d, t) for t, d in tables.items()})
    return {"version": version, "errors": c["errors"]}


def consolidate_truth(store: GraphStore, folder: str) -> dict:
    """The whole sequence: tombstones into the spool, captures into files, salience into files, files into the store."""
    migrate_tombstones(store, folder)
    promoted = promote(store, folder)
    return {"promoted": promoted, "salience": write_back_salience(store, folder), "compiled": compile_folder(store, folder)}


def rebuild(spark: SparkSession, folder: str, path: str, force: bool = False) -> int:
    """A store of a folder's files and its spool, in one commit. Raises, with nothing committed, where a file or an entry can't be taken, or a store is there and force is not given."""
    store = GraphStore(spark, path)
    if store.version()["n"] and not force:
        raise FileExistsError(f"{path} is there already")
    empty = {t: spark.createDataFrame([], ddl) for t, (ddl, _) in TABLES.items()}
    spool = _spool(spark, folder)
    files = written(memory_files.read(spark, folder), "files")
    gone = spool["tombstones"].select("id").distinct()
    c = {k: written(v, k) for k, v in compiled(files, gone).items()}
    errors = c["errors"].select(F.concat_ws(": ", "path", "error").alias("e")).unionByName(spool["errors"].select(F.concat_ws(": ", "file", "value").alias("e")))
    first = [r["e"] for r in errors.orderBy("e").limit(20).collect()]
    if first:
        raise NotCompiled("nothing was built, for these were not taken: " + "; ".join(first))
    replayed = full(truth.replayed(spool["entries"], gone, files), "nodes").withColumns({"type": F.lit("concept"), "mention_count": F.lit(1).cast("long"), "reinforcement_count": F.lit(0).cast("long")})
    nodes = c["memories"].unionByName(c["entities"].join(c["memories"].select("id"), "id", "left_anti").select(c["entities"].columns)).unionByName(replayed)
    marks = files.select(F.concat(F.lit("compiled:"), "path").alias("key"), F.lit("").alias("value"))
    return store.replace(**(empty | {"nodes": nodes, "edges": c["edges"], "meta": marks}))

"""Where a graph, its settings and its canonical files lie."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession

from mnemora.shared import hadoop
from mnemora.sources import graph_json
from mnemora.store import GraphStore


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON object; empty where the file is not there or is none."""
    if not _exists(spark, path):
        return {}
    try:
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (ValueError, TypeError):
        return {}
    return found if isinstance(found, dict) else {}


def load_config(spark: SparkSession, graph_path: str | None, name: str = "mnemora.config.json") -> dict:
    """The settings beside a graph; empty where there are none."""
    return read_json(spark, posixpath.join(posixpath.dirname(graph_path), name)) if graph_path else {}


def entity_map(spark: SparkSession, path: str) -> tuple[dict[str, str], list[str]]:
    """(aliases, ignored names) of a file; empty where it is not there or is malformed."""
    found = read_json(spark, path)
    aliases, ignore = found.get("aliases") or {}, found.get("ignore") or []
    return (aliases if isinstance(aliases, dict) else {}), (ignore if isinstance(ignore, list) else [])


def memory_dir(spark: SparkSession, graph_path: str, configured: str | None = None) -> str | None:
    """The folder of canonical files: as configured (relative to the graph's folder), else in the settings, else ``memory`` beside the graph; None where there is none."""
    base = posixpath.dirname(graph_path)
    chosen = (load_config(spark, graph_path).get("memory") or {}).get("dir") or configured
    if chosen:
        return chosen if chosen.startswith("/") or ":" in chosen else posixpath.join(base, chosen)
    usual = posixpath.join(base, "memory")
    return usual if _exists(spark, usual) else None


def within(root: str, path: str) -> bool:
    """Whether a path, taken from a root, stays under it."""
    root = posixpath.normpath(root)
    return (posixpath.normpath(posixpath.join(root, path)) + "/").startswith(root.rstrip("/") + "/")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes and edges of a graph: a store's folder, a JSON document, or without an ending whichever is there - store, then ``.json``, then ``graph.json`` in the folder."""
    if path.endswith(".json"):
        if not _exists(spark, path):
            raise FileNotFoundError(f"graph file not found: {path}")
        return graph_json.read(spark, path)
    if _exists(spark, f"{path}/versions"):
        store = GraphStore(spark, path)
        return {"nodes": store.table("nodes"), "edges": store.table("edges")}
    for other in (f"{path}.json", f"{path.rstrip('/')}/graph.json"):
        if _exists(spark, other):
            return graph_json.read(spark, other)
    raise FileNotFoundError(f"no graph at {path}: tried the folder of a store, {path}.json and {path.rstrip('/')}/graph.json")

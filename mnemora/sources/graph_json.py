"""Graphs as one JSON document: nodes and edges by id, and pending edges as an array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.schemas import EDGES, NODES, PENDING

#: The names of the fields in the documents.
NODE_FIELDS = {
    "id": "id", "label": "label", "type": "type", "aliases": "aliases", "firstSeen": "first_seen", "lastReinforced": "last_reinforced", "mentionCount": "mention_count",
    "reinforcementCount": "reinforcement_count", "sourceFiles": "source_files", "excerpts": "excerpts", "hiveExclude": "hive_exclude", "status": "status", "canonicalPath": "canonical_path",
}
EDGE_FIELDS = {
    "id": "id", "source": "source", "target": "target", "type": "type", "directed": "directed", "weight": "weight", "baseWeight": "base_weight", "reinforcementCount": "reinforcement_count",
    "firstFormed": "first_formed", "lastReinforced": "last_reinforced", "stability": "stability", "evidence": "evidence",
}
PENDING_FIELDS = {"source": "source", "target": "target", "type": "type", "count": "count", "firstSeen": "first_seen", "evidence": "evidence"}


def _struct(ddl: str, fields: dict[str, str]) -> str:
    from pyspark.sql.types import StructType

    types = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ddl)}
    return "struct<" + ",".join(f"{k}:{types[v]}" for k, v in fields.items()) + ">"


def _columns(fields: dict[str, str]) -> list:
    return [F.col(f"x.{k}").alias(v) for k, v in fields.items()]


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes and edges of a graph document."""
    ddl = f"struct<nodes:map<string,{_struct(NODES, NODE_FIELDS)}>,edges:map<string,{_struct(EDGES, EDGE_FIELDS)}>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", ddl).alias("g"))
    rows = lambda part, fields: doc.select(F.explode(f"g.{part}").alias("k", "x")).select(*_columns(fields))
    return {"nodes": rows("nodes", NODE_FIELDS), "edges": rows("edges", EDGE_FIELDS)}


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<{_struct(PENDING, PENDING_FIELDS)}>").alias("p"))
    return doc.select(F.explode("p").alias("x")).select(*_columns(PENDING_FIELDS))


def documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line a node or edge (kind, line): the form in which large graphs are exported; a reader merges the lines by id."""
    one = lambda df, fields, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*[F.col(v).alias(k) for k, v in fields.items() if v in df.columns])).alias("line"))
    return one(nodes, NODE_FIELDS, "node").unionByName(one(edges, EDGE_FIELDS, "edge"))


def migrate(spark: SparkSession, path: str, store) -> int:
    """Takes a graph document into a store; raises if the counts differ after it."""
    g = read(spark, path)
    version = store.replace(nodes=g["nodes"], edges=g["edges"])
    for name, df in g.items():
        if store.table(name).count() != df.count():
            raise RuntimeError(f"{name} were lost on the way")
    return version

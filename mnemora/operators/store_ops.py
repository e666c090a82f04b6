"""Filters and mutations of the store's tables, as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_nodes(nodes: DataFrame, kind: str | None = None, label: str | None = None, since: str | None = None) -> DataFrame:
    n = nodes if kind is None else nodes.filter(F.col("type") == kind)
    n = n if label is None else n.filter(F.lower("label").contains(label.lower()))
    n = n if since is None else n.filter(F.col("last_reinforced").cast("string") >= since)
    return n.orderBy(F.desc("mention_count"), "id")


def list_edges(edges: DataFrame, kind: str | None = None, source: str | None = None, target: str | None = None, least: float | None = None) -> DataFrame:
    for column, value in (("type", kind), ("source", source), ("target", target)):
        if value is not None:
            edges = edges.filter(F.col(column) == value)
    edges = edges if least is None else edges.filter(F.col("weight") >= least)
    return edges.orderBy(F.desc("weight"), "id")


def list_episodes(episodes: DataFrame, links: DataFrame, kind: str | None = None, since: str | None = None, until: str | None = None, source: str | None = None, entity: str | None = None) -> DataFrame:
    """Filters compare dates as strings: an end without a time leaves out that day's later times."""
    e = episodes if kind is None else episodes.filter(F.col("type") == kind)
    at = F.col("timestamp").cast("string")
    e = e if since is None else e.filter(at >= since)
    e = e if until is None else e.filter(at <= until + (" 00:00:00" if len(until) == 10 and dict(episodes.dtypes)["timestamp"] != "string" else ""))
    e = e if source is None else e.filter(F.col("source") == source)
    if entity is not None:
        own = links.filter(F.col("node_id") == entity).select(F.col("episode_id").alias("_e"))
        e = e.join(own, e["id"] == own["_e"], "left_semi")
    return e.orderBy(F.desc("timestamp"), "id")


def episode_roles(episodes: DataFrame, links: DataFrame) -> DataFrame:
    """Episodes with sorted arrays of the names that take part by role; plain mentions are in none. links: episode_id, role, name."""
    pick = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("name"))))
    g = links.groupBy("episode_id").agg(pick("participant").alias("participants"), pick("topic").alias("topics"), pick("outcome").alias("outcomes"))
    out = episodes.join(g, episodes["id"] == g["episode_id"], "left").drop("episode_id")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("participants", "topics", "outcomes")})


def upsert(base: DataFrame, delta: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """base with the rows of delta in place of those of equal keys."""
    return base.join(delta.select(*keys), list(keys), "left_anti").select(base.columns).unionByName(delta.select(base.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without some nodes and all edges at them."""
    gone = ids.select("id")
    e = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(gone, "id", "left_anti"), e.select(edges.columns)


def touch(episodes: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Episodes with one more access of some."""
    seen = ids.select(F.col("id").alias("_i")).distinct()
    hit = F.col("_i").isNotNull()
    e = episodes.join(seen, episodes["id"] == seen["_i"], "left")
    return e.withColumns({"access_count": F.col("access_count") + hit.cast("long"), "last_accessed": F.when(hit, F.lit(now)).otherwise(F.col("last_accessed"))}).drop("_i")


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    return df.offset(offset).limit(limit)

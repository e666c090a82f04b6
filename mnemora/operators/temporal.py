"""Snapshots: differences, histories, views at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.weights import weight_at_date

NODE_FIELDS = ("label", "type", "mention_count", "reinforcement_count", "last_reinforced")


def diff_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change, fields): added, removed or changed nodes and which fields changed; arrays count by length."""
    sized = [c for c in ("source_files", "excerpts") if c in before.columns]
    whole = [c for c in ("aliases",) if c in before.columns]
    cols = [c for c in NODE_FIELDS if c in before.columns]
    pick = lambda df, p: df.select(F.col("id").alias(f"{p}id"), *[F.col(c).alias(p + c) for c in (*cols, *sized, *whole)])
    j = pick(before, "a_").join(pick(after, "b_"), F.col("a_id") == F.col("b_id"), "full_outer")
    tests = [F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in (*cols, *whole)]
    tests += [F.when(F.size(f"a_{c}") != F.size(f"b_{c}"), F.lit(c)) for c in sized]
    fields = F.array_compact(F.array(*tests))
    change = F.when(F.col("a_id").isNull(), "added").when(F.col("b_id").isNull(), "removed").when(F.size(fields) > 0, "changed")
    out = j.select(F.coalesce("a_id", "b_id").alias("id"), change.alias("change"), F.when(change == "changed", F.array_join(fields, ",")).otherwise("").alias("fields"))
    return out.filter("change is not null")


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): added, removed, strengthened or weakened edges."""
    a, b = before.select(F.col("id").alias("a_id"), F.col("weight").alias("aw")), after.select(F.col("id").alias("b_id"), F.col("weight").alias("bw"))
    j = a.join(b, F.col("a_id") == F.col("b_id"), "full_outer")
    change = F.when(F.col("a_id").isNull(), "added").when(F.col("b_id").isNull(), "removed").when(F.col("bw") > F.col("aw"), "strengthened").when(F.col("bw") < F.col("aw"), "weakened")
    return j.select(F.coalesce("a_id", "b_id").alias("id"), change.alias("change")).filter("change is not null")


def pinned(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id): everything that two differences touch, once."""
    return nodes.select(F.lit("node").alias("kind"), "id").unionByName(edges.select(F.lit("edge").alias("kind"), "id")).distinct()


def links_at(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): edges with either end among ids."""
    own = ids.select(F.col("id").alias("_n")).distinct()
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("_n"))
    return ends.join(own, "_n", "left_semi").select("id").distinct()


def diff_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts of two differences, and the net change."""
    n = nodes.agg(*[F.count_if(F.col("change") == c).alias(f"nodes_{c}") for c in ("added", "removed", "changed")])
    e = edges.agg(*[F.count_if(F.col("change") == c).alias(f"edges_{c}") for c in ("added", "removed", "strengthened", "weakened")])
    both = n.join(e, how="cross")  # two single rows
    return both.withColumn("net_change", F.col("nodes_added") - F.col("nodes_removed") + F.col("edges_added") - F.col("edges_removed"))


def history(rows: DataFrame, snapshots: DataFrame, value: str) -> DataFrame:
    """(id, snapshot_id, created_at, value, delta, trend) of each entity over its snapshots. rows: snapshot_id, id and the value."""
    j = rows.join(snapshots.select(F.col("id").alias("snapshot_id"), "created_at"), "snapshot_id")
    w = Window.partitionBy("id").orderBy("created_at", "snapshot_id")
    delta = F.col(value) - F.lag(value).over(w)
    trend = F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").when(F.col("delta") == 0, "same").otherwise("first")
    return j.withColumn("delta", delta).select("id", "snapshot_id", "created_at", F.col(value).alias("value"), "delta", trend.alias("trend"))


def graph_at(nodes: DataFrame, edges: DataFrame, at: Column, least: float = 0.05) -> dict[str, DataFrame]:
    """What a view shows at a date: nodes seen by then, edges formed by then and still strong enough."""
    n = nodes.filter(F.col("first_seen") <= at)
    e = edges.filter(F.col("first_formed") <= at).withColumn("shown_weight", weight_at_date(at))
    e = e.filter(F.col("shown_weight") >= max(least, 0.05)).join(n.select(F.col("id").alias("source")), "source", "left_semi").join(n.select(F.col("id").alias("target")), "target", "left_semi")
    return {"nodes": n, "edges": e}


def prune_snapshots(snapshots: DataFrame, cutoff: str) -> DataFrame:
    """The snapshots that retention drops (string comparison)."""
    return snapshots.filter(F.col("created_at").cast("string") <= cutoff)

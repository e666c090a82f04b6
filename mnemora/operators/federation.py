"""Union of the graphs of several agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.config import EXCERPTS, ORIGIN_FACTOR


def merge_nodes(nodes: DataFrame, factor: float = ORIGIN_FACTOR) -> DataFrame:
    """Nodes (agent_ord, agent, ...) by id: counts add up, dates widen, arrays unite in the order of agents, with provenance.

    Arrays are united where they are given (source_files, aliases, excerpts).
    """
    n = nodes.filter(~F.coalesce("hive_exclude", F.lit(False))) if "hive_exclude" in nodes.columns else nodes
    united = []
    for c in ("source_files", "aliases", "excerpts"):
        if c in n.columns:
            in_order = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("agent_ord", F.coalesce(c, F.array().cast(dict(n.dtypes)[c])).alias("v")))), lambda x: x["v"]))
            if c == "excerpts":  # the first of each text
                firsts = F.filter(F.transform(in_order, lambda x: x), lambda x: x.isNotNull())
                united.append(F.slice(F.array_distinct(firsts), 1, EXCERPTS).alias(c))
            else:
                united.append(F.array_distinct(in_order).alias(c))
    g = n.groupBy("id").agg(
        F.min_by("label", "agent_ord").alias("label"), F.min_by("type", "agent_ord").alias("type"), F.sum("mention_count").alias("mention_count"),
        F.sum("reinforcement_count").alias("reinforcement_count"), F.min("first_seen").alias("first_seen"), F.max("last_reinforced").alias("last_reinforced"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("agent_ord", "agent"))), lambda x: x["agent"]), ",").alias("source_agents"),
        F.count_distinct("agent").alias("endorsements"), *united,
    )
    return g.withColumn("hive_weight", (F.col("mention_count") + F.col("reinforcement_count")) * F.lit(factor))


def merge_edges(edges: DataFrame, strict: bool = True) -> DataFrame:
    """Edges (agent_ord, ...) by id: the heavier wins. strict folds counts as observed: an edge that does not win doubles the count of the one that stays;
    otherwise the counts add up."""
    e = edges.groupBy("id").agg(
        F.min_by("source", "agent_ord").alias("source"), F.min_by("target", "agent_ord").alias("target"), F.max("weight").alias("weight"), F.sum("reinforcement_count").alias("total"),
        F.sort_array(F.collect_list(F.struct("agent_ord", "weight", "reinforcement_count"))).alias("seen"),
    )
    first = F.get("seen", F.lit(0))
    start = F.struct(first["weight"].alias("w"), first["reinforcement_count"].alias("r"))
    fold = lambda a, x: F.when(x["weight"] > a["w"], F.struct(x["weight"].alias("w"), (x["reinforcement_count"] + a["r"]).alias("r"))).otherwise(F.struct(a["w"].alias("w"), (a["r"] * 2).alias("r")))
    observed = F.aggregate(F.slice("seen", F.lit(2), F.size("seen")), start, fold)["r"]
    return e.select("id", "source", "target", "weight", (observed if strict else F.col("total")).alias("reinforcement_count"))


def brief(merged: DataFrame, top: int = 10) -> DataFrame:
    return merged.orderBy(F.desc("hive_weight"), "id").limit(top).select("id", "label", "type", "hive_weight", "source_agents", "endorsements")

"""Hybrid recall: meaning, graph, recency and importance blended into one ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import DEFAULT, RECALL, GraphConfig, RecallConfig
from mnemora.functions.dates import days_between
from mnemora.functions.text import query_terms
from mnemora.functions.weights import origin_factor
from mnemora.operators import graph, vectors


def semantic_scores(node_hits: DataFrame, episode_hits: DataFrame, links: DataFrame, config: RecallConfig = RECALL) -> DataFrame:
    """(id, semantic): the best of a node's own similarity and, discounted, that of episodes it takes part in; never below 0."""
    via = episode_hits.join(links, episode_hits["id"] == links["episode_id"]).select(F.col("node_id").alias("id"), (F.col("similarity") * config.episode_discount).alias("s"))
    return node_hits.select("id", F.col("similarity").alias("s")).unionByName(via).groupBy("id").agg(F.greatest(F.lit(0.0), F.max("s")).alias("semantic"))


def seeds(nodes: DataFrame, terms: list[str], config: RecallConfig = RECALL) -> DataFrame:
    """(id): nodes named by a term; where there is none, the best fuzzy matches."""
    spark = nodes.sparkSession
    exact = graph.find_nodes(nodes, spark.createDataFrame([(t,) for t in terms], "key string")).select("id").distinct()
    if not terms or exact.limit(1).count():
        return exact
    return graph.search(nodes, terms).orderBy(F.desc("match_score"), "id").limit(config.fuzzy_seeds).select("id")


def rank(nodes: DataFrame, semantic: DataFrame, graph_scores: DataFrame, now: Column, config: RecallConfig = RECALL, types: list[str] | None = None, since: str | None = None, until: str | None = None, least: float | None = None) -> DataFrame:
    """(id, label, type, score, semantic, graph, recency, importance), the best first. Dates are compared as strings."""
    c = semantic.select("id", "semantic").join(graph_scores.select("id", F.col("score").alias("graph")), "id", "full_outer")
    c = nodes.join(c, "id").withColumns({"semantic": F.coalesce("semantic", F.lit(0.0)), "graph": F.coalesce("graph", F.lit(0.0)), "_m": F.col("mention_count") + F.col("reinforcement_count")})
    top = c.agg(F.greatest(F.lit(1), F.max("_m")).alias("_top"))
    c = c.join(F.broadcast(top), how="cross")  # one row
    if types:
        c = c.filter(F.col("type").isin(*types))
    if since:
        c = c.filter(F.col("last_reinforced").cast("string") >= since)
    if until:
        c = c.filter(F.col("last_reinforced").cast("string") <= until)
    c = c.withColumns({
        "recency": F.greatest(F.lit(0.0), 1 - days_between(F.col("last_reinforced"), now) / 365), "importance": F.least(F.lit(1.0), F.col("_m") / F.col("_top")),
    })
    score = config.semantic * F.col("semantic") + config.graph * F.col("graph") + config.recency * F.col("recency") + config.importance * F.col("importance")
    c = c.withColumn("score", score)
    if least is not None:
        c = c.filter(F.col("score") >= least)
    return c.select("id", "label", "type", "score", "semantic", "graph", "recency", "importance").orderBy(F.desc(F.round("score", 9)), "id").limit(config.limit)


def recall(nodes: DataFrame, edges: DataFrame, terms: list[str], now: Column, node_hits: DataFrame, episode_hits: DataFrame, links: DataFrame, config: RecallConfig = RECALL, graph_config: GraphConfig = DEFAULT, **filters) -> DataFrame:
    """The ranking of nodes for a query, given its vector hits."""
    walked = graph.walk(nodes, edges, seeds(nodes, terms, config), now, config.hops, graph_config)
    return rank(nodes, semantic_scores(node_hits, episode_hits, links, config), walked, now, config, **filters)


def search_and_recall(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, links: DataFrame, text: str, vector: list[float] | None, now: Column, config: RecallConfig = RECALL, graph_config: GraphConfig = DEFAULT, **filters) -> DataFrame:
    """Recall from the query's text and vector: three times the limit of node hits, the limit of episode hits, then ranking.

    embeddings: id, type (node or episode), vector. Without a vector the graph alone finds candidates. The text's terms are few and are worked out on the driver.
    """
    terms = nodes.sparkSession.range(1).select(query_terms(F.lit(text)).alias("t")).first()["t"]
    if vector is None:
        none = embeddings.select("id", F.lit(0.0).alias("similarity")).filter("false")
        return recall(nodes, edges, terms, now, none, none, links, config, graph_config, **filters)
    hits = vectors.search(embeddings, vector, 3 * config.limit, kind="node"), vectors.search(embeddings, vector, config.limit, kind="episode")
    return recall(nodes, edges, terms, now, *hits, links, config, graph_config, **filters)


def recall_at(snapshots: DataFrame, load: Callable[[str], dict[str, DataFrame]], live: dict[str, DataFrame], moment: str, ranked: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Recall on the graph of the last snapshot at or before a moment, the live graph where there is none. ranked: from nodes and edges to results; decay is that of the present."""
    one = as_of(snapshots, snapshots.sparkSession.createDataFrame([(moment,)], "at string")).first()  # one row
    g = load(one["snapshot_id"]) if one["snapshot_id"] is not None else live
    return ranked(g["nodes"], g["edges"])


def with_verbatim(results: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Results with the claim and the source section of their canonical files, null where they have none. files: path, claim, source_text."""
    at = nodes.select("id", F.col("canonical_path").alias("_path"))
    own = files.select(F.col("path").alias("_path"), F.col("claim").alias("verbatim_claim"), F.col("source_text").alias("verbatim_source"))
    return results.join(at, "id", "left").join(own, "_path", "left").drop("_path")


def connections(results: DataFrame, nodes: DataFrame, edges: DataFrame, config: RecallConfig = RECALL) -> DataFrame:
    """(id, neighbor, label, relationship, weight): the strongest edges of each result; a self-loop counts once."""
    adj = graph.adjacency(edges).join(results.select(F.col("id").alias("node")), "node").dropDuplicates(["node", "edge_id"])
    top = graph.top_per_node(adj, config.connections)
    return top.join(nodes.select(F.col("id").alias("neighbor"), "label"), "neighbor").select(F.col("node").alias("id"), "neighbor", "label", F.col("type").alias("relationship"), "weight")


def episodes_of(results: DataFrame, episodes: DataFrame, links: DataFrame, config: RecallConfig = RECALL) -> DataFrame:
    """(node_id, episode_id, timestamp): the latest episodes of each result."""
    own = links.join(results.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("node_id", "episode_id").distinct()
    e = own.join(episodes.select(F.col("id").alias("episode_id"), "timestamp"), "episode_id")
    w = Window.partitionBy("node_id").orderBy(F.desc("timestamp"), "episode_id")
    return e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= config.episodes).drop("rank")


def as_of(snapshots: DataFrame, moments: DataFrame) -> DataFrame:
    """(at, snapshot_id): the last snapshot at or before each moment (string comparison), null where there is none.

    The snapshots of a graph, which retention keeps few, are one sorted array beside every moment: no range join.
    """
    seen = F.sort_array(F.collect_list(F.struct(F.col("created_at").cast("string").alias("at"), "id")))
    one = snapshots.agg(seen.alias("seen"))
    m = moments.select(F.col("at").cast("string").alias("at")).join(F.broadcast(one), how="cross")  # one row
    before = F.filter("seen", lambda s: s["at"] <= F.col("at"))
    return m.select("at", F.when(F.size(before) > 0, F.get(before, F.size(before) - 1)["id"]).alias("snapshot_id"))


def merge_hive(own: DataFrame, hive: DataFrame, own_nodes: DataFrame, limit: int = 10, configured: float = 0.6) -> DataFrame:
    """(id, label, score, origin): private and discounted shared results, the better of each id; private wins ties."""
    size = own_nodes.agg(F.count(F.lit(1)).alias("n"))
    h = hive.join(F.broadcast(size), how="cross").select("id", "label", (F.col("score") * origin_factor(F.col("n"), configured)).alias("score"), F.lit("hive").alias("origin"), F.lit(0).alias("k"))
    both = own.select("id", "label", "score", F.lit("private").alias("origin"), F.lit(1).alias("k")).unionByName(h)
    best = both.groupBy("id").agg(F.max(F.struct("score", "k", "label", "origin")).alias("b"))
    return best.select("id", "b.label", "b.score", "b.origin").orderBy(F.desc(F.round("score", 9)), "id").limit(limit)

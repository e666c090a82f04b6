"""Graph reads: adjacency, neighbourhoods, components, walks, scores, alerts, suggestions, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import DEFAULT, GraphConfig
from mnemora.functions.dates import days_between
from mnemora.functions.text import normalize
from mnemora.functions.weights import edge_weight
from mnemora.operators import dynamics
from mnemora.operators.components import contract


def adjacency(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, neighbor, edge_id, type, weight, ...) both ways, direction ignored; a self-loop stands twice. nodes: drops edges of unknown endpoints."""
    e = edges.withColumnRenamed("id", "edge_id")
    if nodes is not None:
        known = nodes.select("id")
        e = e.join(known, e["source"] == known["id"], "left_semi").join(known, e["target"] == known["id"], "left_semi")
    # one pass over the edges: each row becomes two
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("neighbor")), F.struct(F.col("target").alias("node"), F.col("source").alias("neighbor"))))
    return e.withColumn("_e", ends).select("_e.node", "_e.neighbor", *[c for c in e.columns if c not in ("source", "target")])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree); 0 where there is none, self-loops count twice."""
    d = adjacency(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(d, nodes["id"] == d["node"], "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def neighbors(edges: DataFrame, start: str, hops: int = 1) -> DataFrame:
    """(id, hop) of the nodes within some hops, the start left out."""
    adj = adjacency(edges).select("node", "neighbor")
    seen = adj.filter(F.col("node") == start).select(F.lit(start).alias("id"), F.lit(0).alias("hop")).limit(1)
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(adj, frontier["id"] == adj["node"]).select(F.col("neighbor").alias("id")).distinct()
        frontier = step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.filter("hop > 0")


def touched_edges(edges: DataFrame, start: str, hops: int = 1) -> DataFrame:
    """Edges met on the way to the nodes within some hops."""
    at = edges.sparkSession.createDataFrame([(start,)], "id string")
    inner = at.unionByName(neighbors(edges, start, hops - 1).select("id")) if hops > 1 else at
    met = adjacency(edges).join(inner, F.col("node") == inner["id"], "left_semi").select(F.col("edge_id").alias("id")).distinct()
    return edges.join(met, "id", "left_semi")


def related(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Direct neighbours by stored weight, one row an edge."""
    adj = adjacency(edges).filter(F.col("node") == node)
    return adj.join(nodes.select(F.col("id").alias("neighbor"), "label"), "neighbor").select("neighbor", "label", "edge_id", "weight").orderBy(F.desc("weight"), "edge_id")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component, isolated nodes their own."""
    links = adjacency(edges, nodes).select(F.col("node").alias("a"), F.col("neighbor").alias("b"))
    return nodes.select("id").join(contract(links).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def cluster_infos(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Per component: size, hub (most mentions, then least id), hub_label, hub_type, dominant_type, label."""
    m = nodes.join(comps, "id").select("component", "id", "label", "type", "mention_count")
    head = m.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("mention_count")).alias("k"), "id", "label", "type")).alias("h"))
    few = m.join(head.filter("size <= 3").select("component"), "component", "left_semi").groupBy("component").agg(F.sort_array(F.collect_list(F.struct("id", "label"))).alias("few"))
    types = m.groupBy("component", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "type"))).alias("t"))
    part = lambda x: F.concat((-x["k"]).cast("string"), F.lit(" "), x["type"], F.when(-x["k"] > 1, F.lit("s")).otherwise(F.lit("")))
    names = F.array_join(F.transform("few", lambda x: x["label"]), ", ")
    long = F.concat(F.col("h.label"), F.lit(" ("), F.array_join(F.transform(F.slice("t", 1, 2), part), ", "), F.lit(")"))
    return head.join(types, "component").join(few, "component", "left").select(
        "component", "size", F.col("h.id").alias("hub"), F.col("h.label").alias("hub_label"), F.col("h.type").alias("hub_type"),
        F.get("t", F.lit(0))["type"].alias("dominant_type"), F.when(F.col("size") <= 3, names).otherwise(long).alias("label"),
    )


def walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, now: Column, hops: int = 2, config: GraphConfig = DEFAULT) -> DataFrame:
    """(id, score): seeds 1; a node reached in hop h (from 0) has weight / (2 + h), the best over all edges taken from the frontier. No product along paths."""
    adj = adjacency(edges.withColumn("w", edge_weight(now, config)).filter(F.col("w") >= config.visibility_threshold)).select("node", "neighbor", "w")
    frontier = seeds.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    scores = frontier.withColumn("score", F.lit(1.0))
    visited = frontier
    for hop in range(hops):
        step = frontier.join(adj, frontier["id"] == adj["node"]).groupBy("neighbor").agg((F.max("w") / (2 + hop)).alias("score")).withColumnRenamed("neighbor", "id")
        scores = scores.unionByName(step)
        frontier = step.select("id").join(visited, "id", "left_anti")
        visited = visited.unionByName(frontier)
    return scores.groupBy("id").agg(F.max("score").alias("score"))


def node_scores(nodes: DataFrame, edges: DataFrame, now: Column, recent_days: int = 7) -> DataFrame:
    """(id, label, score, edge_count, days_since) as briefs rank nodes: counts and a bonus that fades in two pieces."""
    days = days_between(F.col("last_reinforced"), now)
    bonus = F.when(days <= recent_days, 1.0 - days / recent_days * 0.5).otherwise(F.greatest(F.lit(0.0), 0.5 - (days - recent_days) / 60))
    score = F.col("mention_count") * 0.3 + F.col("reinforcement_count") * 0.3 + bonus * 10 * 0.4
    d = degrees(nodes, edges)
    return nodes.select("id", "label", "type", score.alias("score"), days.alias("days_since")).join(d, "id").withColumnRenamed("degree", "edge_count")


def insight_scores(nodes: DataFrame, now: Column, recent_days: int = 7) -> DataFrame:
    """(id, label, score) as insights rank nodes: counts, and a bonus within the recent days."""
    recent = days_between(F.col("last_reinforced"), now) <= recent_days
    return nodes.select("id", "label", (F.col("mention_count") * 0.3 + F.col("reinforcement_count") * 0.3 + F.when(recent, 4.0).otherwise(0.0)).alias("score"))


def details(nodes: DataFrame, edges: DataFrame, node: str, n: int = 20) -> DataFrame:
    """(neighbor, label, type, weight): the strongest edges of a node with the label at their other end (its id where there is none)."""
    adj = adjacency(edges).filter(F.col("node") == node).dropDuplicates(["edge_id"])
    named = adj.join(nodes.select(F.col("id").alias("neighbor"), "label"), "neighbor", "left").withColumn("label", F.coalesce("label", "neighbor"))
    return named.orderBy(F.desc("weight"), "edge_id").limit(n).select("neighbor", "label", "type", "weight")


def orphans(nodes: DataFrame, edges: DataFrame, config: GraphConfig = DEFAULT) -> DataFrame:
    """Nodes without an edge whose stored weight reaches the threshold."""
    active = edges.filter(F.col("weight") >= config.visibility_threshold)
    ends = active.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def health(nodes: DataFrame, edges: DataFrame, now: Column, config: GraphConfig = DEFAULT) -> DataFrame:
    """One row: totals, active edges, connected nodes, fading edges and the score in 0..1 that blends them."""
    t = config.visibility_threshold
    w = edge_weight(now, config)
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("weight") >= t).alias("active_edges"), F.count_if((w >= t) & (w <= 2 * t)).alias("fading_edges"))
    c = edges.filter(F.col("weight") >= t).select(F.explode(F.array("source", "target")).alias("id")).distinct().agg(F.count(F.lit(1)).alias("connected_nodes"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    one = e.join(c, how="cross").join(n, how="cross")  # three single rows
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(1.0))
    score = 0.5 * ratio("active_edges", "edges") + 0.5 * ratio("connected_nodes", "nodes") - F.least(0.02 * F.col("fading_edges"), F.lit(0.3))
    return one.withColumn("health", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def stats(nodes: DataFrame, edges: DataFrame, config: GraphConfig = DEFAULT) -> DataFrame:
    """Rows (metric, key, value): totals, counts by type, average weight and dormant edges, by the stored weights."""
    n = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.count_if(F.col("weight") < config.visibility_threshold).alias("d"))
    row = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("value"))
    total_e = e.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("w").alias("w"), F.coalesce(F.sum("d"), F.lit(0)).alias("d"))
    out = row(n, "nodes_of_type", F.col("type"), F.col("n")).unionByName(row(e, "edges_of_type", F.col("type"), F.col("n")))
    out = out.unionByName(row(n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "nodes", F.lit(""), F.col("n")))
    out = out.unionByName(row(total_e, "edges", F.lit(""), F.col("n"))).unionByName(row(total_e, "dormant_edges", F.lit(""), F.col("d")))
    return out.unionByName(row(total_e, "average_weight", F.lit(""), F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(F.lit(0.0))))


def _grams(text: Column, singles: Column | bool) -> Column:
    """Distinct pairs of neighbouring characters, and the characters themselves where ``singles`` says so."""
    n = F.length(text)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    one = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_distinct(F.concat(pairs, F.when(F.lit(singles) if isinstance(singles, bool) else singles, one).otherwise(F.array().cast("array<string>"))))


def name_grams(nodes: DataFrame, singles: bool = False) -> DataFrame:
    """An inverted index of names (labels and aliases): gram, id, label, name (normalised), grams (how many the name has). Names of one character, and with ``singles`` all, are also found by single characters."""
    names = nodes.select("id", "label", F.explode(F.array_distinct(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    names = names.withColumn("name", normalize(F.col("name"))).distinct()
    g = _grams(F.col("name"), (F.length("name") == 1) | F.lit(singles))
    return names.withColumn("_g", g).select("id", "label", "name", F.size("_g").alias("grams"), F.explode("_g").alias("gram"))


def search(nodes: DataFrame, terms: list[str], kind: str | None = None, since_days: int | None = None, now: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """(id, label, match_score > 0): the mean over the terms of the best match with a name (label or alias); of a type, reinforced so few days ago.

    Terms meet names through shared pairs of characters (index: name_grams of the nodes, if it is kept). A match within k edits keeps all but 2k of a term's pairs, a
    name inside a term has all of its own there, so counts of shared pairs rule most names out before any distance is computed. A blank term meets every name.
    """
    if kind is not None:
        nodes = nodes.filter(F.col("type") == kind)
    if since_days is not None:
        nodes = nodes.filter(days_between(F.col("last_reinforced"), now) <= since_days)
    t = nodes.sparkSession.createDataFrame([(i, x) for i, x in enumerate(terms)], "i int, term string").select("i", normalize(F.col("term")).alias("term"))
    sizes = [(r["i"], r["n"]) for r in t.select("i", F.length("term").alias("n")).collect()]  # a stated list
    short, blank = any(n == 1 for _, n in sizes), [i for i, n in sizes if n == 0]
    every = name_grams(nodes, short) if index is None or short else index.join(nodes.select("id"), "id", "left_semi")
    asked = t.withColumn("_g", _grams(F.col("term"), True)).withColumn("pairs", F.size(_grams(F.col("term"), F.length("term") == 1))).select("i", "term", "pairs", F.explode("_g").alias("gram"))
    met = every.join(F.broadcast(asked), "gram").groupBy("id", "label", "name", "grams", "i", "term", "pairs").agg(F.count(F.lit(1)).alias("shared"))
    name, term = F.col("name"), F.col("term")
    longer = F.greatest(F.length(term), F.length(name), F.lit(1))
    met = met.filter((F.col("shared") >= F.col("pairs") - 2 * F.floor(0.3 * longer + 1e-9)) | (F.col("shared") >= F.col("grams")))
    far = F.levenshtein(term, name) / longer
    near = (F.abs(F.length(term) - F.length(name)) <= 0.3 * longer) & (far <= 0.3)
    one = F.when(name == term, 1.0).when(name.contains(term), 0.8).when(term.contains(name), 0.6).when(near, 0.4 * (1 - far)).otherwise(0.0)
    scored = met.select("id", "label", "i", one.alias("s"))
    names = nodes.select("id", "label", F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("n"))
    empty = F.exists("n", lambda x: normalize(x) == "")
    for i in blank:
        scored = scored.unionByName(names.select("id", "label", F.lit(i).alias("i"), F.when(empty, 1.0).otherwise(0.8).alias("s")))
    others = [i for i, n in sizes if n]
    if others:  # a blank name stands in every term
        scored = scored.unionByName(names.filter(empty).select("id", "label", F.explode(F.array(*[F.lit(i) for i in others])).alias("i"), F.lit(0.6).alias("s")))
    best = scored.groupBy("id", "label", "i").agg(F.max("s").alias("s"))
    return best.groupBy("id", "label").agg((F.sum("s") / len(terms)).alias("match_score")).filter("match_score > 0")


def find_nodes(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id) by raw id, then label, then alias; of several the least id. keys: key."""
    k = keys.select("key", normalize(F.col("key")).alias("k")).distinct()
    by = nodes.select(F.col("id").alias("k"), "id", F.lit(0).alias("tier"))
    by = by.unionByName(nodes.select(normalize(F.col("label")).alias("k"), "id", F.lit(1).alias("tier")))
    by = by.unionByName(nodes.select(F.explode("aliases").alias("a"), "id").select(normalize(F.col("a")).alias("k"), "id", F.lit(2).alias("tier")))
    best = by.groupBy("k").agg(F.min(F.struct("tier", "id")).alias("b"))
    raw = by.filter("tier = 0").select(F.col("k").alias("key"), F.col("id").alias("raw"))
    return k.join(best, "k", "left").join(raw, "key", "left").select("key", F.coalesce("raw", "b.id").alias("id")).filter("id is not null")


# suggestions


def _pair_key(a: str = "source", b: str = "target") -> list[Column]:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def suggest_pending(nodes: DataFrame, pending: DataFrame, config: GraphConfig = DEFAULT) -> DataFrame:
    """Pending pairs one sighting short of an edge."""
    t = config.co_occurrence_threshold
    near = pending.filter(F.col("count") >= max(1, t - 1)).join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return near.select("source", "target", F.lit("pending-near-threshold").alias("reason"), F.least(F.col("count") / t, F.lit(0.95)).alias("confidence"))


def suggest_structural_holes(nodes: DataFrame, edges: DataFrame, pending: DataFrame, pool: int = 30) -> DataFrame:
    """Pairs of the best connected nodes (degree 3 or more, the first ``pool``) that share two neighbours or more and no edge."""
    top = degrees(nodes, edges).filter("degree >= 3").orderBy(F.desc("degree"), "id").limit(pool)
    adj = adjacency(edges).select("node", "neighbor").distinct().join(F.broadcast(top.withColumnRenamed("id", "node")), "node")
    a, b = adj.withColumnsRenamed({"node": "x", "degree": "dx"}), adj.withColumnsRenamed({"node": "y", "degree": "dy"})
    shared = a.join(b, "neighbor").filter("x < y").groupBy("x", "y", "dx", "dy").agg(F.count(F.lit(1)).alias("shared")).filter("shared >= 2")
    known = edges.select(*_pair_key()).unionByName(pending.select(*_pair_key()))
    free = shared.join(known, ["x", "y"], "left_anti")
    return free.select(F.col("x").alias("source"), F.col("y").alias("target"), F.lit("structural-hole").alias("reason"), (F.least(F.col("shared") / F.least("dx", "dy"), F.lit(0.9)) * 0.8).alias("confidence"))


def suggest_type_bridges(nodes: DataFrame, edges: DataFrame, weight: float = 0.3) -> DataFrame:
    """Strong co-occurrences of nodes of different types, one a person or project, both of degree two or more."""
    n = nodes.join(degrees(nodes, edges), "id").select("id", "type", "degree")
    a, b = n.withColumnsRenamed({"id": "source", "type": "ta", "degree": "da"}), n.withColumnsRenamed({"id": "target", "type": "tb", "degree": "db"})
    e = edges.filter((F.col("type") == "co-occurrence") & (F.col("weight") >= weight)).join(a, "source").join(b, "target")
    e = e.filter("ta <> tb and da >= 2 and db >= 2 and (ta in ('person', 'project') or tb in ('person', 'project'))")
    return e.select("source", "target", F.lit("type-bridge").alias("reason"), F.least("weight", F.lit(0.85)).alias("confidence"))


def suggestions(nodes: DataFrame, edges: DataFrame, pending: DataFrame, most: int = 10, config: GraphConfig = DEFAULT) -> DataFrame:
    every = suggest_pending(nodes, pending, config).unionByName(suggest_structural_holes(nodes, edges, pending)).unionByName(suggest_type_bridges(nodes, edges))
    return every.orderBy(F.desc("confidence"), "reason", "source", "target").limit(most)


# insights


def _aged(nodes: DataFrame, degree: DataFrame, now: Column) -> DataFrame:
    age = days_between(F.col("first_seen"), now)
    return nodes.join(degree, "id").withColumns({"age": F.when(age == 0, 1).otherwise(age), "days_since": days_between(F.col("last_reinforced"), now)})


def emerging(nodes: DataFrame, degree: DataFrame, now: Column, recent_days: int = 7, top: int = 10) -> DataFrame:
    """Young nodes that are mentioned often for their age. degree: (id, degree)."""
    n = _aged(nodes, degree, now).withColumn("velocity", F.col("mention_count") / F.col("age"))
    n = n.filter((F.col("age") <= 2 * recent_days) & (F.col("velocity") >= 0.5) & (F.col("degree") >= 2))
    return n.orderBy(F.desc("velocity"), "id").limit(top).select("id", "label", "degree", "velocity")


def anchors(nodes: DataFrame, edges: DataFrame, now: Column, top: int = 10) -> DataFrame:
    """Well connected and often mentioned nodes."""
    n = _aged(nodes, degrees(nodes, edges), now).filter("degree >= 5 and mention_count >= 3")
    n = n.withColumn("anchor_score", F.col("degree") * 0.5 + F.col("mention_count") * 0.3 + F.col("reinforcement_count") * 0.2)
    return n.orderBy(F.desc(F.round("anchor_score", 9)), "id").limit(top).select("id", "label", "degree", "anchor_score")


def fading_important(nodes: DataFrame, edges: DataFrame, now: Column, recent_days: int = 7, top: int = 10, config: GraphConfig = DEFAULT) -> DataFrame:
    """Connected nodes, not seen of late, whose edges are weak now."""
    w = adjacency(edges.withColumn("w", edge_weight(now, config))).groupBy("node").agg(F.avg("w").alias("avg_weight"))
    n = _aged(nodes, degrees(nodes, edges), now).filter((F.col("degree") >= 3) & (F.col("mention_count") >= 2) & (F.col("days_since") > recent_days))
    n = n.join(w, n["id"] == w["node"]).filter("avg_weight < 0.4")
    return n.orderBy(F.desc("degree"), "id").limit(top).select("id", "label", "degree", "avg_weight")


def brief(nodes: DataFrame, edges: DataFrame, now: Column, top: int = 20, recent_days: int = 7, config: GraphConfig = DEFAULT) -> dict[str, DataFrame]:
    """The tables of a brief."""
    scored = node_scores(nodes, edges, now, recent_days)
    order = [F.desc(F.round("score", 9)), "id"]
    return {
        "top": scored.orderBy(*order).limit(top), "active": scored.filter(F.col("days_since") <= recent_days).orderBy(*order),
        "fading": dynamics.with_labels(dynamics.fading(edges, now, config), nodes).orderBy("days_left", "id"),
        "clusters": cluster_infos(nodes, components(nodes, edges)).orderBy(F.desc("size"), "component"), "stats": stats(nodes, edges, config),
    }


def viz_projection(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Nodes with degree and strongest edge, edges with their first five pieces of evidence."""
    a = adjacency(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.max("weight").alias("max_weight"))
    n = nodes.join(a, nodes["id"] == a["node"], "left").drop("node").withColumns({"degree": F.coalesce("degree", F.lit(0)), "max_weight": F.coalesce("max_weight", F.lit(0.0))})
    return {"nodes": n, "edges": edges.withColumn("evidence", F.slice("evidence", 1, 5)) if "evidence" in edges.columns else edges}


def top_per_node(adj: DataFrame, n: int = 5) -> DataFrame:
    """The strongest edges of each node."""
    w = Window.partitionBy("node").orderBy(F.desc("weight"), "edge_id")
    return adj.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

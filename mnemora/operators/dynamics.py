"""Decay, reinforcement and feedback of edges, nodes and procedures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.config import DEFAULT, EVIDENCE, GraphConfig
from mnemora.functions.dates import days_between
from mnemora.functions.weights import current_weight, days_until_dormant, edge_weight, stability


def decayed(edges: DataFrame, now: Column, config: GraphConfig = DEFAULT) -> DataFrame:
    """Edges with their weight at an instant."""
    return edges.withColumn("weight", edge_weight(now, config))


def decay_summary(edges: DataFrame, now: Column, config: GraphConfig = DEFAULT) -> DataFrame:
    """One row: edges that lost weight since it was stored, and edges below the threshold."""
    after = edge_weight(now, config)
    return edges.select((after < F.col("weight")).alias("d"), (after < config.visibility_threshold).alias("z")).agg(F.count_if("d").alias("decayed"), F.count_if("z").alias("dormant"))


def fading(edges: DataFrame, now: Column, config: GraphConfig = DEFAULT) -> DataFrame:
    """Edges whose present weight lies between the threshold and twice it, with days_since, current_weight and days_left."""
    days = days_between(F.col("last_reinforced"), now)
    e = edges.withColumn("days_since", days).withColumn("current_weight", current_weight(F.col("base_weight"), F.col("reinforcement_count"), F.col("days_since"), config))
    e = e.filter((F.col("current_weight") >= config.visibility_threshold) & (F.col("current_weight") <= 2 * config.visibility_threshold))
    return e.withColumn("days_left", days_until_dormant(F.col("base_weight"), F.col("reinforcement_count"), F.col("days_since"), config))


def with_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_label and target_label; an unknown endpoint is shown by its id."""
    n = nodes.select("id", "label")
    a, b = n.withColumnsRenamed({"id": "_s", "label": "_sl"}), n.withColumnsRenamed({"id": "_t", "label": "_tl"})
    out = edges.join(a, edges["source"] == a["_s"], "left").join(b, edges["target"] == b["_t"], "left")
    return out.withColumn("source_label", F.coalesce("_sl", "source")).withColumn("target_label", F.coalesce("_tl", "target")).drop("_s", "_sl", "_t", "_tl")


def first_rows(rows: DataFrame, keys: list[str], order: list[str], n: int, what: Column, name: str) -> DataFrame:
    """(keys, name): an array of the first n rows of each key. The rank is limited before the shuffle, so a hot key sends n rows a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    few = rows.select(*keys, F.struct(*order).alias("_o"), what.alias("_w"), F.row_number().over(w).alias("_r")).filter(F.col("_r") <= n)
    return few.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_w"))), lambda x: x["_w"]).alias(name))


def graduate(observations: DataFrame, config: GraphConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(edges, pending) of pair observations (source, target, file, section, ord, date, context), in closed form.

    A pair of n sightings in the order of (file, section, ord) is pending below the graduation count g; else it is an edge reinforced n - g times,
    with its first g sightings as evidence and later ones while there are fewer than 20.
    """
    g = config.graduation
    order = F.struct("file", "section", "ord")
    one = F.struct("file", "date", "context")
    seen = first_rows(observations, ["source", "target"], ["file", "section", "ord"], EVIDENCE, one, "evidence")
    grouped = observations.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.min_by("date", order).alias("first"), F.max_by("date", order).alias("last"))
    grouped = grouped.join(seen, ["source", "target"])
    base = config.base_weights["co-occurrence"]
    rc = F.col("n") - g
    edges = grouped.filter(F.col("n") >= g).select(
        F.concat_ws("--", "source", "target", F.lit("co-occurrence")).alias("id"), "source", "target", F.lit("co-occurrence").alias("type"), F.lit(False).alias("directed"),
        F.lit(base).alias("weight"), F.lit(base).alias("base_weight"), rc.alias("reinforcement_count"), F.col("first").alias("first_formed"),
        F.col("last").alias("last_reinforced"), F.when(rc == 0, F.lit(1.0)).otherwise(stability(rc, config)).alias("stability"), "evidence",
    )
    pending = grouped.filter(F.col("n") < g).select("source", "target", F.lit("co-occurrence").alias("type"), F.col("n").alias("count"), F.col("first").alias("first_seen"), "evidence")
    return edges, pending


def feedback_edges(edges: DataFrame, ratings: DataFrame) -> DataFrame:
    """Edges after ratings (node_id, rating in -1..1) of their endpoints: praise reinforces and stabilises, blame takes weight.

    Where both endpoints are rated, the source's rating is applied first.
    """
    r = ratings.select("node_id", F.col("rating").cast("double").alias("rating"))
    a, b = r.withColumnsRenamed({"node_id": "_a", "rating": "_ra"}), r.withColumnsRenamed({"node_id": "_b", "rating": "_rb"})
    e = edges.join(a, edges["source"] == a["_a"], "left").join(b, edges["target"] == b["_b"], "left")
    for col in ("_ra", "_rb"):
        x = F.col(col)
        e = e.withColumns({
            "reinforcement_count": F.when(x > 0, F.col("reinforcement_count") + 1).otherwise(F.col("reinforcement_count")),
            "weight": F.when(x < 0, F.greatest(F.lit(0.0), F.col("weight") + 0.2 * x)).otherwise(F.col("weight")),
            "stability": F.when(x > 0, F.least(F.lit(10.0), F.col("stability") * (1 + x))).when(x < 0, F.greatest(F.lit(0.1), F.col("stability") * (1 + 0.5 * x))).otherwise(F.col("stability")),
        })
    return e.drop("_a", "_b", "_ra", "_rb")


def feedback_nodes(nodes: DataFrame, ratings: DataFrame) -> DataFrame:
    """Nodes with their reinforcement counted up or, not below 0, down."""
    out = nodes.join(ratings.select(F.col("node_id").alias("_n"), F.col("rating").alias("_r")), nodes["id"] == F.col("_n"), "left")
    step = F.when(F.col("_r") > 0, 1).when(F.col("_r") < 0, -1).otherwise(0)
    return out.withColumn("reinforcement_count", F.greatest(F.lit(0), F.col("reinforcement_count") + step).cast("long")).drop("_n", "_r")


def apply_feedback(procedures: DataFrame, feedback: DataFrame) -> DataFrame:
    """Procedures after their feedbacks (procedure_id, ord, feedback, at) in order."""
    seen = feedback.groupBy("procedure_id").agg(F.sort_array(F.collect_list(F.struct("ord", "feedback", "at"))).alias("_f"))
    p = procedures.join(seen, procedures["id"] == seen["procedure_id"], "left")
    start = F.struct(
        F.col("confidence").cast("double").alias("c"), F.col("stability").cast("double").alias("s"), F.col("applications").cast("long").alias("a"),
        F.col("contradictions").cast("long").alias("k"), F.col("flagged_for_review").alias("f"), F.col("last_applied").cast("string").alias("l"),
    )

    def step(x: Column, f: Column) -> Column:
        good, bad = f["feedback"] == "positive", f["feedback"] == "negative"
        c = F.when(good, F.least(F.lit(0.99), x["c"] + 0.1 * (1 - x["c"]))).when(bad, F.greatest(F.lit(0.01), x["c"] * 0.8)).otherwise(x["c"])
        k = x["k"] + F.when(bad, 1).otherwise(0)
        return F.struct(
            c.alias("c"), F.when(good, F.least(F.lit(2.0), x["s"] + 0.1)).otherwise(x["s"]).alias("s"), (x["a"] + F.when(good, 1).otherwise(0)).alias("a"),
            k.alias("k"), (x["f"] | (bad & (k >= 3) & (c < 0.3))).alias("f"), f["at"].cast("string").alias("l"),
        )

    none = F.array().cast("array<struct<ord:bigint,feedback:string,at:string>>")
    p = p.withColumn("_x", F.aggregate(F.coalesce(F.col("_f").cast("array<struct<ord:bigint,feedback:string,at:string>>"), none), start, step))
    new = {"confidence": "c", "stability": "s", "applications": "a", "contradictions": "k", "flagged_for_review": "f", "last_applied": "l"}
    return p.withColumns({k: F.col(f"_x.{v}") for k, v in new.items()}).drop("_x", "_f", "procedure_id")

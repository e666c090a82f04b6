"""Texts of briefs, alerts and suggestions, and what is remembered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.dates import days_ago
from mnemora.functions.text import memory_id, node_id


def _joined(df: DataFrame, text: Column, order: list, top: int, sep: str = ", ") -> DataFrame:
    """One row: the texts of the first rows in order."""
    few = df.orderBy(*order).limit(top).select(text.alias("t"), F.struct(*[F.monotonically_increasing_id()]).alias("k"))
    return few.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), sep).alias("t"))


def brief_text(brief: dict[str, DataFrame]) -> DataFrame:
    """(ord, line): the summary of a brief; lines without content are left out."""
    clusters = _joined(brief["clusters"], F.concat("hub_label", F.lit(" ("), F.col("size").cast("string"), F.lit(")")), [F.desc("size"), "component"], 3)
    active = _joined(brief["active"], F.concat("label", F.lit(" ("), F.col("edge_count").cast("string"), F.lit(" connections, "), days_ago(F.col("days_since")), F.lit(")")), [F.desc(F.round("score", 9)), "id"], 5)
    fading = _joined(brief["fading"], F.concat("source_label", F.lit(" ↔ "), "target_label", F.lit(" (~"), F.col("days_left").cast("string"), F.lit("d left)")), ["days_left", "id"], 5)
    s = brief["stats"].groupBy().pivot("metric", ["nodes", "edges", "dormant_edges", "average_weight"]).agg(F.first("value"))
    stats = s.select(F.format_string("Graph: %d nodes, %d edges (%d dormant), avg weight %.3f.", F.col("nodes").cast("long"), F.col("edges").cast("long"), F.col("dormant_edges").cast("long"), "average_weight").alias("t"))
    parts = [(0, "Active clusters: ", clusters), (1, "Recently active: ", active), (2, "Fading connections: ", fading)]
    out = stats.select(F.lit(3).alias("ord"), F.col("t").alias("line"))
    for i, head, df in parts:
        out = out.unionByName(df.filter("t <> ''").select(F.lit(i).alias("ord"), F.concat(F.lit(head), "t", F.lit(".")).alias("line")))
    return out


def focused(lines: DataFrame, word: str) -> DataFrame:
    """The lines that name a word, if more than two do; else all."""
    hit = F.lower("line").contains(word.lower())
    n = lines.agg(F.count_if(hit).alias("_n"))
    return lines.join(F.broadcast(n), how="cross").filter(hit | (F.col("_n") <= 2)).drop("_n")


def remembered(items: DataFrame, at: str, source: str = "mcp:remember") -> dict[str, DataFrame]:
    """nodes, edges and captures of things to remember (title, content, type, importance, entities array<string>): candidates, reinforced three times their importance."""
    ident = memory_id(F.lit("remember|"), F.col("title"), F.lit("|"), F.coalesce("content", F.lit("")))
    m = items.withColumn("id", ident)
    count = F.ceil(3 * F.coalesce("importance", F.lit(0.5))).cast("long")
    nodes = m.select(
        "id", F.col("title").alias("label"), F.coalesce("type", F.lit("concept")).alias("type"), F.lit(at).alias("first_seen"), F.lit(at).alias("last_reinforced"), F.lit(1).cast("long").alias("mention_count"),
        count.alias("reinforcement_count"), F.array(F.lit(source)).alias("source_files"), F.array(F.struct(F.lit(source).alias("file"), F.col("content").alias("text"), F.lit(at).alias("date"))).alias("excerpts"), F.lit("candidate").alias("status"),
    )
    to = m.select("id", F.explode_outer("entities").alias("entity")).filter("entity is not null").withColumn("target", node_id(F.col("entity")))
    edges = to.select(
        F.concat_ws("--", F.least("id", "target"), F.greatest("id", "target"), F.lit("explicit")).alias("id"), F.col("id").alias("source"), "target", F.lit("explicit").alias("type"), F.lit(False).alias("directed"),
        F.lit(0.8).alias("weight"), F.lit(0.8).alias("base_weight"), F.lit(0).cast("long").alias("reinforcement_count"), F.lit(at).alias("first_formed"), F.lit(at).alias("last_reinforced"), F.lit(1.0).alias("stability"),
    )
    captures = m.select("id", F.lit(at).alias("ts"), F.lit("memory").alias("kind"), "title", "content", "importance")
    return {"nodes": nodes, "edges": edges, "captures": captures}

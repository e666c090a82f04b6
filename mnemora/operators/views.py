"""Figures of dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.dates import days_floored


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average degree and weight."""
    one = nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("average_weight")), how="cross")  # two single rows
    n = F.col("nodes")
    return one.withColumns({
        "density": F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).otherwise(0.0), "average_degree": F.when(n > 0, 2 * F.col("edges") / n).otherwise(0.0), "average_weight": F.coalesce("average_weight", F.lit(0.0)),
    })


def histogram(values: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """(bucket, n) over equal parts of 0 to the largest value."""
    top = values.agg(F.greatest(F.lit(1.0), F.max(F.col(value).cast("double"))).alias("_top"))
    b = F.least(F.floor(F.col(value) / F.col("_top") * buckets), F.lit(buckets - 1)).cast("int")
    return values.join(F.broadcast(top), how="cross").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def ages(nodes: DataFrame, at: Column) -> DataFrame:
    return nodes.select("id", "label", days_floored(at, F.col("first_seen")).alias("age"))


def age_stats(aged: DataFrame) -> DataFrame:
    """One row: average, upper median, oldest age and label.

    The median is found in the counts of ages, of which there are as many as days.
    """
    by = aged.groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    run = by.withColumn("upto", F.sum("n").over(Window.orderBy("age"))).join(by.agg(F.sum("n").alias("all")), how="cross")  # days, and one row
    median = run.filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("age").alias("median_age"))
    rest = aged.agg(F.avg("age").alias("average_age"), F.max("age").alias("oldest_age"), F.min(F.struct((-F.col("age")).alias("k"), "label")).alias("o"))
    return rest.join(median, how="cross").select("average_age", "median_age", "oldest_age", F.col("o.label").alias("oldest"))


def timeline_stack(episodes: DataFrame, share: float = 0.02) -> DataFrame:
    """(lane, id, position, stack): marks that lie within a share of the axis from the first of their pile are stacked on it.

    A pile is anchored at its first mark, so the marks of a ``lane``, a column of the episodes, are folded in order, in one pass.
    """
    lane = episodes.schema["lane"].dataType.simpleString()

    def fold(table):
        import pyarrow as pa

        table = table.sort_by([("at", "ascending"), ("id", "ascending")])
        at = table.column("at").to_pylist()
        lo, width = (at[0], max(1.0, float(at[-1] - at[0]))) if at else (0, 1.0)
        positions, stacks, anchor, k = [], [], None, 0
        for x in at:
            p = float(x - lo) / width
            near = anchor is not None and p - anchor < share
            k = k + 1 if near else 0
            anchor = anchor if near else p
            positions.append(p)
            stacks.append(k)
        ids = [None if i is None else str(i) for i in table.column("id").to_pylist()]
        return pa.table([table.column("lane"), pa.array(ids, pa.string()), pa.array(positions, pa.float64()), pa.array(stacks, pa.int32())], names=["lane", "id", "position", "stack"])

    marks = episodes.select("lane", "at", "id").filter("at is not null")
    return marks.groupBy("lane").applyInArrow(fold, f"lane {lane}, id string, position double, stack int")


def centroid(positions: DataFrame) -> DataFrame:
    """One row: the mean of the positions (x, y, z) that are known, how many, and the largest distance from it (0 where there is none)."""
    p = positions.filter("x is not null and y is not null and z is not null")
    c = p.agg(*[F.coalesce(F.avg(k), F.lit(0.0)).alias(f"c{k}") for k in "xyz"], F.count(F.lit(1)).alias("n"))
    far = p.join(F.broadcast(c), how="cross").agg(F.max(F.sqrt(sum((F.col(k) - F.col(f"c{k}")) ** 2 for k in "xyz"))).alias("spread"))  # one row
    return c.join(far, how="cross").select("cx", "cy", "cz", "n", F.coalesce("spread", F.lit(0.0)).alias("spread"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, share) of each value's part of all rows."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    every = n.agg(F.sum("n").alias("_all"))
    return n.join(F.broadcast(every), how="cross").select(key, "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


def rate_limited(requests: DataFrame, key: str, ts: str, most: int, window: str = "1 minute") -> DataFrame:
    """(key, start, n, over) of requests in fixed windows; over: those beyond the most that a window allows."""
    w = requests.groupBy(key, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("w.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - most).alias("over"))


def type_cube(nodes: DataFrame) -> DataFrame:
    """Counts of nodes by type and year first seen, with all subtotals (null: all)."""
    return nodes.withColumn("year", F.year("first_seen")).cube("type", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("mention_count").alias("mentions"))


def memories(nodes: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Nodes as a client sees them: id, label, type, score (null without scores: id, score) and the texts of their excerpts."""
    none = F.array().cast("array<struct<file:string,text:string,date:string>>")
    n = nodes.select("id", "label", "type", F.transform(F.coalesce("excerpts", none), lambda x: x["text"]).alias("excerpts"))
    n = n.withColumn("score", F.lit(None).cast("double")) if scores is None else n.join(scores.select("id", "score"), "id", "left")
    return n.select("id", "label", "type", "score", "excerpts")


def shown_procedures(procedures: DataFrame) -> DataFrame:
    """Procedures as a client sees them, without what they were learned of and how stable they are."""
    return procedures.select("id", "statement", "type", "trigger_keywords", "trigger_contexts", "confidence", "applications", "contradictions", "flagged_for_review")

"""Connected components of links between nodes, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.shared import small_enough, written

#: Components whose least nodes may be broadcast (one row of two nodes each).
BROADCAST_ROWS = 300_000
#: Maps of rounds that are composed in one plan.
COMPOSED = 6


def contract(links: DataFrame, least: bool = True) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component (with least=False any one node of it). links: a, b.

    In each round every node that still has links moves to the neighbour, or itself, of the least hash, and on to where that
    one moves; links are then drawn between the nodes moved to. Hashes are drawn anew each round, so a chain in any order
    of its ids loses a constant share of its nodes a round, and rounds are logarithmic. Only what has links left goes into the
    next round; the rounds' maps shrink with it and are composed from the last to the first. Nothing is gathered.
    """
    own = links.select("a", "b").filter("a <> b")
    both = written(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    maps: list[DataFrame] = []
    while not maps or both.limit(1).count():
        drawn = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), c.alias("n"))  # noqa: B023, E731
        step = both.groupBy("a").agg(F.min(drawn(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least(drawn(F.col("a")), F.col("m"))["n"].alias("up"))
        step = written(step, "step")
        twice = step.alias("s").join(step.alias("t"), F.col("s.up") == F.col("t.node")).select(F.col("s.node").alias("node"), F.col("t.up").alias("up"))
        maps.append(written(twice, "up"))
        moved = lambda c, to: maps[-1].withColumnsRenamed({"node": c, "up": to})
        left = both.join(moved("a", "ra"), "a").join(moved("b", "rb"), "b")
        both = written(left.select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct(), "links")
    root = maps[-1].withColumnRenamed("up", "root")
    for k, m in enumerate(reversed(maps[:-1])):
        root = m.alias("m").join(root.alias("r"), F.col("m.up") == F.col("r.node"), "left").select("m.node", F.coalesce("r.root", "m.up").alias("root"))
        if k % COMPOSED == COMPOSED - 1:
            root = written(root, "roots")
    root = written(root, "roots")
    if not least:
        return root
    tops = written(root.groupBy("root").agg(F.min("node").alias("top")), "tops")
    return _joined(root, tops).select("node", F.col("top").alias("root"))


def _joined(root: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows with those of their component, which may hold a large share of all rows: broadcast if few, else a join that AQE splits."""
    return root.join(F.broadcast(tops) if small_enough(tops, BROADCAST_ROWS) else tops, "root")

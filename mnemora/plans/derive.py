"""The graph model over the driver tables, in Spark and in SQL.

Orders are sections, parts are entities: two parts of one order were seen together. The graph of a
directory is consolidated once for each session and kept as tables in the shared folder, as a
store would; queries then read its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.config import DEFAULT
from mnemora.functions.weights import stability
from mnemora.operators import dynamics
from mnemora.shared import drop_path, hadoop, kept

TRADE_NOW = "2001-09-01"
TYPE_OF = {"MEDIUM": "concept", "STANDARD": "tool", "LARGE": "project", "PROMO": "event", "SMALL": "person", "ECONOMY": "decision"}


def now() -> Column:
    return F.lit(TRADE_NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_id(key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("part:"), key.cast("string")), 256), 1, 16)


#: Bytes of the line items' files behind one task of orders, and one of pairs.
TASK_BYTES = 16 << 20


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many parts orders and pairs are dealt to: they grow with the tables, so that a task's rows do not."""
    fs, p = hadoop(spark, f"{sf_dir}/lineitem.parquet")
    return max(spark.sparkContext.defaultParallelism, -(-fs.getContentSummary(p).getLength() // TASK_BYTES))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, date, customer, parts): orders with their different parts in order. Lines and orders are dealt by order once; pairs are made of an order's row, without a join."""
    n = _tasks(spark, sf_dir)
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey").repartition(n, "o_orderkey")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("l_orderkey").alias("section"), F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("customer"), "parts")


def in_parts(m: DataFrame) -> DataFrame:
    """Orders as rows of their parts."""
    return m.select(*[c for c in m.columns if c != "parts"], F.explode("parts").alias("l_partkey"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_parts(orders(spark, sf_dir)).select("section", "l_partkey", "date", "customer")


def nodes_of(spark: SparkSession, sf_dir: str, m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of orders; by: columns of the orders that keep graphs apart."""
    c = in_parts(m).groupBy(*by, "l_partkey").agg(F.count(F.lit(1)).alias("mention_count"), F.min("date").alias("first_seen"), F.max("date").alias("last_reinforced"))
    return named_nodes(spark, sf_dir, c, by)


def named_nodes(spark: SparkSession, sf_dir: str, c: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of parts (l_partkey, mention_count, first_seen, last_reinforced) as nodes."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    kind = F.create_map(*[F.lit(x) for kv in TYPE_OF.items() for x in kv])[F.col("p_type")]
    return c.join(p, c["l_partkey"] == p["p_partkey"]).select(
        *by, part_id(F.col("p_partkey")).alias("id"), F.col("p_name").alias("label"), kind.alias("type"), F.array("p_brand").alias("aliases"), "first_seen", "last_reinforced",
        "mention_count", (F.col("mention_count") - 1).alias("reinforcement_count"),
    )


def seen_together(spark: SparkSession, sf_dir: str, m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, y, date): two parts of one order, by their keys, dealt by these."""
    a = m.select(*by, "date", "parts", F.posexplode("parts").alias("_i", "x"))
    p = a.select(*by, "x", F.explode(F.slice("parts", F.col("_i") + 2, F.size("parts"))).alias("y"), "date")
    return p.repartition(2 * _tasks(spark, sf_dir), "x", "y")


def pairs_of(spark: SparkSession, sf_dir: str, m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Observed pairs by the parts' keys; ``named_pairs`` makes the ids, once a pair."""
    return seen_together(spark, sf_dir, m, by).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def named_pairs(p: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    ids = p.select(*by, "n", "first", "last", part_id(F.col("x")).alias("i"), part_id(F.col("y")).alias("j"))
    return ids.select(*by, F.least("i", "j").alias("source"), F.greatest("i", "j").alias("target"), "n", "first", "last")


def often(pairs: DataFrame) -> DataFrame:
    """Pairs that are edges: the few that ids need be made of."""
    return pairs.filter(F.col("n") >= DEFAULT.graduation)


def edges_of(pairs: DataFrame, at: Column, by: tuple[str, ...] = ()) -> DataFrame:
    base, g = DEFAULT.base_weights["co-occurrence"], DEFAULT.graduation
    e = pairs.filter(F.col("n") >= g).select(
        *by, F.concat_ws("--", "source", "target", F.lit("co-occurrence")).alias("id"), "source", "target", F.lit("co-occurrence").alias("type"), F.lit(False).alias("directed"),
        F.lit(base).alias("weight"), F.lit(base).alias("base_weight"), (F.col("n") - g).alias("reinforcement_count"), F.col("first").alias("first_formed"), F.col("last").alias("last_reinforced"),
    )
    return dynamics.decayed(e.withColumn("stability", stability(F.col("reinforcement_count"))), at)


#: Graphs of this session by the tables' folder and state, with the paths of their tables.
_graphs: dict[tuple, tuple[dict[str, DataFrame], list[str]]] = {}
SNAPSHOT_DATES = ("1999-12-31", "2000-12-31", "2001-06-30")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What changes when the tables do."""
    out = []
    for name in ("lineitem", "orders", "part"):
        fs, p = hadoop(spark, f"{sf_dir}/{name}.parquet")
        out += [fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()]
    return tuple(out)


def cached(spark: SparkSession, sf_dir: str, kind: str, build) -> dict[str, DataFrame]:
    """Tables built once for the state that a folder is in; those of an earlier state are dropped. build: from a function that writes a table to tables by name."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, _state(spark, sf_dir))
    if key not in _graphs:
        for old in [k for k in _graphs if k[:3] == key[:3]]:
            _release(spark, old)
        paths: list[str] = []

        def write(df: DataFrame, label: str, lean: bool = False) -> DataFrame:
            out, path = kept(df, label, lean)
            paths.append(path)
            return out

        _graphs[key] = (build(write), paths)
    return _graphs[key][0]


def _release(spark: SparkSession, key: tuple) -> None:
    for path in _graphs.pop(key)[1]:
        drop_path(spark, path)


def release(spark: SparkSession) -> None:
    """Drops all graphs of the session and their tables."""
    for key in [k for k in _graphs if k[0] == spark.sparkContext.applicationId]:
        _release(spark, key)


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """nodes, edges (weights decayed to the evaluation time) and pending of the trade graph."""

    def build(write) -> dict[str, DataFrame]:
        m = orders(spark, sf_dir)
        pairs = write(pairs_of(spark, sf_dir, m), "trade-pairs")  # most are seen once: their ids are made where they are read
        pending = named_pairs(pairs.filter(F.col("n") < DEFAULT.graduation)).select("source", "target", F.lit("co-occurrence").alias("type"), F.col("n").alias("count"), F.col("first").alias("first_seen"))
        return {"nodes": write(nodes_of(spark, sf_dir, m), "trade-nodes"), "edges": write(edges_of(named_pairs(often(pairs)), now()), "trade-edges"), "pending": pending}

    return cached(spark, sf_dir, "trade", build)


def snapshot(spark: SparkSession, sf_dir: str, at: str) -> dict[str, DataFrame]:
    """The trade graph of the orders up to one of ``SNAPSHOT_DATES``, as it stood then. All dates are counted in one pass."""
    days = [F.lit(d).cast("timestamp_ntz") for d in SNAPSHOT_DATES]
    counts = [x for k, d in enumerate(days) for x in (F.count_if(F.col("date") <= d).alias(f"n{k}"), F.max(F.when(F.col("date") <= d, F.col("date"))).alias(f"last{k}"))]

    def build(write) -> dict[str, DataFrame]:
        m = orders(spark, sf_dir)
        first = F.min("date").alias("first")
        return {"parts": write(in_parts(m).groupBy("l_partkey").agg(first, *counts), "snapshot-parts"), "pairs": write(seen_together(spark, sf_dir, m).groupBy("x", "y").agg(first, *counts), "snapshot-pairs")}

    wide, k = cached(spark, sf_dir, "snapshots", build), SNAPSHOT_DATES.index(at)
    parts = wide["parts"].filter(F.col(f"n{k}") > 0).select("l_partkey", F.col(f"n{k}").alias("mention_count"), F.col("first").alias("first_seen"), F.col(f"last{k}").alias("last_reinforced"))
    pairs = wide["pairs"].filter(F.col(f"n{k}") > 0).select("x", "y", F.col(f"n{k}").alias("n"), "first", F.col(f"last{k}").alias("last"))
    return {"nodes": named_nodes(spark, sf_dir, parts), "edges": edges_of(named_pairs(often(pairs)), days[k])}


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_OF.items())


def days(a: str, b: str) -> str:
    return f"floor(abs(epoch_us({a}) - epoch_us({b})) / 86400000000.0)::BIGINT"


def weight(at: str) -> str:
    return f"greatest(0.0, base_weight * exp(-(0.015 * {days('last_reinforced', at)}) / (1 + 1.5 * ln(reinforcement_count + 1))))"


def ctes(p: str = "", until: str | None = None, agent: int | None = None) -> str:
    """SQL of mentions, nodes, pairs, edges and pending, names prefixed with p."""
    at = f"TIMESTAMP '{until or TRADE_NOW}'"
    where = f"WHERE o_orderdate <= {at}" if until else f"WHERE o_custkey % 3 = {agent}" if agent is not None else ""
    return f"""
{p}mentions AS (SELECT DISTINCT l_orderkey AS section, l_partkey AS part, o_orderdate AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey {where}),
{p}nodes AS (SELECT substr(sha256('part:' || p_partkey), 1, 16) AS id, p_name AS label, p_brand AS alias, CASE p_type {_CASE} END AS type, min(date) AS first_seen, max(date) AS last_reinforced,
  count(*) AS mention_count, count(*) - 1 AS reinforcement_count FROM {p}mentions JOIN part ON part = p_partkey GROUP BY p_partkey, p_name, p_brand, p_type),
{p}pairs0 AS (SELECT substr(sha256('part:' || a.part), 1, 16) AS i, substr(sha256('part:' || b.part), 1, 16) AS j, count(*) AS n, min(a.date) AS first, max(a.date) AS last
  FROM {p}mentions a JOIN {p}mentions b ON a.section = b.section AND a.part < b.part GROUP BY a.part, b.part),
{p}pairs AS (SELECT least(i, j) AS source, greatest(i, j) AS target, n, first, last FROM {p}pairs0),
{p}edges0 AS (SELECT source || '--' || target || '--co-occurrence' AS id, source, target, 'co-occurrence' AS type, 0.3::DOUBLE AS base_weight, n - 2 AS reinforcement_count,
  first AS first_formed, last AS last_reinforced, 1 + 1.5 * ln(n - 1) AS stability FROM {p}pairs WHERE n >= 2),
{p}edges AS (SELECT *, {weight(at)} AS weight FROM {p}edges0),
{p}adj AS (SELECT source AS node, target AS neighbor, id AS edge_id, type, weight, base_weight, reinforcement_count, last_reinforced FROM {p}edges
  UNION ALL SELECT target, source, id, type, weight, base_weight, reinforcement_count, last_reinforced FROM {p}edges),
{p}degree AS (SELECT n.id, count(node) AS degree FROM {p}nodes n LEFT JOIN {p}adj ON node = n.id GROUP BY n.id),
{p}pending AS (SELECT source, target, n AS count, first AS first_seen FROM {p}pairs WHERE n < 2)
"""


_I32 = "(((({x}) + 2147483648) & 4294967295) - 2147483648)"


def mock_vectors(rows: str) -> str:
    """SQL of ``mock`` (id, i from 1 to 64, x), the mock encoder's vectors of rows (id, text).

    The hash runs over UTF-16 units; 64 steps mix it, where a product is rounded to a double first; the vector is scaled in doubles and kept in single precision.
    """
    units = "flatten(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)] ELSE [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] END))"
    return f"""mock_t AS ({rows}),
mock_u AS (SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform({units}, lambda x: x::BIGINT)), lambda h, x: {_I32.format(x='h * 31 + x')}) AS h FROM mock_t WHERE text <> '' UNION ALL SELECT id, 0::BIGINT FROM mock_t WHERE text = ''),
mock_s AS (SELECT id, 0 AS i, h::BIGINT AS h, 0.0::FLOAT AS x FROM mock_u UNION ALL SELECT id, i + 1, h, ((h & 65535) / 65536.0::DOUBLE - 0.5)::FLOAT FROM (
  SELECT id, i, xor(b, floor(b / 32768.0)::BIGINT) AS h FROM (SELECT id, i, (((a::DOUBLE * 1540483477.0::DOUBLE)::HUGEINT + 170141183460469231722463931679029329920) % 4294967296)::BIGINT AS c,
    {_I32.format(x='c')} AS b FROM (SELECT id, i, xor({_I32.format(x='h * 8192')}, h) AS a FROM mock_s WHERE i < 64)))),
mock_n AS (SELECT id, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS norm FROM mock_s WHERE i > 0 GROUP BY id),
mock AS (SELECT id, i, (x::DOUBLE / norm)::FLOAT AS x FROM mock_s JOIN mock_n USING (id) WHERE i > 0)"""

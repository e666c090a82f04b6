"""A thin command line over a store: ``python -m mnemora.cli STORE COMMAND …``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mnemora.operators import dynamics, graph, procedures, store_ops, summaries, temporal, vectors
from mnemora.plans import consolidate
from mnemora.sources import graph_json, notes
from mnemora.store import GraphStore


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="mnemora")
    p.add_argument("store")
    p.add_argument("--now", default=None, help="evaluation time, an ISO timestamp; the present without it")
    c = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [a := c.add_parser(name), *[a.add_argument(x) for x in args]][0]
    add("consolidate", "folder")
    add("ingest", "messages")
    add("migrate", "file")
    add("query", "terms")
    add("similar", "text")
    add("history", "node")
    add("snapshot", "id")
    add("diff", "before").add_argument("after")
    add("forget", "node")
    add("procedures", "terms")
    for name in ("brief", "alerts", "insights", "suggest", "stats", "episodes", "snapshots"):
        add(name)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("mnemora").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = GraphStore(spark, a.store)
    now = F.lit(a.now).cast("timestamp_ntz") if a.now else F.localtimestamp()
    stamp = a.now or spark.sql("SELECT date_format(localtimestamp(), \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
    nodes, edges = store.table("nodes"), store.table("edges")
    edges = edges.withColumn("last_reinforced", F.col("last_reinforced").cast("timestamp_ntz")).withColumn("first_formed", F.col("first_formed").cast("timestamp_ntz"))
    timed = nodes.withColumn("last_reinforced", F.col("last_reinforced").cast("timestamp_ntz")).withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz"))
    if a.command == "consolidate":
        print(consolidate.consolidate(store, notes.discover(spark, a.folder), now))
    elif a.command == "ingest":
        print(consolidate.ingest(store, spark.read.json(a.messages).select("conv_id", "turn", "role", "text"), stamp))
    elif a.command == "migrate":
        print(graph_json.migrate(spark, a.file, store))
    elif a.command == "query":
        graph.search(nodes, a.terms.split()).orderBy(F.desc("match_score"), "id").show(20, False)
    elif a.command == "similar":
        vectors.search(store.table("embeddings"), [float(x) for x in vectors.mock_vectors([a.text])[0]]).show(10, False)
    elif a.command == "history":
        rows = None
        for s in store.table("snapshots").select("id").collect():
            one = store.snapshot(s["id"])["nodes"].filter(F.col("id") == a.node).select(F.lit(s["id"]).alias("snapshot_id"), "id", "mention_count")
            rows = one if rows is None else rows.unionByName(one)
        if rows is not None:
            temporal.history(rows, store.table("snapshots"), "mention_count").orderBy("created_at").show(100, False)
    elif a.command == "snapshot":
        print(store.create_snapshot(a.id, stamp))
    elif a.command == "diff":
        x, y = store.snapshot(a.before), store.snapshot(a.after)
        temporal.diff_stats(temporal.diff_nodes(x["nodes"], y["nodes"]), temporal.diff_edges(x["edges"], y["edges"])).show(1, False)
    elif a.command == "forget":
        print(store.forget(spark.createDataFrame([(a.node,)], "id string"), stamp))
    elif a.command == "procedures":
        procedures.match(store.table("procedures"), a.terms.split(), [], now).show(20, False)
    elif a.command == "brief":
        for r in summaries.brief_text(graph.brief(timed, edges, now)).orderBy("ord").collect():
            print(r["line"])
    elif a.command == "alerts":
        dynamics.with_labels(dynamics.fading(edges, now), nodes).orderBy("days_left", "id").select("source_label", "target_label", "days_left").show(20, False)
        graph.health(timed, edges, now).show(1, False)
    elif a.command == "insights":
        for f in (graph.emerging, graph.anchors, graph.fading_important):
            f(timed, edges, now).show(10, False)
    elif a.command == "suggest":
        graph.suggestions(nodes, edges, store.table("pending")).show(10, False)
    elif a.command == "stats":
        graph.stats(nodes, edges).show(50, False)
    elif a.command == "episodes":
        store_ops.list_episodes(store.table("episodes"), store.table("episode_entities")).select("timestamp", "type", "title").show(20, False)
    else:
        store.table("snapshots").orderBy(F.desc("created_at")).show(50, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

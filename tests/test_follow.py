from __future__ import annotations

from pyspark.sql import functions as F

from mnemora import follow
from mnemora.store import GraphStore


def test_a_view_follows_other_writers(spark, tmp_path):
    path = str(tmp_path / "s")
    a, b = GraphStore(spark, path), GraphStore(spark, path)
    node = lambda *rows: spark.createDataFrame([*rows], "id string, label string, aliases array<string>")
    edge = lambda *ends: spark.createDataFrame([(f"{x}--{y}", x, y, w) for x, y, w in ends], "id string, source string, target string, weight double")
    a.upsert(nodes=node(("n1", "One", ["Uno"]), ("n2", "Two", None), ("n3", "Three", None)), edges=edge(("n1", "n2", 0.5), ("n2", "n3", 0.4)))
    view = follow.View(a)

    def holds():
        """Derived tables are what the view's version gives, and lookups agree."""
        for name, d in view.derived.items():
            rows = lambda df: sorted(tuple(r[c] for c in df.columns) for r in df.collect())
            own = view.table(name)
            assert rows(own) == rows(d.derive(view.table(d.source)).select(own.columns))

    holds()
    near = lambda i: {(r["neighbor"], r["weight"]) for r in view.lookup("neighbors", spark.createDataFrame([(i,)], "node string")).collect()}
    ids = lambda *names: {r["name"]: r["id"] for r in view.ids_of(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert near("n2") == {("n1", 0.5), ("n3", 0.4)} and ids("UNO", "two", "none") == {"uno": "n1", "two": "n2"}
    # another writer: a new label and no alias, a heavier edge, an edge and a node gone
    b.upsert(nodes=node(("n1", "First", None), ("n4", "Two", None)), edges=edge(("n1", "n2", 0.9), ("n4", "n4", 0.1)))
    b.delete("edges", spark.createDataFrame([("n2--n3",)], "id string"))
    b.delete("nodes", spark.createDataFrame([("n3",)], "id string"))
    assert view.stale() and near("n2") == {("n1", 0.5), ("n3", 0.4)}  # still at its version
    assert view.refresh() == {"names": "delta", "neighbors": "delta"} and not view.stale()
    holds()
    assert near("n2") == {("n1", 0.9)} and near("n3") == set() and near("n4") == {("n4", 0.1)} and ids("uno", "first", "two", "three") == {"first": "n1", "two": "n2"}
    assert view.refresh() == {"names": "same", "neighbors": "same"}
    # the view's own writer and a compaction by the other
    a.upsert(edges=edge(("n1", "n4", 0.2)))
    b.compact("edges")
    assert view.refresh() == {"names": "same", "neighbors": "anew"}
    holds()
    assert near("n1") == {("n2", 0.9), ("n4", 0.2)}


def test_an_empty_store(spark, tmp_path):
    view = follow.View(GraphStore(spark, str(tmp_path / "s")))
    assert view.table("names").count() == 0 and not view.stale()
    view.store.upsert(nodes=spark.createDataFrame([("a", "A")], "id string, label string"))
    assert view.refresh()["names"] == "anew" and view.table("names").select(F.col("id")).first()["id"] == "a"

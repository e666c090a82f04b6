from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemora import keyed
from mnemora.plans import catalog
from mnemora.schemas import SCHEMA_VERSION, TABLES
from mnemora.store import GraphStore

DDL = "a string, b long, v string"


def table(spark, path, ddl=DDL, keys=("a", "b")):
    return keyed.KeyedTable(spark, str(path), "t", StructType.fromDDL(ddl), keys)


def model_of(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[:2]: r[2] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reads_equal_a_plain_table(spark, tmp_path, seed):
    """Upserts, deletes and compactions in any order against a dict; keys may be null."""
    random.seed(seed)
    t, state, plain = table(spark, tmp_path), keyed.EMPTY, {}
    key = lambda: (random.choice(["x", "y", "z", None]), random.choice([1, 2, 3, 4, None]))
    for step in range(7):
        new = {key(): random.choice(["p", "q", None]) for _ in range(random.randint(0, 6))}
        gone = {key() for _ in range(random.randint(0, 4))}
        rows = spark.createDataFrame([(*k, v) for k, v in new.items()], DDL)
        keys = spark.createDataFrame([*gone], "a string, b long")
        state = t.changed(state, rows, keys if step % 3 else None)
        plain = {k: v for k, v in plain.items() if not (step % 3 and k in gone)} | new
        if step in (2, 5):
            state = t.compacted(state, all_of_it=step == 5)
        assert model_of(t.rows(state)) == plain
    asked = {key() for _ in range(6)}
    assert model_of(t.lookup(state, spark.createDataFrame([*asked], "a string, b long"))) == {k: v for k, v in plain.items() if k in asked}


def test_a_delta_costs_its_own_rows(spark, tmp_path):
    t = table(spark, tmp_path, "id long, v string", ("id",))
    state = t.replaced(spark.range(200_000).withColumn("v", F.sha2(F.col("id").cast("string"), 256)))
    base = state["base"]["bytes"]
    rows = lambda n: spark.range(n).withColumn("v", F.sha2(F.lit("new"), 256))
    sizes = []
    for n in (10, 10_000):
        after = t.changed(state, rows(n))
        assert after["base"] == state["base"] and len(after["deltas"]) == len(state["deltas"]) + 1
        sizes.append(after["deltas"][-1]["bytes"])
        state = after
    assert sizes[0] < 10_000 and sizes[1] < 200_000 and base > 10_000_000
    state = t.changed(state, gone=spark.range(5, 8))
    assert state["deltas"][-1]["bytes"] < 10_000
    assert t.rows(state).count() == 199_997 and t.rows(state).filter("v like '%11507a0e2f5e69d5dfa40a62a1bd7b6ee57e6bcd85c67c9b8431b36fff21c437'").count() == 9_997


def test_folding_keeps_deltas_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FLOOR", 1)
    t = table(spark, tmp_path, "id long, v long", ("id",))
    state = t.replaced(spark.range(100_000).withColumn("v", F.lit(0).cast("long")))
    base = state["base"]
    for k in range(1, 12):
        state = t.compacted(t.changed(state, spark.range(k, k + 3).withColumn("v", F.lit(k).cast("long"))))
        assert len(state["deltas"]) <= keyed.DELTAS
    assert state["base"] == base  # small deltas are folded among themselves
    want = {i: max(k for k in range(1, 12) if k <= i < k + 3) for i in range(1, 14)}
    assert {r["id"]: r["v"] for r in t.rows(state).filter("id between 1 and 13").collect()} == want
    state = t.compacted(t.changed(state, spark.range(60_000).withColumn("v", F.lit(99).cast("long"))))
    assert not state["deltas"] and t.rows(state).filter("v = 99").count() == 60_000 and t.rows(state).count() == 100_000


def test_a_key_opens_one_file(spark, tmp_path):
    small = {"advisoryPartitionSizeInBytes": "200k", "coalescePartitions.minPartitionSize": "50k", "coalescePartitions.initialPartitionNum": "64"}
    for k, v in small.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        t = table(spark, tmp_path, "id long, v string", ("id",))
        state = t.replaced(spark.range(50_000).withColumn("v", F.sha2(F.col("id").cast("string"), 256)))
    finally:
        for k in small:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
    files = spark.read.parquet(state["base"]["path"]).inputFiles()
    assert len(files) > 10
    one = spark.createDataFrame([(4711,)], "id long")
    found = t.files_of(state, one)
    assert len(found) == 1 and spark.read.parquet(found[0]).filter("id = 4711").count() == 1
    assert t.lookup(state, one).count() == 1 and len(t.lookup(state, one).inputFiles()) == 1
    assert len(t.files_of(state, spark.range(0, 50_000, 10_000))) <= 5
    state = t.changed(state, gone=one)
    assert t.lookup(state, one).count() == 0 and t.lookup(state, spark.createDataFrame([(-1,)], "id long")).count() == 0


def test_store_lookup_changes_and_vacuum(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "s"))
    n = lambda *ids: spark.createDataFrame([(i, i.upper()) for i in ids], "id string, label string")
    s.upsert(nodes=n(*[f"n{i}" for i in range(300)]))
    v = s.upsert(nodes=n("n1", "new"))
    assert s.get("nodes", "new")["label"] == "NEW" and s.get("nodes", "none") is None
    s.upsert(meta=spark.createDataFrame([("k", "v")], "key string, value string"))
    s.delete("nodes", spark.createDataFrame([("n2",)], "id string"))
    rows, gone = s.changes_since(v, "nodes")
    assert rows.count() == 0 and [r["id"] for r in gone.collect()] == ["n2"]
    rows, gone = s.changes_since(v - 1, "nodes")
    assert {r["id"] for r in rows.collect()} == {"n1", "new"}
    assert s.changes_since(0, "nodes") is None
    before = {r["id"] for r in s.table("nodes").collect()}
    s.compact()
    assert s.changes_since(v, "nodes") is None
    assert s.vacuum() > 0 and {r["id"] for r in s.table("nodes").collect()} == before == {f"n{i}" for i in range(300)} - {"n2"} | {"new"}
    links = spark.createDataFrame([("e1", "n1", "topic"), ("e1", "n1", "mentioned"), ("e2", "n1", "topic")], "episode_id string, node_id string, role string")
    s.upsert(episode_entities=links)
    s.unlink(links.filter("episode_id = 'e1'"))
    assert [tuple(r) for r in s.table("episode_entities").collect()] == [("e2", "n1", "topic")]
    s.delete("episode_entities", spark.createDataFrame([("e2",)], "id string"))
    assert s.table("episode_entities").count() == 0


def test_two_writers(spark, tmp_path):
    """The second of two commits that began at one version fails and leaves no trace in what is read."""
    a, b = GraphStore(spark, str(tmp_path / "s")), GraphStore(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("k", "1")], "key string, value string")
    a.upsert(meta=one)
    stale = b.version()
    a.upsert(meta=one.withColumn("value", F.lit("2")))
    with pytest.raises(Exception, match="(?i)exist"):
        b._point(stale["n"], stale["tables"])
    assert b.get("meta", "k")["value"] == "2"


@pytest.mark.parametrize("version", range(1, SCHEMA_VERSION + 1))
def test_older_stores_open(spark, tmp_path, version):
    """Stores written in each schema before, whole tables under plain paths, open to the tables that the present schema would hold."""
    later = {"nodes": {5: ["hive_exclude"], 7: ["status", "canonical_path"]}, "embeddings": {6: ["vector_norm"]}}
    since = {"episodes": 2, "episode_entities": 2, "procedures": 3, "snapshots": 4, "forgotten": 8}
    full = {
        "nodes": spark.createDataFrame([("a", "A", 2), ("b", "B", 1)], "id string, label string, mention_count long"),
        "embeddings": spark.createDataFrame([("a", "node", [3.0, 4.0])], "id string, type string, vector array<float>"),
        "episodes": spark.createDataFrame([("e", "t")], "id string, title string"), "forgotten": spark.createDataFrame([("f", "t")], "id string, ts string"),
    }
    paths, path = {}, str(tmp_path / "s")
    for name, df in full.items():
        if since.get(name, 1) > version:
            continue
        gone = [c for step, columns in later.get(name, {}).items() if step > version for c in columns]
        columns = [f for f in StructType.fromDDL(TABLES[name][0]) if f.name not in gone]
        df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns]).write.parquet(p := f"{path}/tables/{name}-old")
        paths[name] = p
    (tmp_path / "s/versions").mkdir(parents=True)
    (tmp_path / f"s/versions/v{1:020d}.json").write_text(json.dumps({"n": 1, "schema": version, "tables": paths}))
    s = GraphStore(spark, path)
    nodes = {r["id"]: r for r in s.table("nodes").collect()}
    assert {i: r["mention_count"] for i, r in nodes.items()} == {"a": 2, "b": 1} and nodes["a"]["status"] is None
    assert nodes["a"]["hive_exclude"] is (False if version < 5 else None)
    assert s.table("embeddings").first()["vector_norm"] == (5.0 if version < 6 else None)
    assert s.table("episodes").count() == (version >= 2) and s.table("forgotten").count() == (version >= 8) and s.table("procedures").count() == 0
    # a commit to another table leaves old runs old; one to theirs brings them up
    s.upsert(meta=spark.createDataFrame([("k", "v")], "key string, value string"))
    assert s.get("nodes", "a")["hive_exclude"] is (False if version < 5 else None)
    s.upsert(nodes=spark.createDataFrame([("c", True)], "id string, hive_exclude boolean"))
    assert {r["id"]: r["hive_exclude"] for r in s.table("nodes").collect()} == {"a": False if version < 5 else None, "b": False if version < 5 else None, "c": True}
    assert s.version()["schema"] == SCHEMA_VERSION


@pytest.mark.parametrize("name", ["orders_in_deltas", "orders_in_deltas_compacted", "orders_looked_up"])
def test_queries(spark, sf_dir, same, name):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name])


def test_nodes_are_embedded_or_say_why_not(spark, tmp_path):
    from mnemora.operators import vectors
    from mnemora.plans.embedding import WARNINGS, embed_nodes

    s = GraphStore(spark, str(tmp_path / "s"))
    s.upsert(nodes=spark.createDataFrame([("a", "A"), ("b", "B")], "id string, label string"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    run = lambda *x, **k: {r["id"]: (r["embedded"], r["reason"], r["warning"]) for r in embed_nodes(s, ids(*x), **k).collect()}

    def failing(texts):
        raise OSError("down")

    assert run("a", embedder=None) == {"a": (False, "no-provider", "")}
    assert run("a", embedder=failing) == {"a": (False, "error", WARNINGS["error"])} and s.get("meta", "embedding_provider") is None
    assert run("a", "none", embedder=vectors.mock_vectors) == {"a": (True, None, "")} and s.get("meta", "embedding_provider")["value"] == "mock"
    assert run("b", embedder=vectors.mock_vectors, dimensions=3)["b"][1] == "encoder-mismatch" and run("b", embedder=vectors.mock_vectors, provider="other")["b"][1] == "encoder-mismatch"
    s.delete("embeddings", ids("a"))
    assert run("b", embedder=vectors.mock_vectors, provider="other")["b"][1:] == ("provider-config", WARNINGS["provider-config"])
    assert s.table("embeddings").count() == 0 and run("a", "b", embedder=vectors.mock_vectors) == {"a": (True, None, ""), "b": (True, None, "")}

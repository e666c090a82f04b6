from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.operators import truth, vectors
from mnemora.plans import consolidate
from mnemora.sources import captures, memory_files, notes
from mnemora.store import GraphStore
from mnemora.streaming import twins

from .five_notes import NOTES

NOTE = """---
date: 2026-02-03
---
before

## One
- [[Alpha]] item
- **bold** item

```
code [[Hidden]]
```

## Empty

## Two ##
text of two
"""


def test_sections():
    got = [(h, p, c) for h, p, _, _, c in notes.split_sections(NOTE)]
    assert got == [("(intro)", "(intro)", "before"), ("One", "## One", "[[Alpha]] item\nbold item"), ("Two", "## Two", "text of two")]
    assert notes.split_sections("plain")[0][4] == "plain" and notes.split_sections("") == []
    assert "**bold**" in notes.split_sections(NOTE, keep_markup=True)[1][4]


def test_discover_and_date(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "2026-01-01-a.md").write_text(NOTE)
    (tmp_path / "sub/2026-01-02.md").write_text("x")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/b.md").write_text("y")
    (tmp_path / "c.txt").write_text("z")
    files = notes.discover(spark, str(tmp_path), str(tmp_path / "none"), ignore=("skip",))
    dated = files.withColumn("d", notes.document_date(F.col("path"), F.col("text"), F.col("modified")))
    assert {r["path"].rsplit("/", 1)[1]: r["d"] for r in dated.collect()} == {"2026-01-01-a.md": "2026-02-03", "2026-01-02.md": "2026-01-02"}
    assert notes.discover(spark, str(tmp_path / "none")).count() == 0


def test_captures(spark, tmp_path):
    (tmp_path / "2026-01-01.jsonl").write_text('{"id": "mem_0123456789ab", "ts": "t1", "title": "a"}\nnot json\n\n{"kind": "tombstone", "id": "mem_0123456789ab", "ts": "t2"}\n{"title": "no id"}\n')
    got = captures.read(spark, str(tmp_path))
    assert got["entries"].count() == 1 and got["tombstones"].count() == 1 and got["errors"].count() == 2
    bad = spark.createDataFrame([("weird", "t"), ("mem_0123456789ab", "t")], "id string, ts string")
    ids = {r["id"] for r in captures.canonical_ids(bad).collect()}
    assert "mem_0123456789ab" in ids and all(len(i) == 16 for i in ids)


def test_memory_files(spark, tmp_path):
    good = "---\nid: mem_0123456789ab\ntype: fact\ncreated: '2026-01-01'\nodd: 1\n---\nThe claim about [[X]].\n\n## Source\nverbatim\n"
    (tmp_path / "global").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "global/a.md").write_text(good)
    (tmp_path / "global/b.md").write_text("no front matter")
    (tmp_path / ".hidden/c.md").write_text(good)
    rows = {r["path"]: r for r in memory_files.read(spark, str(tmp_path)).collect()}
    assert set(rows) == {"global/a.md", "global/b.md"}
    a = rows["global/a.md"]
    assert (a["error"], a["scope"], a["claim"], a["source_text"], a["wikilinks"], a["warnings"]) == (None, "global", "The claim about [[X]].", "verbatim", ["X"], ["unknown key odd"])
    assert rows["global/b.md"]["error"] == "no front matter"
    for change, error in (("type: fact", "unknown type"), ("id: mem_0123456789ab", "malformed id")):
        assert memory_files.parse("global/a.md", good.replace(change, change.split(":")[0] + ": nonsense"))["error"] == error
    text = memory_files.serialized(memory_files.parsed(spark.createDataFrame([("global/a.md", good)], "path string, text string"))).first()["text"]
    assert text.startswith("---\nid: mem_0123456789ab\ntype: fact\nstatus: active\n") and memory_files.parse("global/a.md", text)["error"] is None


def test_target_paths(spark):
    new = spark.createDataFrame([("m1", "Same Title", "global"), ("m2", "same title!", "global"), ("m3", "Other", None)], "id string, title string, scope string")
    taken = spark.createDataFrame([("global/same-title.md",)], "path string")
    got = {r["id"]: r["path"] for r in truth.target_paths(new, taken).collect()}
    assert got == {"m1": "global/same-title-2.md", "m2": "global/same-title-3.md", "m3": "global/other.md"}


def test_target_paths_of_titles_that_end_in_numbers(spark):
    new = spark.createDataFrame([("a", "Plan", "global"), ("b", "Plan", "global"), ("c", "Plan 2", "global"), ("d", "Plan", "global"), ("e", "Year 2024", "global"), ("f", "Plan 4", "global")], "id string, title string, scope string")
    taken = spark.createDataFrame([("global/plan.md",), ("global/year-2024.md",), ("global/plan-4.md",)], "path string")
    got = {r["id"]: r["path"] for r in truth.target_paths(new, taken).collect()}
    assert got == {"a": "global/plan-3.md", "b": "global/plan-5.md", "c": "global/plan-2.md", "d": "global/plan-6.md", "e": "global/year-2024-2.md", "f": "global/plan-4-2.md"}
    full = spark.createDataFrame([("global/plan.md",), *[(f"global/plan-{i}.md",) for i in range(2, 100)]], "path string")
    assert truth.target_paths(new.filter("id = 'a'"), full).first()["path"] is None


def test_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    n = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "id string, label string, mention_count long")
    e = spark.createDataFrame([("a--b--explicit", "a", "b", "explicit", False, 0.5)], "id string, source string, target string, type string, directed boolean, weight double")
    store.upsert(nodes=n, edges=e)
    store.create_snapshot("s1", "2026-01-01")
    store.upsert(nodes=spark.createDataFrame([("b", "B2", 3), ("c", "C", 1)], "id string, label string, mention_count long"))
    assert {r["id"]: r["label"] for r in store.table("nodes").collect()} == {"a": "A", "b": "B2", "c": "C"}
    assert store.snapshot("s1")["nodes"].count() == 2
    store.rename(spark.createDataFrame([("b", "z")], "old string, new string"))
    assert [r["id"] for r in store.table("edges").collect()] == ["a--z--explicit"]
    store.forget(spark.createDataFrame([("z",)], "id string"), "2026-02-01")
    assert store.table("edges").count() == 0 and store.table("forgotten").count() == 1 and {r["id"] for r in store.table("nodes").collect()} == {"a", "c"}
    store.drop_snapshots(["s1"])
    assert store.table("snapshots").count() == 0
    store.views()
    assert spark.sql("SELECT count(*) FROM nodes").first()[0] == 2


def test_consolidate_and_again(spark, tmp_path):
    by_file: dict[str, str] = {}
    for file, _, heading, _, content, _ in NOTES:
        by_file[file] = by_file.get(file, "") + f"## {heading}\n{content}\n"
    (tmp_path / "notes").mkdir()
    for name, content in by_file.items():
        (tmp_path / "notes" / name).write_text(content)
    store = GraphStore(spark, str(tmp_path / "store"))
    now = F.lit("2026-02-01").cast("timestamp_ntz")
    files = notes.discover(spark, str(tmp_path / "notes"))
    first = consolidate.consolidate(store, files, now)
    labels = {r["label"] for r in store.table("nodes").collect()}
    assert {"Search Index", "Web Shell", "Docker"} <= labels
    kinds = {r["type"] for r in store.table("edges").select("type").distinct().collect()}
    assert {"explicit", "co-occurrence", "causal"} <= kinds
    assert store.table("episode_entities").count() > 0
    assert consolidate.consolidate(store, files, now) == first
    talk = spark.createDataFrame([(1, 0, "user", "Is [[Search Index]] fast with Docker?"), (1, 1, "assistant", "Docker and [[Cache Layer]] help [[Search Index]].")], "conv_id int, turn int, role string, text string")
    consolidate.ingest(store, talk, "2026-02-01")
    assert "Cache Layer" in {r["label"] for r in store.table("nodes").collect()}
    n = store.table("episodes").count()
    consolidate.ingest(store, talk, "2026-02-02")
    assert store.table("episodes").count() == n


def test_incremental_stream_reads_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen = []
    each = lambda batch, n: seen.extend(r["id"] for r in batch.collect())
    twins.incremental(spark, str(tmp_path / "in"), str(tmp_path / "state"), each)
    spark.range(10, 12).write.mode("append").parquet(str(tmp_path / "in"))
    twins.incremental(spark, str(tmp_path / "in"), str(tmp_path / "state"), each)
    assert sorted(seen) == list(range(12))


def test_new_captures_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:01:00"), ("b", "2026-01-01 00:02:00")], "id string, t string").select("id", F.to_timestamp("t").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    gone = spark.createDataFrame([("b",)], "id string")
    out = []
    twins.run_once(twins.new_captures(twins.file_stream(spark, str(tmp_path / "in")), gone), lambda b, n: out.extend(r["id"] for r in b.collect()), str(tmp_path / "state"))
    assert out == ["a"]


def test_graph_documents(spark, tmp_path):
    import json

    from mnemora.sources import graph_json

    doc = {
        "nodes": {"a": {"id": "a", "label": "A", "type": "tool", "aliases": ["x"], "mentionCount": 2, "excerpts": [{"file": "f", "text": "t", "date": "d"}]}, "b": {"id": "b", "label": "B", "type": "tag"}},
        "edges": {"e": {"id": "e", "source": "a", "target": "b", "type": "explicit", "weight": 0.5, "baseWeight": 1.0}}, "config": {},
    }
    (tmp_path / "graph.json").write_text(json.dumps(doc))
    (tmp_path / "pending.json").write_text(json.dumps([{"source": "a", "target": "b", "type": "co-occurrence", "count": 1, "firstSeen": "d"}]))
    store = GraphStore(spark, str(tmp_path / "store"))
    graph_json.migrate(spark, str(tmp_path / "graph.json"), store)
    assert {r["id"]: (r["label"], r["mention_count"]) for r in store.table("nodes").collect()} == {"a": ("A", 2), "b": ("B", None)}
    assert store.table("edges").first()["base_weight"] == 1.0
    assert graph_json.read_pending(spark, str(tmp_path / "pending.json")).first()["first_seen"] == "d"
    lines = [json.loads(r["line"]) for r in graph_json.documents(store.table("nodes"), store.table("edges")).collect()]
    assert {x["id"] for x in lines} == {"a", "b", "e"}


def test_remember_and_command_line(spark, tmp_path, capsys):
    from mnemora import cli
    from mnemora.operators import summaries

    store = GraphStore(spark, str(tmp_path / "store"))
    items = spark.createDataFrame([("Use the cache", "It is faster.", "lesson", 0.9, ["Redis"]), ("Plain", None, None, None, None)], "title string, content string, type string, importance double, entities array<string>")
    new = summaries.remembered(items, "2026-01-01")
    store.upsert(nodes=new["nodes"], edges=new["edges"])
    assert {r["label"]: r["reinforcement_count"] for r in store.table("nodes").collect()} == {"Use the cache": 3, "Plain": 2} and store.table("edges").count() == 1
    where = ["--now", "2026-01-05T00:00:00", str(tmp_path / "store")]
    for command in (["brief"], ["alerts"], ["stats"], ["query", "cache"], ["snapshot", "s1"], ["snapshots"], ["suggest"]):
        assert cli.main([*where, *command]) == 0
    out = capsys.readouterr().out
    assert "Graph: 2 nodes, 1 edges" in out and "Recently active: Use the cache" in out
    lines = spark.createDataFrame([(0, "cache one"), (1, "cache two"), (2, "cache three"), (3, "other")], "ord int, line string")
    assert summaries.focused(lines, "CACHE").count() == 3 and summaries.focused(lines, "other").count() == 4


def test_notes_are_read_once_and_counts_move_by_what_changed(spark, tmp_path):
    folder, store = tmp_path / "notes", GraphStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "2026-01-01.md").write_text("## A\n[[Search Index]] and [[Web Shell]]\n## B\n[[Search Index]] with [[Web Shell]]\n")
    (folder / "2026-01-02.md").write_text("## C\n[[Search Index]] alone\n")
    now = F.lit("2026-02-01").cast("timestamp_ntz")
    state = lambda: {r["label"]: (r["mention_count"], r["reinforcement_count"], r["first_seen"]) for r in store.table("nodes").collect()}
    run = lambda: consolidate.consolidate(store, notes.discover(spark, str(folder)), now, embedder=vectors.mock_vectors)
    run()
    assert state()["Search Index"] == (3, 2, "2026-01-01") and state()["Web Shell"] == (2, 1, "2026-01-01")
    n = store.table("embeddings").count()
    assert n == store.table("nodes").count() + store.table("episodes").count()
    talk = lambda i, t: spark.createDataFrame([(i, 0, "user", t)], "conv_id int, turn int, role string, text string")
    consolidate.ingest(store, talk(1, "Is [[Search Index]] with [[Web Shell]] or [[Cache Layer]]?"), "2026-01-20")
    consolidate.ingest(store, talk(2, "Again [[Search Index]] with [[Web Shell]]."), "2026-01-25")
    assert state() == state() | {"Search Index": (5, 4, "2026-01-01"), "Web Shell": (4, 3, "2026-01-01"), "Cache Layer": (1, 0, "2026-01-20")}
    edge = store.table("edges").filter("type = 'co-occurrence' and reinforcement_count = 2").first()
    assert (edge["first_formed"], edge["last_reinforced"]) == ("2026-01-01", "2026-01-25") and len(edge["evidence"]) == 4
    # a changed note: two more sightings of one node, none of the other; what the talks said stays
    (folder / "2026-01-02.md").write_text("## C\n[[Search Index]] alone\n## D\n[[Search Index]]\n## E\n[[Search Index]] and [[Old Name]]\n")
    run()
    assert state() == state() | {"Search Index": (7, 6, "2026-01-01"), "Web Shell": (4, 3, "2026-01-01"), "Cache Layer": (1, 0, "2026-01-20"), "Old Name": (1, 0, "2026-01-02")}
    (folder / "2026-01-02.md").unlink()
    run()
    assert state()["Search Index"][:2] == (4, 3) and "Old Name" not in state() and "Cache Layer" in state()
    last = store.version()["n"]
    assert run() == last


def test_settings_and_graph_paths(spark, tmp_path):
    import json

    from mnemora.sources import settings

    base = f"file://{tmp_path}"
    (tmp_path / "g.json").write_text(json.dumps({"nodes": {"a": {"id": "a", "label": "A", "type": "tool"}}, "edges": {}}))
    (tmp_path / "bad.json").write_text("no json")
    (tmp_path / "mnemora.config.json").write_text(json.dumps({"memory": {"dir": "mem"}}))
    (tmp_path / "map.json").write_text(json.dumps({"aliases": {"a": "b"}, "ignore": ["x"]}))
    assert settings.load_graph(spark, f"{base}/g")["nodes"].count() == 1 and settings.load_graph(spark, f"{base}/g.json")["nodes"].count() == 1
    GraphStore(spark, f"{base}/s").replace(nodes=spark.createDataFrame([("z", "Z")], "id string, label string"))
    assert settings.load_graph(spark, f"{base}/s")["nodes"].first()["id"] == "z"
    with pytest.raises(FileNotFoundError):
        settings.load_graph(spark, f"{base}/none")
    assert settings.entity_map(spark, f"{base}/map.json") == ({"a": "b"}, ["x"]) and settings.entity_map(spark, f"{base}/bad.json") == ({}, [])
    assert settings.memory_dir(spark, f"{base}/g") == f"{base}/mem" and settings.load_config(spark, None) == {}
    assert settings.within("/a/b", "c/d") and not settings.within("/a/b", "../x") and not settings.within("/a/b", "/etc") and settings.within("/a/b", "")


def test_embeddings_of_one_encoder(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "node", "A"), ("b", "node", None)], "id string, type string, content string")
    assert store.set_provider("mock", 64) == 0
    store.put_embeddings(vectors.embed(rows))
    with pytest.raises(vectors.EncoderMismatch):
        store.put_embeddings(vectors.embed(rows, lambda t: [np.ones(3, np.float32) for _ in t], "other"))
    assert store.set_provider("mock", 64) == 0 and store.table("embeddings").count() == 2
    assert store.set_provider("other", 3) == 2 and store.table("embeddings").count() == 0

    def failing(texts):
        raise OSError("down")

    assert vectors.embed(rows, failing).count() == 0
    raw = spark.createDataFrame([(bytearray(np.array([1.5, -0.25, 0.0, 3e-40, 1e30], "<f4").tobytes()),), (bytearray(),)], "b binary")
    got = [r["v"] for r in raw.select(vectors.from_bytes(F.col("b")).alias("v")).collect()]
    assert np.array_equal(np.array(got[0], np.float32), np.array([1.5, -0.25, 0.0, 3e-40, 1e30], np.float32)) and got[1] == []


def test_truth_layer(spark, tmp_path):
    from mnemora.plans import truth_layer

    folder, store = tmp_path / "memory", GraphStore(spark, str(tmp_path / "store"))
    (folder / "global").mkdir(parents=True)
    (folder / ".capture").mkdir()
    memory = lambda i, body: f"---\nid: mem_{i:012x}\ntype: decision\ncreated: '2026-01-0{i}'\ntitle: Memory {i}\n---\n{body}\n"
    (folder / "global/one.md").write_text(memory(1, "We use [[SQLite]] and [[Redis]]."))
    (folder / "global/two.md").write_text(memory(2, "All of [[Redis]]."))
    entry = '{"id": "mem_%012x", "ts": "2026-01-05T00:00:00", "title": "%s", "content": "%s"}\n'
    (folder / ".capture/2026-01-05.jsonl").write_text(entry % (10, "Prefer tabs", "Tabs over spaces") + entry % (11, "Gone", "x") + '{"kind": "tombstone", "id": "mem_00000000000b", "ts": "2026-01-06"}\n')
    run = lambda: truth_layer.consolidate_truth(store, str(folder))
    out = run()
    assert out["promoted"]["files"] == 1 and out["compiled"]["errors"].count() == 0 and (folder / "global/prefer-tabs.md").exists()
    labels = lambda: {r["label"]: r["type"] for r in store.table("nodes").collect()}
    assert labels() == {"Memory 1": "decision", "Memory 2": "decision", "Prefer tabs": "concept", "SQLite": "concept", "Redis": "concept"}
    assert store.table("edges").count() == 3
    # salience goes back to the file, an edited link's edge goes, a deleted file's memory goes, a broken file's stays
    store.upsert(nodes=store.table("nodes").filter("label = 'Memory 1'").withColumn("reinforcement_count", F.lit(4).cast("long")))
    (folder / "global/two.md").write_text(memory(2, "None now."))
    (folder / "global/prefer-tabs.md").unlink()
    assert run()["salience"] == 1 and "reinforcement_count: 4" in (folder / "global/one.md").read_text()
    assert set(labels()) == {"Memory 1", "Memory 2", "SQLite", "Redis"} and store.table("edges").count() == 2
    assert not (folder / "global/prefer-tabs.md").exists()  # promoted once, not again
    (folder / "global/two.md").write_text("broken")
    assert run()["compiled"]["errors"].count() == 1 and "Memory 2" in labels()
    with pytest.raises(truth_layer.NotCompiled):
        truth_layer.rebuild(spark, str(folder), str(tmp_path / "again"))
    assert GraphStore(spark, str(tmp_path / "again")).version()["n"] == 0
    (folder / "global/two.md").write_text(memory(2, "Whole."))
    truth_layer.rebuild(spark, str(folder), str(tmp_path / "again"))
    again = {r["label"]: r["status"] for r in GraphStore(spark, str(tmp_path / "again")).table("nodes").collect()}
    assert set(again) == {"Memory 1", "Memory 2", "SQLite", "Redis", "Prefer tabs"} and again["Prefer tabs"] == "candidate"
    with pytest.raises(FileExistsError):
        truth_layer.rebuild(spark, str(folder), str(tmp_path / "again"))
    # what the store forgets goes into the spool
    store.forget(spark.createDataFrame([("mem_000000000001",)], "id string"), "2026-02-01")
    truth_layer.migrate_tombstones(store, str(folder))
    assert "mem_000000000001" in {r["id"] for r in truth_layer._spool(spark, str(folder))["tombstones"].collect()}

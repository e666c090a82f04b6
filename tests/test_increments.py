"""Consolidation by parts of files against the roll-up of all sightings."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from mnemora.operators import dynamics, merge
from mnemora.plans import consolidate
from mnemora.sources import notes
from mnemora.store import GraphStore

NOW = "2026-03-01"
NODE = ("id", "label", "type", "mention_count", "reinforcement_count", "first_seen", "last_reinforced", "source_files", "excerpts")
EDGE = ("id", "source", "target", "type", "directed", "weight", "base_weight", "reinforcement_count", "first_formed", "last_reinforced", "stability", "evidence")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def rows(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def equals_a_rebuild(store):
    """Nodes, edges and pending pairs are those of merge.build over all sightings."""
    built = merge.build(store.table("sightings"), store.table("causes"))
    built["nodes"] = built["nodes"].withColumn("excerpts", F.array_distinct("excerpts"))  # the store keeps equal proofs once
    built["edges"] = built["edges"].withColumn("evidence", F.array_distinct("evidence"))
    assert rows(store.table("nodes"), NODE) == rows(built["nodes"], NODE)
    own = [c for c in EDGE if c not in ("weight", "stability")] + [F.round("weight", 9), F.round("stability", 9)]
    assert rows(dynamics.decayed(store.table("edges"), now()), own) == rows(dynamics.decayed(built["edges"], now()), own)
    pending = ("source", "target", "type", "count", "first_seen", "evidence")
    assert rows(store.table("pending"), pending) == rows(built["pending"], pending)


def note(rng, names):
    out = ""
    for k in range(rng.randint(1, 3)):
        words = [f"[[{rng.choice(names)}]]" if rng.random() < 0.6 else f"**{rng.choice(names)}**" for _ in range(rng.randint(1, 4))]
        out += f"## Part {rng.choice('ABC')}{k}\n" + " and ".join(words) + rng.choice(["", " due to load", ""]) + "\n"
    return out


def test_changes_of_files_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    names = ["Search Index", "Web Shell", "Cache Layer", "Query Plan", "Byte Store", "Hash Join"]
    folder, store = tmp_path / "notes", GraphStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    path = lambda i: folder / f"2026-01-{i:02d}.md"
    run = lambda: consolidate.consolidate(store, notes.discover(spark, str(folder)), now())
    for i in range(2, 9):
        path(i).write_text(note(rng, names))
    run()
    equals_a_rebuild(store)
    # a changed file, a new first file (which moves second places of later ones), a file gone
    path(4).write_text(note(rng, names))
    path(1).write_text("".join(f"## {n}\n[[{n}]] and [[{m}]]\n" for n, m in zip(names, names[1:], strict=False)))
    path(7).unlink()
    run()
    equals_a_rebuild(store)
    path(1).unlink()
    run()
    equals_a_rebuild(store)


def test_one_changed_note_reads_and_writes_its_keys(spark, tmp_path):
    """Beside the names of all nodes (which mentions resolve against) and the ledger, tables are read through lookups; what is written is small beside the tables."""
    folder, store = tmp_path / "notes", GraphStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    names = [hashlib.sha256(bytes([i])).hexdigest()[:12] for i in range(24)]  # unlike each other
    for i in range(24):
        (folder / f"2026-01-{i % 28 + 1:02d}-{i:03d}.md").write_text("".join(f"## S{k}\n[[{names[i]} {k}]] and [[{names[i]} {k + 1}]] and [[Common]]\n" for k in range(4)))
    run = lambda **k: consolidate.consolidate(store, notes.discover(spark, str(folder)), now(), **k)
    run()
    asked, read = [], []
    lookup, table = GraphStore.lookup, GraphStore.table
    GraphStore.lookup = lambda self, name, keys: asked.append(name) or lookup(self, name, keys)
    GraphStore.table = lambda self, name: read.append(name) or table(self, name)
    try:
        (folder / "2026-01-04-003.md").write_text(f"## S0\n[[{names[3]} 0]] alone\n")
        run()
    finally:
        GraphStore.lookup, GraphStore.table = lookup, table
    assert {"sightings", "node_parts", "edge_parts", "seconds", "nodes", "edges", "episode_entities", "file_episodes", "causes"} <= set(asked)
    assert set(read) <= {"file_ledger", "nodes", "sightings"}  # of sightings only the schema
    written = {t: sum(spark.read.parquet(d["path"]).count() for d in s["deltas"]) for t, s in store.version()["tables"].items()}
    # the note named six labels, one of them in all notes; it now names one
    assert 0 < written["nodes"] <= 6 and 0 < written["node_parts"] <= 6 and written["sightings"] <= 20 and written["file_ledger"] == 1 and written["edges"] < 50 and written["edge_parts"] < 50
    assert 3 * written["edge_parts"] < store.table("edge_parts").count()
    equals_a_rebuild(store)

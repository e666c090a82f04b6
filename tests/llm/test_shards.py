from __future__ import annotations

import hashlib

from mnemora.llm import shards


def test_round_trip(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = shards.report(documents, target_bytes=1 << 18, arrivals=3).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)
    rows: dict[str, int] = {}
    for r in got:
        rows[r["shard"]] = rows.get(r["shard"], 0) + 1
    assert all(rows[r["shard"]] == r["shard_rows"] for r in got)


def test_tiers_merge_and_versions_stay(spark, odd, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, floor_bytes=1 << 10, fanout=4)
    for _ in range(3):
        store.append(odd.coalesce(1))
    assert store.compact() == 0 and len(store.manifest()["files"]) == 3
    before = store.manifest()["version"]
    store.append(odd.coalesce(1))
    assert store.compact() >= 1 and len(store.manifest()["files"]) < 4
    assert store.read().count() == 4 * odd.count() and store.read(before).count() == 3 * odd.count()
    assert sorted(map(str, store.read().dropDuplicates().collect())) == sorted(map(str, odd.dropDuplicates().collect()))
    gone = store.vacuum()
    assert gone >= 3 and store.read().count() == 4 * odd.count()


def test_one_writer_commits_a_version(spark, odd, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    store.append(odd)
    m = store.manifest()
    assert store._commit(dict(m)) is False  # that version is there
    assert store._commit({**m, "version": m["version"] + 1}) is True


def test_nothing(spark, nothing, tmp_path):
    assert shards.report(nothing).count() == 0


class Watched(shards.ShardStore):
    """Notes every commit: files before, added and gone."""

    log: list

    def _swap(self, added, gone, schema):
        before = self.manifest()["files"]
        new = super()._swap(added, gone, schema)
        self.log.append((before, added, set(gone), new))
        return new


def tier(size, floor, fanout):
    """By dividing, not by logarithms."""
    t = 0
    while size >= floor * fanout ** (t + 1):
        t += 1
    return t


def test_every_commit_by_a_plain_model(spark, documents, tmp_path):
    """Which files a merge takes, what it leaves, and the manifest after each commit, against a plain model of tiers."""
    floor, fanout, target = 1 << 11, 3, 1 << 17
    store = Watched(spark, str(tmp_path / "s"), target_bytes=target, floor_bytes=floor, fanout=fanout)
    store.log = []
    live, merges = {}, 0
    for k in range(7):
        store.append(documents.filter(f"doc_id % 7 = {k}").repartition(1 + k % 3))
        done = store.compact()
        assert done == sum(bool(gone) for _, _, gone, _ in store.log)
        for before, added, gone, new in store.log:
            assert {f["path"]: f for f in before} == live
            if gone:
                merges += 1
                taken = [live[p] for p in gone]
                (t,) = {tier(f["bytes"], floor, fanout) for f in taken}
                # the whole tier but for files that are large enough, and no less than fanout of them
                assert gone == {p for p, f in live.items() if f["bytes"] < 0.75 * target and tier(f["bytes"], floor, fanout) == t} and len(gone) >= fanout
                assert sum(f["rows"] for f in added) == sum(f["rows"] for f in taken) and len(added) <= max(1, round(sum(f["bytes"] for f in taken) / target))
                assert {f["level"] for f in added} == {1 + max(f["level"] for f in taken)}
            else:
                assert {f["level"] for f in added} == {0}
            live = {p: f for p, f in live.items() if p not in gone} | {f["path"]: f for f in added}
            assert {f["path"]: f for f in new["files"]} == live
        store.log.clear()
        sizes = [tier(f["bytes"], floor, fanout) for f in live.values() if f["bytes"] < 0.75 * target]
        assert all(sizes.count(t) < fanout for t in sizes)
    assert merges > 2 and sum(f["rows"] for f in live.values()) == documents.count()


def test_rows_stand_in_the_files_named(spark, documents, tmp_path):
    import pyarrow.parquet as pq

    rows = shards.report(documents, str(tmp_path / "s"), target_bytes=1 << 18, arrivals=3).collect()
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    there = {}
    for f in store.manifest()["files"]:
        there[f["path"].rsplit("/", 1)[1]] = sorted(pq.read_table(f["path"].removeprefix("file:"))["doc_id"].to_pylist())
    said: dict = {}
    for r in rows:
        said.setdefault(r["shard"], []).append(r["doc_id"])
    assert {k: sorted(v) for k, v in said.items()} == there


def test_two_compactors_and_clashing_names(spark, odd, tmp_path):
    """The one that comes second merges nothing twice and loses nothing."""
    import pytest

    make = lambda: shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 24, floor_bytes=1 << 10, fanout=2)
    one, two = make(), make()
    for _ in range(2):
        one.append(odd.coalesce(1))
    (run,) = two.due()
    assert one.compact() == 1
    with pytest.raises(RuntimeError):
        two._swap([], [f["path"] for f in run], None)
    assert two.compact() == 0 and two.read().count() == 2 * odd.count()
    assert two.read().columns == odd.columns and {r["sha"] for r in two.read().collect()} == {"own sha"}

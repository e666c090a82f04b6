from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import neighbours, registry, small_world

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5, every=50):
    """query id -> [(candidate, score)] over rows (id, vector) that take part, each different row once."""
    fine = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            w = np.array(v, float)
            fine[i, tuple(v)] = np.ldexp(w, -np.frexp(np.abs(w).max())[1])  # the cosine does not change, and squares stay finite
    out = {}
    for (i, _), v in fine.items():
        if i % every == 0:
            near = [(-float(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for (j, _), w in fine.items() if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hits = sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in w}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


def same_ranking(got, want):
    """Equal but for rounding: candidates at nearly the same nearness may change places."""
    assert {q for q, w in want.items() if w} == set(got)
    for q, g in got.items():
        assert np.allclose([s for _, s in g], [s for _, s in want[q]], atol=1e-12)
        exact = dict(want[q])
        assert all(j not in exact or abs(exact[j] - s) < 1e-12 for j, s in g)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_by_brute_force(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = found(registry.QUERIES["op13_nearest_neighbours"](spark, f"/root/testdata/{sf}"))
    want = brute([(r[0], r[1]) for r in rows])
    assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
    assert recall(got, want) >= 0.98


def test_many_shards_and_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)]
    monkeypatch.setattr(neighbours, "LEAST", 100)
    monkeypatch.setattr(neighbours, "SHARD_BYTES", 40_000)  # some 170 vectors
    monkeypatch.setattr(neighbours, "CHUNK", 40)
    monkeypatch.setattr(neighbours, "PIECE_BYTES", 1000)
    df = spark.createDataFrame(rows, SCHEMA)
    index = neighbours.build(df, 5)
    assert index.shards[0][2] >= 5
    got, want = found(index.search(df.filter("vec_id % 5 = 0"), 5)), brute(rows, 5, 5)
    assert recall(got, want) >= 0.99
    with pytest.raises(ValueError):
        index.search(df, 6)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    v = [rng.normal(size=6).tolist() for _ in range(60)]
    rows = [(i, v[i % 3] if i < 600 else v[i % 60]) for i in range(1000)] + [(1000, v[0]), (1000, v[0]), (1050, [2 * c for c in v[1]])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(neighbours.report(df))
    want = brute(rows)
    same_ranking(got, want)
    # copies are of exactly equal nearness, so the least ids come first
    assert [j for j, _ in got[0]] == [3, 6, 9, 12, 15] and [j for j, _ in got[1000]] == [0, 3, 6, 9, 12]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (7, [-0.0, 0.0]), (8, []), (None, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None),
        (150, [1e-300, 1e-300]), (9, [1e300, -1e300]), (10, [1.0, 2.0, 3.0]), (200, [3.0, 2.0, 1.0]), (250, [1.0]), (0, [1.0, 0.0]), (0, [-1.0, 0.0]), (300, [1.0, 1.0, 1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "v", "dim", "key", "shard", "nth", "rank", "score", "query_id")})
    got = found(neighbours.report(df.filter("not (vec_id = 0 and embedding[0] < 0)")))
    same_ranking(got, brute([r for r in rows if r != (0, [-1.0, 0.0])]))
    assert set(got) == {0, 150, 200} and sorted(j for j, _ in got[0]) == [1, 9, 150]  # 250 and 300 have no row to compare with
    # an id with two vectors asks twice and is found twice
    rows_of = neighbours.report(df).filter("query_id = 150").orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 3)) for r in rows_of] == [(1, 1.0), (0, 0.707), (9, 0.0), (0, -0.707)]
    assert neighbours.report(df).filter("query_id = 0").count() == 6
    assert neighbours.report(df.limit(0)).count() == 0
    assert neighbours.report(spark.createDataFrame([(i, None) for i in range(3)], SCHEMA)).count() == 0


def test_graph_links():
    """Every row is reached from the first one, no row links to itself, and levels nest."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 12))
    x[1000:1500] = x[0]  # near copies
    x[1000:1500] += rng.normal(scale=1e-4, size=(500, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, counts = small_world.level_counts(rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2), 16)
    assert sorted(order) == list(range(3000)) and counts == sorted(counts, reverse=True) and counts[0] == 3000 and counts[-1] >= 1
    x = x[order]
    links = small_world.build(x, counts, 16, 64)
    assert [g.shape for g in links] == [(c, 16 if i else 32) for i, c in enumerate(counts)]
    assert not (links[0] == np.arange(3000)[:, None]).any()
    ids, near = small_world.search(x, links, x[::7], 64)
    best = np.argsort(-(x[::7] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, best, strict=True)]) > 0.9
    assert (near[:, 1:] <= near[:, :-1]).all()

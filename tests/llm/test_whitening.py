from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<double>"


def check(rows, vectors, components=32):
    """Against exact sums and a covariance of exact fractions rounded once. vectors: [(id, list)] of one length, all of which remain."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x, strict=True)]
    dev = np.array([[n * c - s for c, s in zip(r, sums, strict=True)] for r in x], object)
    cov = np.array([[float(Fraction(int((dev[:, i] * dev[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, d)
    assert len(rows) == n * k
    by = {}
    for r in rows:
        assert r["n"] == n and 1 <= r["component"] <= k
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) <= 1e-9 * r["explained"]
        by.setdefault(r["vec_id"], []).append(r)
    w = np.zeros((n, k))
    for (i, _), deviations, line in zip(vectors, dev, w, strict=True):
        assert sorted(r["component"] for r in by[i]) == list(range(1, k + 1))
        for r in by[i]:
            assert r["deviation"] == (deviations**2).sum()
            line[r["component"] - 1] = r["whitened"]
    # the axes, from the whitened values: unit eigenvectors of the covariance
    centred = (dev / n).astype(float)
    axes = np.linalg.lstsq(centred, w, rcond=None)[0] * np.sqrt(values[:k])
    assert np.allclose(np.linalg.norm(axes, axis=0), 1, atol=1e-9)
    assert np.abs(cov @ axes - axes * values[:k]).max() < 1e-9 * values[0]
    error = np.abs(w.T @ w / n - np.eye(k)).max()
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9 and error < 1e-9


def test_query_by_exact_fractions(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(registry.QUERIES["op12_embedding_whitening"](spark, sf_dir).collect(), [(r[0], r[1]) for r in vectors])


def test_merged_in_rounds_and_tiles(spark, monkeypatch):
    for name, value in (("TILE", 7), ("AT_ONCE", 20), ("FAN", 3)):
        monkeypatch.setattr(whitening, name, value)
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.normal(size=5) * [1, 5, 0.5, 3, 2] + 1000).tolist()) for i in range(211)]
    check(whitening.report(spark.createDataFrame(vectors, SCHEMA).repartition(11)).collect(), vectors)


def test_error_free_transformations():
    rng = np.random.default_rng(2)
    a, b = (rng.normal(size=500) * 10.0 ** rng.integers(-12, 12, 500) for _ in range(2))
    for f, exact in ((whitening.two_sum, lambda u, v: u + v), (whitening.two_product, lambda u, v: u * v)):
        high, low = f(a, b)
        assert all(Fraction(h) + Fraction(l) == exact(Fraction(u), Fraction(v)) for h, l, u, v in zip(high, low, a, b, strict=True))


def test_sums_keep_what_doubles_lose():
    """Rows of very different size, whose plain sum loses the small ones."""
    rows = np.array([[1e9, 1.0], [1.0, 1e-7], [-1e9, 3.0], [2.0, 1e-9]] * 50)
    s = whitening.Products(2)
    s.add(rows, np.zeros(rows.shape))
    for i in range(2):
        for j in range(2):
            exact = sum(Fraction(r[i]) * Fraction(r[j]) for r in rows.tolist())
            assert abs(Fraction(s.high[i, j]) + Fraction(s.low[i, j]) - exact) <= abs(exact) * Fraction(1, 2**98)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(7, [0.5, 0.5, 0.5])]
    bad = [(100, None), (101, []), (102, [None, 1.0, 2.0]), (103, [nan, 1.0, 2.0]), (104, [inf, 1.0, 2.0]), (105, [1.0, 2.0, -inf])]
    names = ("id", "v", "x", "dim", "n", "s", "pos", "col", "part", "high", "low", "component", "whitened")
    df = spark.createDataFrame(good + bad, SCHEMA).withColumns({c: F.lit("own") for c in names})
    rows = whitening.report(df).collect()
    assert {r["vec_id"] for r in rows} == set(range(40))
    assert len(rows) == 41 * 3 and len({r["n"] for r in rows}) == 1 and rows[0]["n"] == 41
    once = [(i, v) for i, v in good if i != 7]
    check(whitening.report(spark.createDataFrame(once + [(None, [0.5, 0.25, 0.125])], SCHEMA)).collect(), once + [(None, [0.5, 0.25, 0.125])])
    assert whitening.report(df.limit(0)).count() == 0
    assert whitening.report(spark.createDataFrame(bad, SCHEMA)).count() == 0


def test_lengths_and_lack_of_variance(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 5.0]), (2, [4.0, 4.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0, 4.0]), (5, [1.0, 2.0, 3.0, 5.0]), (6, [0.0]), (7, [5.0] * 5), (8, [5.0] * 5)]
    got = whitening.report(spark.createDataFrame(rows, SCHEMA)).collect()
    by = lambda *ids: [r for r in got if r["vec_id"] in ids]
    check(by(0, 1, 2), rows[:3])
    check(by(3, 6), [rows[3], rows[6]])
    four = by(4, 5)  # one direction only
    assert len(four) == 8 and all((r["whitened"] is None) == (r["component"] > 1) for r in four)
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in four if r["component"] == 1) and four[0]["identity_error"] < 1e-12
    none = by(7, 8)
    assert len(none) == 10 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in none)


def test_beyond_64_bits(spark):
    big = [(i, [float(i), 1e300 if i == 0 else (-1e15 if i == 1 else 3.0), 1e17 * i]) for i in range(5)]
    rows = whitening.report(spark.createDataFrame(big, SCHEMA)).collect()
    assert len(rows) == 15 and all(r["deviation"] is None for r in rows)
    small = [(i, [float(2**40 * i), 1.0 * i * i]) for i in range(3)]
    rows = whitening.report(spark.createDataFrame(small, SCHEMA)).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in small]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((3 * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for i, r in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: d if d < 2**63 else None for i, d in want.items()}


@pytest.mark.parametrize(("n", "big"), [(3, 10), (7, 2**58), (5, 2**61)])
def test_centred_pairs_are_exact(n, big):
    x = np.array([[big, 1], [big - 1, 5], [-big, 2]], np.int64)
    sums = [int(sum(map(int, c))) for c in x.T]
    dev = whitening.deviations(x, n, sums)
    high, low = whitening.centred(dev, n)
    for d, h, l in zip(dev.ravel().tolist(), high.ravel().tolist(), low.ravel().tolist(), strict=True):
        assert abs(Fraction(h) + Fraction(l) - Fraction(d, n)) <= abs(Fraction(d, n)) * Fraction(1, 2**100)

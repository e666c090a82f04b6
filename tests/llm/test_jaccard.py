from __future__ import annotations

import random

import pytest

from mnemora.llm import jaccard
from mnemora.operators import components

from .conftest import CLASHING, ODD


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def plain(docs, size, percent):
    """{id: (set size, component)} by comparing all pairs of different sets."""
    sets = {i: shingles(t, size) for i, t in docs}
    first = {}
    for i, s in sets.items():
        if s:
            first[s] = min(first.get(s, i), i)
    own = list(first)
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(own):
        for j in range(i):
            if 100 * min(len(a), len(own[j])) >= percent * max(len(a), len(own[j])):
                k = len(a & own[j])
                if 100 * k >= percent * (len(a) + len(own[j]) - k):
                    root[find(i)] = find(j)
    least = {}
    for i, s in enumerate(own):
        least[find(i)] = min(least.get(find(i), 1 << 60), first[s])
    of = {s: least[find(i)] for i, s in enumerate(own)}
    return {i: (len(s), of[s] if s else i) for i, s in sets.items()}


def check(df, size, percent):
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").distinct().collect()]
    rows = jaccard.components(df, size, percent).collect()
    expected = plain(docs, size, percent)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
    return rows


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_by_brute_force(documents, size, percent):
    rows = check(documents, size, percent)
    assert sum(r["is_first"] for r in rows) == len({r["component_id"] for r in rows})


@pytest.mark.parametrize(("group", "queries", "broadcast"), [(512, 512, 10**6), (4, 3, 0)])
def test_families_of_near_copies(docs_of, monkeypatch, group, queries, broadcast):
    """Families whose members are linked to a hub, in a chain, or not at all; also with tiny groups and shuffled joins."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "QUERIES", queries)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    random.seed(6)
    texts = []
    common = [f"common{i}" for i in range(25)]
    for f in range(4):
        base = [f"f{f}w{i}" for i in range(random.choice([12, 60, 150]))] + (common if f % 2 else [])
        texts.append(base)
        for _ in range(25):
            t = list(base)
            for _ in range(random.randint(0, 4)):
                t[random.randrange(len(t))] = f"new{random.randrange(10**6)}"
            texts.append(t)
        chain = base
        for _ in range(10):
            at = random.randrange(len(chain))
            chain = chain[:at] + [f"link{random.randrange(10**6)}"] + chain[at + 1 :]
            texts.append(chain)
    texts += [common + [f"own{i}"] for i in range(20)] + [common[:5]] * 3 + [[]]
    random.shuffle(texts)
    check(docs_of([" ".join(t) for t in texts]), 4, 85)


def test_odd_rows(odd, nothing):
    some = odd.filter("doc_id is not null")
    got = jaccard.components(odd, 4, 85)
    assert got.count() == odd.count() and jaccard.report(nothing).count() == 0
    expected = plain(list(enumerate(ODD)), 4, 85)
    assert all((r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] for r in got.collect() if r["doc_id"] is not None)
    left = jaccard.keep_first(some)
    assert left.columns == odd.columns and all(r[c] == f"own {c}" for r in left.collect() for c in CLASHING)
    firsts = {v[1] for v in plain(list(enumerate(ODD)), 5, 80).values()}
    assert {r["doc_id"] for r in left.collect()} == firsts


def test_contract(spark):
    random.seed(8)
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components.contract(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1] or find(x) != x or x in got}
    assert components.contract(spark.createDataFrame([], "a int, b int")).count() == 0


def test_sets_beyond_the_digits_of_floats():
    """Links that a single shared token decides, in sets of a million and more: 100 times a count has no room in a float."""
    import numpy as np
    import pyarrow as pa

    n = 1_700_000
    for shared in (n, n - 1):  # 85 % of 2,000,000 in all, and one less
        sets = [np.arange(n), np.arange(n - shared, 2_000_000)]
        assert jaccard._pairs(sets, sets).tolist() == [[n, shared], [shared, 2_000_000 - n + shared]]
        table = pa.table({"key": [0, 0], "lot": [0, 0], "s1": [1, 2], "s2": [0, 0], "n": [len(x) for x in sets], "tokens": pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))})
        assert jaccard._within(table, 85).column("reach").to_pylist() == ([2, 2] if shared == n else [1, 1])

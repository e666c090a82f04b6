from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from mnemora.llm import decontaminate

from .conftest import CLASHING, ODD


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def plain(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(13, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def check(docs, bench):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    for r in decontaminate.report(docs, bench).collect():
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == plain(texts[r["doc_id"]], items)


def test_by_brute_force(documents, benchmark):
    check(documents, benchmark)


@pytest.mark.parametrize("rows", [10**6, 0])
def test_planted_and_short_items(spark, docs_of, monkeypatch, rows):
    """With benchmark tables broadcast, and shuffled."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (1, 2, 5, 8, 12, 13, 14, 30, 60)]
    items[0] = ["single"]
    docs = [text(random.randint(0, 80)) for _ in range(30)]
    for d, item in zip(docs, items * 4, strict=False):
        at = random.randint(0, len(d))
        cut = random.randint(0, max(0, len(item) - 13))
        d[at:at] = item[cut : cut + random.choice([12, 13, 14, 60])]
    bench = spark.createDataFrame([(i, ("; ".join(x)).upper()) for i, x in enumerate(items)] + [(100, None), (101, "..."), (102, " ".join(items[7]))], "item_id long, text string")
    check(docs_of([" ".join(d) for d in docs]), bench)


def test_odd_rows(odd, nothing, benchmark, spark):
    got = decontaminate.report(odd, benchmark).collect()
    assert len(got) == odd.count() and decontaminate.report(nothing, benchmark).count() == 0
    assert {r["doc_id"]: r["n_words"] for r in got if r["doc_id"] is not None} == {i: len(words(t)) for i, t in enumerate(ODD)}
    assert decontaminate.report(odd, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    left = decontaminate.keep_clean(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 4 and all(r[c] == f"own {c}" for r in left.collect() for c in CLASHING)


def test_long_and_repetitive_texts_take_linear_time(spark, docs_of):
    """One document and one item of n words, all equal, in a short cycle, or all different: twice the words take no more than some twice the time."""
    texts = {"equal": lambda n: "same " * n, "cycle": lambda n: " ".join(f"c{i % 7}" for i in range(n)), "different": lambda n: " ".join(f"d{i}" for i in range(n))}
    for kind, text in texts.items():
        seconds = {}
        for n in (1000, 30_000, 60_000):
            bench = spark.createDataFrame([(1, text(n)), (2, text(n) + " tail")], "item_id long, text string")
            began = time.perf_counter()
            row = decontaminate.report(docs_of(["before it " + text(n)]), bench).first()
            seconds[n] = time.perf_counter() - began
            assert (row["n_words"], row["n_hit"], row["n_items"]) == (n + 2, n, 2), kind
        assert seconds[60_000] < 2 * seconds[30_000] + 3, (kind, seconds)

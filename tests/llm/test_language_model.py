from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from mnemora.llm import language_model, words
from mnemora.llm.succinct import EliasFano, pack, unpack

from .conftest import ODD


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def check(df, docs, monkeypatch):
    monkeypatch.setattr(language_model, "CHARS_1", 200_000)
    monkeypatch.setattr(language_model, "CHARS_2", 90_000)
    monkeypatch.setattr(language_model, "BATCH_TOKENS", 20_000)
    one, two, n = Counter(), Counter(), 0
    for i, t in docs:
        if not out(i):
            k = tokens(t)
            one.update(k)
            two.update(zip(["begin", *k], k, strict=False))
            n += 1
    total, kinds = sum(one.values()), len(one)
    p = lambda w: (one[w] + 1) / (total + kinds + 1)
    got = {}
    for r in language_model.report(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    gain = 0.0
    for i, t in docs:
        k = tokens(t)
        base = sum(math.log10(p(w)) for w in k)
        full = sum(math.log10((two[u, w] + language_model.PSEUDO * p(w)) / ((n if u == "begin" else one[u]) + language_model.PSEUDO)) for u, w in zip(["begin", *k], k, strict=False))
        for r in got[i]:
            if r["n_tokens"] != len(k):
                continue
            assert (r["held_out"], r["n_known"], r["train_tokens"]) == (out(i), sum(one[w] > 0 for w in k), total)
            assert r["base_score"] == pytest.approx(base, abs=1e-6)
            # a step of the quantised logarithm is 1/255 of the range
            assert abs(r["pair_score"] - full) <= len(k) * 0.5 * math.log10(total + kinds + 1 + language_model.PSEUDO) / 255 + 1e-6
            gain += (r["pair_score"] - r["base_score"]) * r["held_out"]
    return gain


def test_by_brute_force(documents, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert check(documents.repartition(3), docs, monkeypatch) > 0  # held-out texts are likelier than by single words


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_trigrams_by_brute_force(request, monkeypatch, name):
    df = request.getfixturevalue(name).select("doc_id", "text")
    for k, v in {"CHARS_1": 200_000, "CHARS_2": 90_000, "BATCH_TOKENS": 20_000}.items():
        monkeypatch.setattr(language_model, k, v)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    one, two, three, after, n = Counter(), Counter(), Counter(), Counter(), 0
    for i, t in docs:
        if not out(i):
            k = ["begin", *tokens(t)]
            one.update(k[1:])
            two.update(zip(k, k[1:], strict=False))
            three.update(zip(k, k[1:], k[2:], strict=False))
            after.update(zip(k, k[1:-1], strict=False))
            n += 1
    total, kinds, c = sum(one.values()), len(one), language_model.PSEUDO
    gain = 0.0
    rows = {(r["doc_id"], r["n_tokens"]): r for r in language_model.report(df.repartition(3)).collect()}
    for i, t in docs:
        k = ["begin", *tokens(t)]
        p2 = lambda u, w: (two[u, w] + c * (one[w] + 1) / (total + kinds + 1)) / ((n if u == "begin" else one[u]) + c)
        full = math.log10(p2(*k[:2])) + sum(math.log10((three[x] + c * p2(x[1], x[2])) / (after[x[:2]] + c)) for x in zip(k, k[1:], k[2:], strict=False))
        r = rows[i, len(k) - 1]
        assert abs(r["score"] - full) <= len(k) * 0.5 * math.log10(total + kinds + 1 + c) / 255 + 1e-6
        gain += (r["score"] - r["pair_score"]) * r["held_out"]
    assert name == "odd" or gain > 0  # held-out texts are likelier than by pairs


def test_odd_rows(odd, nothing, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(odd, docs, monkeypatch)
    assert language_model.report(nothing).count() == 0 and language_model.report(odd).count() == odd.count()


def test_nothing_to_learn_from(docs_of):
    held = next(i for i in range(100) if out(i))
    from pyspark.sql import functions as F

    (r,) = language_model.report(docs_of(["a b"]).withColumn("doc_id", F.lit(held).cast("long"))).collect()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"]) == (0, 0, 3, 0.0)


def test_probabilities_sum_to_one(spark, docs_of):
    texts = ["a b a c", "a b b", "c a b", "a a a a", "b c"] * 3
    train = [i for i in range(len(texts)) if not out(i)]
    vocabulary = {w for i in train for w in tokens(texts[i])}
    m = language_model.train(docs_of(texts).select("doc_id", "text"), language_model.scratch(spark, "lm"))
    h = {w: (np.uint64(language_model.END) if w is None else words.word_hashes([w])[0][0]) for w in vocabulary}
    ids, count, code = m.words_of(np.array(list(h.values()), np.uint64))
    uni = 10 ** m.log_unigram(code)
    assert uni.sum() + 1 / (m.tokens + m.words + 1) == pytest.approx(1, abs=0.03)
    k = list(h).index(b"a")
    n = len(h)
    found = m.pairs_of(np.repeat(h[b"a"], n), np.array(list(h.values()), np.uint64), np.repeat(ids[k], n), ids)
    weight = language_model.PSEUDO / (count[k] + language_model.PSEUDO)
    p = np.where(found < 0, weight * uni, 10 ** (found * m.low / language_model.LEVELS))
    assert p.sum() + weight / (m.tokens + m.words + 1) == pytest.approx(1, abs=0.03)


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 2**63), (5, 10), (1000, 1200), (1000, 2**60), (50_000, 2**64 - 1), (3000, 3100)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e = EliasFano(unpack(pack(EliasFano.build(v, "x"))), "x")
    assert (e.get(np.arange(len(v))) == v).all()
    q = np.concatenate([v, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
    at, equal = e.successor(q)
    assert (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()


def test_elias_fano_where_numbers_crowd():
    v = np.concatenate([np.arange(20_000) * 3, 2**30 + np.arange(50) * 2**34]).astype(np.uint64)
    e = EliasFano(unpack(pack(EliasFano.build(v, "x"))), "x")
    q = np.concatenate([v, v + np.uint64(1), np.maximum(v, np.uint64(1)) - np.uint64(1)])
    at, equal = e.successor(q)
    assert (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all() and (e.get(np.arange(len(v))) == v).all()


def test_elias_fano_of_one_bucket():
    v = np.arange(5000, dtype=np.uint64)  # no high halves differ, or all do
    for scale in (1, 2**40):
        e = EliasFano(unpack(pack(EliasFano.build(v * np.uint64(scale), "x"))), "x")
        at, equal = e.successor(v * np.uint64(scale))
        assert equal.all() and (at == np.arange(5000)).all()


@pytest.mark.parametrize("window", [8, 64, 1 << 20])
def test_word_hashes(monkeypatch, window):
    monkeypatch.setattr(words, "WINDOW", window)
    texts = [(t or "").encode() for t in ODD[:10]] + [b"a b  c", b" x\ny ", b"\t", b"long" * 100]
    h, n = words.word_hashes(texts)
    flat = [w for t in texts for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts] and len(h) == len(flat)
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def test_ids_of_other_types_are_held_out_as_spark_writes_them(spark):
    """Learning and scoring take one view of an id, whatever its type."""
    from pyspark.sql import functions as F

    ids = spark.range(40).select((F.col("id") % 3 == 0).alias("a"), (F.col("id") / 7).alias("b"), F.timestamp_seconds(F.col("id") * 1000).alias("c"), F.col("id").cast("string").alias("d"))
    for c in "abcd":
        docs = ids.select(F.col(c).alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("d")).alias("text"))
        rows = docs.select(language_model.held_out(F.col("doc_id")).alias("h"), F.col("text")).collect()
        got = {(r["held_out"], r["train_tokens"]) for r in language_model.report(docs).collect()}
        assert {h for h, _ in got} == {r["h"] for r in rows} and {n for _, n in got} == {sum(3 for r in rows if not r["h"])}


def test_few_open_files_give_the_same(spark, documents, monkeypatch):
    """A worker that may keep one file scores as one that keeps all."""
    for k, v in {"CHARS_1": 100_000, "CHARS_2": 50_000}.items():
        monkeypatch.setattr(language_model, k, v)
    docs = documents.limit(40)
    model = language_model.train(docs.select("doc_id", "text"), language_model.scratch(spark, "lm"))
    some = np.unique(language_model.hashes([r["text"] or "" for r in docs.collect()])[0])
    language_model._maps.clear()
    whole = model.words_of(some)
    monkeypatch.setattr(language_model, "MAPS", 1)
    language_model._maps.clear()
    assert all((a == b).all() for a, b in zip(whole, model.words_of(some), strict=True)) and len(language_model._maps) == 1
    assert language_model._open(f"{model.path}/level1-999999") is None

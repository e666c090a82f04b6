from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from mnemora.llm import fill_in_middle, registry
from mnemora.llm.succinct import BitVector

from .conftest import ODD

TEXTS = [*ODD, "a <P> b", "c<S>", "<M>", "<", "<P", "P><S", "<<S<S>", "é😀ü" * 50, "\x00\n\r", "日本語のテキスト", "é‍", "<S" * 40, *[chr(300 + i) * i for i in range(1, 60)]]


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("slice_bytes", [1, 700, 8 << 20])
def test_outputs(docs_of, slice_bytes):
    got = {r["doc_id"]: r for r in fill_in_middle.transform(docs_of(TEXTS), slice_bytes=slice_bytes).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(i, t)
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_restored(docs_of):
    for r in fill_in_middle.report(docs_of(TEXTS)).collect():
        assert r["restored_sha256"] == sha(TEXTS[r["doc_id"]] or "")
        assert r["output_sha256"] == sha(plain(r["doc_id"], TEXTS[r["doc_id"]])[4])


def test_query_equals_sql(spark, sf_dir, same):
    same(registry.QUERIES["op11_fill_in_middle"](spark, sf_dir), registry.ORACLES["op11_fill_in_middle"])


def test_odd_rows(odd, nothing):
    rows = fill_in_middle.report(odd).collect()
    assert len(rows) == odd.count() and fill_in_middle.report(nothing).count() == 0
    for r in rows:
        if r["doc_id"] is not None:
            assert r["output_sha256"] == sha(plain(r["doc_id"], ODD[r["doc_id"]])[4])
    lost = {(r["n"], r["form"], r["restored_sha256"]) for r in rows if r["doc_id"] is None}
    assert lost == {(*plain("", ODD[5])[:2], sha(ODD[5]))}


def test_own_parameters(docs_of):
    marks = ("[pre]", "[suf]", "[mid]")
    texts = ["some text", "with [mid] in it", None, "<P> is a text here"]
    for r in fill_in_middle.transform(docs_of(texts), seed="x", rate=100, suffix_first=100, sentinels=marks).collect():
        assert r["form"] == ("plain" if r["doc_id"] in (1, 2) else "spm")
    out = fill_in_middle.transform(docs_of(texts), seed="x", rate=100, suffix_first=50, sentinels=marks)
    back = out.select("doc_id", fill_in_middle.restored(out["form"], out["output"], marks).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in back} == {i: t or "" for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0.0, 0.03, 0.5, 1.0])
def test_bit_vector(n, share):
    random.seed(n)
    flags = np.array([random.random() < share for _ in range(n)], bool)
    v = BitVector(flags)
    ones = np.flatnonzero(flags)
    assert v.ones == len(ones)
    assert v.rank(np.arange(n + 1)).tolist() == [int(flags[:i].sum()) for i in range(n + 1)]
    assert v.select(np.arange(len(ones) + 2)).tolist() == [*ones.tolist(), n, n]

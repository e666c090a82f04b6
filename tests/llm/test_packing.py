from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from mnemora.llm import packing

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(df, texts, rows_each=None):
    rows = packing.pack(df, with_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, t in texts.items():
        ids = ids_of(t)
        copies = (rows_each or {}).get(i, 1)
        assert all(r["doc_tokens"] == len(ids) for r in by[i]) and sum(r["length"] for r in by[i]) == copies * len(ids)
        for r in by[i]:
            assert bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes()
        assert sorted({r["start"] for r in by[i]})[0] == 0
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(r["length"] for r in rows) / (1024 * len(bins))


def test_round_trip(documents):
    assert check(documents, {r["doc_id"]: r["text"] for r in documents.collect()}) > 0.97


def test_odd_rows(odd, nothing):
    texts = {i: t for i, t in enumerate(ODD)}
    check(odd.filter("doc_id is not null"), texts, {5: 2, 7: 2, 10: 2})
    assert packing.pack(nothing).count() == 0
    assert packing.pack(odd).filter("doc_id is null").count() == 2


@pytest.mark.parametrize("text", ["a  b\n\n c", " lead", "trail ", "<|endoftext|> and <|endoftext|>", " x y", "日本語 テキスト", "a" * 3000, "don't I'll we've", "\t\n x", "🙂🙂 ok", "x\u0085y z"])
def test_encoder_gives_the_tokenizers_ids(text):
    e = packing.Encoder(PATH)
    e.checked = e.CHECKED
    assert e.encode(text) == ids_of(text)[:-1].tobytes()


def test_cuts():
    for n in range(1, 3000):
        pieces = packing.cuts(n)
        assert sum(length for length, _ in pieces) == n and all(1 <= length <= 1024 // k for length, k in pieces)


def test_bins_hold_their_class():
    random.seed(1)
    p, total = packing.Packer(7), 0
    for i in range(3000):
        n = random.randint(1, 1023)
        total += n
        for length, k in packing.cuts(n):
            p.add(i, length, k)
    p.finish()
    bins = {}
    for _, length, b, at in p.placed():
        assert at == bins.get(b, 0)
        bins[b] = at + length
    assert max(bins.values()) <= 1024 and sum(bins.values()) == total and total / (1024 * len(bins)) > 0.97


def test_both_encoders_agree_on_every_code_point():
    """The fast way trusts that its pattern cuts texts as the file's tokenizer does: every code point alone, doubled, and beside letters, digits, blanks and apostrophes."""
    enc = packing.Encoder(PATH)
    assert enc.fast is not None
    enc.checked = enc.CHECKED  # from here on without comparing
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for a in range(0, len(points), 8192):
        chars = [chr(c) for c in points[a : a + 8192]]
        for text in ("".join(f"a{c}b {c}1{c}{c}" for c in chars), " ".join(f"'{c} {c}'s" for c in chars), "".join(f"{c}  {c}\n" for c in chars)):
            assert enc.encode(text) == enc._slow(text)

"""Harmonic packing of token sequences (operator 5).

A document is the ids of its text by a public tokenizer, then id 0; a null text is empty. Whole
sequences of ``capacity`` ids are cut off first. What remains, r ids, falls into the
reciprocal-capacity class k = capacity // r, whose bins hold exactly k pieces of at most
capacity // k ids. Where that leaves a slot more than 1/32 empty, a piece that fills a slot of class
k + 1 is cut off, and the rest is classed anew; so a bin is padded by a few ids. Each worker fills its
own bins, at most one open bin a class, and at its end packs the pieces of unfinished bins
best-fit, longest first (there are at most a few hundred). Nothing is shuffled, and memory is one
batch of texts plus the open bins.

Sequence ids are (partition number << 32) + the worker's count, so they are the same when a task is
repeated. Rows that repeat are packed each; null ids pass through; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

CAPACITY = 1024
END_ID = 0
GROUP = 512

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts by the tokenizer in a ``tokenizers`` JSON file.

    Where the file is a plain byte-level BPE whose ids follow its merges, the same merges are run by
    ``tiktoken``, which gives the same ids several times faster; the first texts of each worker are
    encoded by both and compared. Texts with the file's special tokens, and all texts of other files,
    go through ``tokenizers``.
    """

    CHECKED = 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special: list[str] = []
        self.fast, self.checked = self._same_merges(path), 0

    def _same_merges(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or pre != pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or spec["normalizer"] or any(model.get(k) for k in options):
            return None
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        # byte-level files write a byte as its printable character, or as one from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.fast is None or any(t in text for t in self.special):
            return self._slow(text)
        ids = self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        if self.checked < self.CHECKED:
            self.checked += 1
            slow = self._slow(text)
            if ids != slow:  # this file needs tokenizers
                self.fast = None
                return slow
        return ids


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n ids; class 1 pieces of full length are whole sequences."""
    out = [(capacity, 1)] * (n // capacity)
    r = n % capacity
    while r:
        k = capacity // r
        slot = capacity // k
        if slot - r <= slot >> 5:
            out.append((r, k))
            break
        out.append((capacity // (k + 1), k + 1))
        r -= capacity // (k + 1)
    return out


class Packer:
    """Bins of one worker. Pieces are any values; placed() gives (piece, length, sequence, offset) as bins close."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.open, self.done = first, capacity, {}, []

    def _close(self, pieces: list) -> None:
        at = 0
        for piece, length in pieces:
            self.done.append((piece, length, self.next, at))
            at += length
        self.next += 1

    def add(self, piece, length: int, k: int) -> None:
        if k == 1:
            self._close([(piece, length)])
            return
        own = self.open.setdefault(k, [])
        own.append((piece, length))
        if len(own) == k:
            self._close(self.open.pop(k))

    def finish(self) -> None:
        from bisect import bisect_left, insort

        rest = sorted((x for own in self.open.values() for x in own), key=lambda x: -x[1])
        self.open = {}
        room: list[tuple[int, int]] = []  # (ids free, bin)
        bins: list[list] = []
        for x in rest:
            i = bisect_left(room, (x[1], -1))
            if i < len(room):
                free, b = room.pop(i)
            else:
                free, b = self.capacity, len(bins)
                bins.append([])
            bins[b].append(x)
            if free > x[1]:
                insort(room, (free - x[1], b))
        for b in bins:
            self._close(b)

    def placed(self) -> list:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids: little-endian 32-bit)."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", text_of(docs).alias("text"))
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, packer = encoder(tokenizer_path), Packer(TaskContext.get().partitionId() << 32, capacity)
        kind = None

        def rows() -> pa.RecordBatch:
            placed = packer.placed()
            cols = list(zip(*[(p[0], p[1], n, p[2], p[3], s, at, *p[4:]) for p, n, s, at in placed], strict=True)) or [[]] * (8 if with_ids else 7)
            types = [kind, *[pa.int64()] * 6, *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(0, batch.num_rows, GROUP):
                part = batch.slice(i, GROUP)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = enc.encode(text.as_py()) + END_ID.to_bytes(4, "little")
                    total, at = len(ids) // 4, 0
                    for n, k in cuts(total, capacity):
                        own_ids = ids[4 * at : 4 * (at + n)]
                        packer.add((doc, at, zlib.crc32(own_ids), total, *([own_ids] if with_ids else [])), n, k)
                        at += n
                if len(packer.done) > 4096:
                    yield rows()
        if kind is not None:
            packer.finish()
            yield rows()

    return own.mapInArrow(run, schema)

"""Language-model scores by an Elias-Fano trigram trie (operator 4).

Tokens are the words of a text in lower case (A-Z), then one end. The model learns from the training
documents, all of them:

* level 1 has every word: sorted 64-bit hashes (two words of one hash would be one; at a billion words
  that is expected 0.03 times), the monotone sums of their counts, and the quantised unigram
  probability (c + 1) / (N + V + 1);
* level 2 has every pair of a word and the one before it: the contexts, monotone pointers to the range of each one's
  successors, the successors' ids made monotone by adding the last number of the range before,
  and the quantised probability (c(u, w) + K p(w)) / (c(u) + K), a Dirichlet-smoothed estimate;
* level 3 has every word after a pair: pointers of the places of level 2 to their successors, these as in level 2, and the
  monotone sums of the counts. With the probability of level 2 they give (c(t, u, w) + K p(w | u)) / (c(t, u) + K); a document's
  first word has that of level 2.

A pair is found by a successor search within its context's range; one that is not there has K p(w) /
(c(u) + K), which sums to 1 with the others; so it is in level 3. Probabilities are quantised to ``LEVELS`` equal steps
of their logarithm.

The levels are cut into shards by hash - levels 2 and 3 by the hash of the pair that is looked up or goes before, so a
frequent word is spread over all shards, and one shuffle of triples serves both: a pair counts what its triples count - built by one task each from counts combined within map batches, and written to
the shared folder under a name that is renamed into place. Scoring tasks map the files into memory
and read only what they look up; files of file systems that can't be mapped are read into memory, the
last ``CACHE`` bytes of them; nothing is copied to a worker's disk. Tasks carry the model's path and totals; the numbers of
words before each shard of level 1 are a file like the others. The driver sees three numbers for each such shard.

Defined cases: a null text is empty (one end token); a null id counts as the text ""; repeated rows count and are scored each;
with no training documents every probability is 1 / (N + V + 1) = 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, hadoop, scratch, ship, text_of

PSEUDO = 20.0
LEVELS = 255
#: Characters of text for a shard of a level, and tokens of a map batch.
CHARS_1, CHARS_2 = 60_000_000, 10_000_000
BATCH_TOKENS = 1_000_000
#: Files that a worker keeps open, and bytes of those that it can't map.
MAPS, CACHE = 4096, 512 << 20
END, BEGIN = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def hashes(texts: list[str]):
    """Hashes of the tokens of texts in order, an end after each, and the place past each end."""
    import numpy as np

    from .words import word_hashes

    h, n = word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    ends = np.cumsum(n + 1)
    out = np.empty(len(h) + len(texts), np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), n)] = h
    out[ends - 1] = END
    return out, ends


def held_out(doc_id: Column) -> Column:
    """Whether a document is not learnt from: by its id as Spark writes it, of whatever type."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _pair_hash(u, w):
    import numpy as np

    h = (u ^ (w * np.uint64(0x94D049BB133111EB))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _shard(h, shards: int):
    """Shards by range of hash, so that the shards in order are the sorted whole."""
    import numpy as np

    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _before(h, ends):
    """The context of each token of concatenated documents."""
    import numpy as np

    u = np.empty_like(h)
    u[1:] = h[:-1]
    u[np.concatenate([[0], ends[:-1]])] = BEGIN
    return u


def _runs(sorted_keys):
    import numpy as np

    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return start, np.diff(np.concatenate([start, [len(sorted_keys)]]))


def _planes(name: str, ids, top: int) -> dict:
    """Ids up to top as one array for each byte, which compress apart."""
    import numpy as np

    return {f"{name}{i}": (ids >> (8 * i)).astype(np.uint8) for i in range(max(1, -(-int(top).bit_length() // 8)))}


def _joined(x: dict, name: str):
    import numpy as np

    out, i = np.zeros(len(x[f"{name}0"]), np.int64), 0
    while f"{name}{i}" in x:
        out |= x[f"{name}{i}"].astype(np.int64) << (8 * i)
        i += 1
    return out


def _batches(batches: Iterator) -> Iterator:
    """(hashes, ends) of the training documents, some BATCH_TOKENS at a time."""
    texts, size = [], 0
    for batch in batches:
        for held, text in zip(batch.column(2).to_pylist(), batch.column(1), strict=True):
            if held:
                continue
            texts.append(text.as_py())
            size += len(texts[-1]) // 6 + 1
            if size >= BATCH_TOKENS:
                yield hashes(texts)
                texts, size = [], 0
    if texts:
        yield hashes(texts)


def _counts(c) -> dict:
    """Counts as bytes, and the large ones apart."""
    import numpy as np

    many = np.flatnonzero(c > 255)
    return {"c": np.minimum(c, 255).astype(np.uint8), "m": many.astype(np.uint32), "k": c[many].astype(np.int64)}


def _uncounts(x: dict):
    import numpy as np

    c = x["c"].astype(np.int64)
    c[x["m"]] = x["k"]
    return c


def _blobs(batches: Iterator, shards: int, model: Model | None = None) -> Iterator:
    """Rows (shard, data) of a map task: the combined counts of each batch for each shard, of words or, with the model of them, of triples."""
    import numpy as np
    import pyarrow as pa

    from .succinct import pack

    for h, ends in _batches(batches):
        rows = []
        if model is None:
            key = np.sort(h)
            start, count = _runs(key)
            key = key[start]
            for first, k in zip(*_runs(_shard(key, shards)), strict=True):
                own = {"w": key[first : first + k]} | _counts(count[first : first + k])
                rows.append((int(_shard(key[first : first + 1], shards)[0]), pack(own)))
        else:
            pair = _pair_hash(_before(h, ends), h)
            # the word after each pair; none after an end
            after = np.append(h[1:], h[:1])
            after[ends - 1] = END
            triple = _pair_hash(pair, after)
            order = np.argsort(triple)
            start, count = _runs(triple[order])
            first = order[start]
            shard = _shard(pair[first], shards)
            distinct, place = np.unique(h, return_inverse=True)
            ids = np.append(model.words_of(distinct)[0], model.words)
            # words as places among the distinct ones, the beginning after them
            prev = np.append(place[:1], place[:-1])
            prev[np.concatenate([[0], ends[:-1]])] = len(distinct)
            then = np.append(place[1:], place[:1])
            then[ends - 1] = np.searchsorted(distinct, np.uint64(END))
            t, u, w = prev[first], place[first], then[first]
            bits = np.uint64((len(distinct) + 1).bit_length())
            if int(shards).bit_length() + 2 * int(bits) <= 64:
                order = np.argsort((((shard << bits) | t.astype(np.uint64)) << bits) | u.astype(np.uint64))
            else:
                order = np.lexsort((u, t, shard))
            shard, t, u, w, count = shard[order], t[order], u[order], w[order], count[order]
            for first, k in zip(*_runs(shard), strict=True):
                own_t, own_u, own_w = (x[first : first + k] for x in (t, u, w))
                at = np.flatnonzero(np.concatenate([[True], (own_t[1:] != own_t[:-1]) | (own_u[1:] != own_u[:-1])]))
                n = np.diff(np.append(at, k))
                head, many = _runs(own_t[at])  # each word once, and each pair
                own = _planes("t", ids[own_t[at][head]], model.words) | _planes("u", ids[own_u[at]], model.words) | _planes("w", ids[own_w], model.words)
                own |= {"a": many.astype(np.min_scalar_type(many.max())), "n": n.astype(np.min_scalar_type(n.max()))} | _counts(count[first : first + k])
                rows.append((int(shard[first]), pack(own)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "data"])


def _monotone(ids, n):
    """Ids that rise within ranges of n, shifted by the last number of the range before."""
    import numpy as np

    last = ids[np.cumsum(n) - 1] + 1
    return ids + 1 + np.repeat(np.concatenate([[0], np.cumsum(last)[:-1]]), n)


def _quantise(log10p, low: float):
    import numpy as np

    return np.clip(np.rint(log10p / low * LEVELS), 0, LEVELS).astype(np.uint8)


# files


def _put(path: str, data: bytes) -> None:
    """Writes a file whole: under another name, then renamed."""
    import uuid

    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    draft = f"{p}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, p)


_maps: dict[str, tuple] = {}


def _open(path: str) -> dict | None:
    """The sequences and arrays of a file through a memory map, None where there is no such file; the latest are kept for the worker's next batches."""
    import mmap

    from .succinct import EliasFano, unpack

    if path in _maps:
        _maps[path] = _maps.pop(path)  # the latest used is the last
        return _maps[path][1]
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    size, found = 0, None
    try:
        if isinstance(system, fs.LocalFileSystem):
            with open(p, "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with system.open_input_stream(p) as source:
                data = source.read()
            size = len(data)
        x = unpack(memoryview(data))
        found = {"arrays": x} | {k: EliasFano(x, k) for k in "wcub" if k + "n" in x} | {k: x[k] for k in "pf" if k in x}
    except FileNotFoundError:
        pass
    _maps[path] = (size, found)
    while len(_maps) > 1 and (len(_maps) > MAPS or sum(n for n, _ in _maps.values()) > CACHE):
        _maps.pop(next(iter(_maps)))
    return found


def _driver_put(spark, path: str, data: bytes) -> None:
    """Writes a file from the driver."""
    fs, p = hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


class Model:
    """What every task needs of a model: its folder, the numbers of shards and the totals."""

    def __init__(self, path: str, shards_1: int, shards_2: int, words: int, tokens: int, docs: int):
        import numpy as np

        self.path, self.shards_1, self.shards_2, self.docs, self.words, self.tokens = path, shards_1, shards_2, docs, words, tokens
        self.low = -float(np.log10(self.tokens + self.words + 1 + PSEUDO)) or -1.0

    @property
    def first(self):
        """The number of words before each shard of level 1, and of all."""
        return _open(f"{self.path}/first")["f"]

    # level 1

    def words_of(self, h):
        """(id, count, quantised probability) of distinct hashes; id -1, count 0 and that of a new word where there is none."""
        import numpy as np

        ids, count, code = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        shard = _shard(h, self.shards_1).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        start, n = _runs(shard[order])
        for a, k in zip(start, n, strict=True):
            own = order[a : a + k]
            s = int(shard[own[0]])
            x = _open(f"{self.path}/level1-{s}")
            if x is None:
                continue
            at, equal = x["w"].successor(h[own])
            own, at = own[equal], at[equal]
            sums = x["c"]
            upto = sums.get(at).astype(np.int64)
            count[own] = upto - np.where(at > 0, sums.get(np.maximum(at - 1, 0)).astype(np.int64), 0)
            ids[own] = self.first[s] + at
            code[own] = x["p"][at]
        return ids, count, code

    def log_unigram(self, code):
        import numpy as np

        return np.where(code < 0, -np.log10(self.tokens + self.words + 1), code * (self.low / LEVELS))

    def counts_of(self, ids):
        """(count, quantised probability) of words by their ids."""
        import numpy as np

        count, code = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.first, ids, "right") - 1
        order = np.argsort(shard, kind="stable")
        for a, k in zip(*_runs(shard[order]), strict=True):
            own = order[a : a + k]
            s = int(shard[own[0]])
            x = _open(f"{self.path}/level1-{s}")
            at = ids[own] - self.first[s]
            count[own] = x["c"].get(at).astype(np.int64) - np.where(at > 0, x["c"].get(np.maximum(at - 1, 0)).astype(np.int64), 0)
            code[own] = x["p"][at]
        return count, code

    # level 2

    def pairs_of(self, uh, wh, ui, wi):
        """Quantised probabilities of distinct pairs (hashes and ids) in the order of contexts, -1 where a pair is not there."""
        return self.places_of(uh, wh, ui, wi)[0]

    def places_of(self, uh, wh, ui, wi):
        """(quantised probability, shard, place in it) of distinct pairs, -1 where a pair is not there."""
        import numpy as np

        code, place = np.full(len(uh), -1, np.int64), np.full(len(uh), -1, np.int64)
        shard = _shard(_pair_hash(uh, wh), self.shards_2).astype(np.int64)
        shard[(ui < 0) | (wi < 0)] = -1
        order = np.argsort(shard, kind="stable")
        start, n = _runs(shard[order])
        for a, k in zip(start, n, strict=True):
            own = order[a : a + k]
            s = int(shard[own[0]])
            x = _open(f"{self.path}/level2-{s}") if s >= 0 else None
            if x is None:
                continue
            pointers, words = x["b"], x["w"]
            # each context once: its place, its range, and the number that its successors follow
            head, many = _runs(ui[own])
            context, known = x["u"].successor(ui[own[head]].astype(np.uint64))
            own, many, context = own[np.repeat(known, many)], many[known], context[known]
            low, high = pointers.get(context).astype(np.int64), pointers.get(context + 1).astype(np.int64)
            base = np.where(low > 0, words.get(np.maximum(low - 1, 0)), 0).astype(np.uint64)
            # the successor search, relative to the context
            at, equal = words.successor(np.repeat(base, many) + wi[own].astype(np.uint64) + np.uint64(1))
            hit = equal & (at < np.repeat(high, many))
            code[own[hit]] = x["p"][at[hit]]
            place[own[hit]] = at[hit]
        return code, shard, place

    # level 3

    def triples_of(self, shard, place, wi):
        """(count, count of the pair) of distinct triples: a pair's shard and place, -1 where it is not there, and a word's id; equal pairs stand together."""
        import numpy as np

        count, total = np.zeros(len(wi), np.int64), np.zeros(len(wi), np.int64)
        shard = np.where(place < 0, -1, shard)
        order = np.argsort(shard, kind="stable")
        for a, k in zip(*_runs(shard[order]), strict=True):
            own = order[a : a + k]
            s = int(shard[own[0]])
            x = _open(f"{self.path}/level3-{s}") if s >= 0 else None
            if x is None:
                continue
            pointers, words, sums = x["b"], x["w"], x["c"]
            upto = lambda at: np.where(at > 0, sums.get(np.maximum(at - 1, 0)), 0).astype(np.int64)
            head, many = _runs(place[own])
            low, high = (pointers.get(place[own[head]] + i).astype(np.int64) for i in (0, 1))
            total[own] = np.repeat(upto(high) - upto(low), many)
            base = np.where(low > 0, words.get(np.maximum(low - 1, 0)), 0).astype(np.uint64)
            at, equal = words.successor(np.repeat(base, many) + (wi[own] + 1).astype(np.uint64))
            hit = equal & (wi[own] >= 0) & (at < np.repeat(high, many))
            count[own[hit]] = upto(at[hit] + 1) - upto(at[hit])
        return count, total


def train(docs: DataFrame, path: str) -> Model:
    """Builds the model of the documents (doc_id, text) that are not held out in a folder."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out(docs["doc_id"]).alias("held"))
    n_docs, chars = docs.filter(~F.col("held")).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards_1, shards_2 = 1 + chars // CHARS_1, 1 + chars // CHARS_2
    fs, p = hadoop(spark, path)
    fs.mkdirs(p)
    fs.mkdirs(hadoop(spark, f"{path}/counts")[1])

    def level_1(key, table):
        import numpy as np
        import pyarrow as pa

        from .succinct import EliasFano, pack, unpack

        s = key[0].as_py()
        parts = [unpack(d.as_buffer()) for d in table.column("data").combine_chunks()]
        w, c = np.concatenate([x["w"] for x in parts]), np.concatenate([_uncounts(x) for x in parts])
        del parts
        order = np.argsort(w)
        w, c = w[order], c[order]
        start, _ = _runs(w)
        w, c = w[start], np.add.reduceat(c, start)
        _put(f"{path}/counts/{s}", pack(EliasFano.build(w, "w") | EliasFano.build(np.cumsum(c), "c")))
        return pa.table({"shard": pa.array([s], pa.int32()), "words": pa.array([len(w)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64())})

    def counted(batches):
        yield from _blobs(batches, shards_1)

    import numpy as np

    from .succinct import pack

    sums = docs.mapInArrow(counted, "shard int, data binary").groupBy("shard").applyInArrow(level_1, "shard int, words long, tokens long")
    own = np.zeros(shards_1 + 1, np.int64)
    tokens = 0
    for r in sums.toLocalIterator():
        own[r["shard"] + 1] = r["words"]
        tokens += r["tokens"]
    first = np.cumsum(own)
    _driver_put(spark, f"{path}/first", pack({"f": first}))
    model = Model(path, shards_1, shards_2, int(first[-1]), tokens, n_docs)

    def finished(batches):
        """Adds the quantised probabilities, which need the totals, to level 1."""
        import numpy as np
        import pyarrow as pa

        from .succinct import pack

        for batch in batches:
            for s in batch.column(0).to_pylist():
                x = _open(f"{path}/counts/{s}")
                if x is None:
                    continue
                sums = x["c"]
                upto = sums.get(np.arange(sums.n)).astype(np.int64)
                c = np.diff(np.concatenate([[0], upto]))
                p = np.log10((c + 1) / (model.tokens + model.words + 1))
                _put(f"{path}/level1-{s}", pack(x["arrays"] | {"p": _quantise(p, model.low)}))
                _maps.pop(f"{path}/counts/{s}", None)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["shard"])

    spark.range(0, shards_1, 1, shards_1).mapInArrow(finished, "shard long").count()
    drop_path(spark, f"{path}/counts")

    def levels_2_and_3(key, table):
        import numpy as np
        import pyarrow as pa

        from .succinct import EliasFano, pack, unpack

        s = key[0].as_py()
        t, u, w, c = [], [], [], []
        for d in table.column("data").combine_chunks():
            x = unpack(d.as_buffer())
            t.append(np.repeat(np.repeat(_joined(x, "t"), x["a"]), x["n"]))
            u.append(np.repeat(_joined(x, "u"), x["n"]))
            w.append(_joined(x, "w"))
            c.append(_uncounts(x))
        t, u, w, c = (np.concatenate(x) for x in (t, u, w, c))
        order = np.lexsort((w, (t.astype(np.uint64) << np.uint64(32)) | u.astype(np.uint64))) if model.words < 1 << 32 else np.lexsort((w, u, t))
        t, u, w, c = t[order], u[order], w[order], c[order]
        start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
        c = np.add.reduceat(c, start)
        t, u, w = t[start], u[start], w[start]
        # the pairs, and the words after them; no word comes after an end
        at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (u[1:] != u[:-1])]))
        follows = u != model.words_of(np.array([END], np.uint64))[0][0]
        n = np.add.reduceat(follows.astype(np.int64), at)
        if follows.any():
            after = EliasFano.build(np.concatenate([[0], np.cumsum(n)]), "b") | EliasFano.build(_monotone(w[follows], n[n > 0]), "w") | EliasFano.build(np.cumsum(c[follows]), "c")
            _put(f"{path}/level3-{s}", pack(after))
        triples = int(n.sum())
        u, w, c = t[at], u[at], np.add.reduceat(c, at)
        del t, follows
        distinct, back = np.unique(u, return_inverse=True)
        begin = distinct == model.words
        cu = np.full(len(distinct), model.docs, np.int64)
        cu[~begin] = model.counts_of(distinct[~begin])[0]
        cu = cu[back]
        distinct, back = np.unique(w, return_inverse=True)
        pw = (10.0 ** model.log_unigram(model.counts_of(distinct)[1]))[back]
        p = _quantise(np.log10((c + PSEUDO * pw) / (cu + PSEUDO)), model.low)
        at, n = _runs(u)
        monotone = _monotone(w, n)
        pointers = np.append(at, len(w))
        _put(f"{path}/level2-{s}", pack(EliasFano.build(u[at], "u") | EliasFano.build(pointers, "b") | EliasFano.build(monotone, "w") | {"p": p}))
        return pa.table({"shard": pa.array([s], pa.int32()), "pairs": pa.array([len(w)], pa.int64()), "triples": pa.array([triples], pa.int64())})

    def paired(batches):
        yield from _blobs(batches, shards_2, model)

    docs.mapInArrow(paired, "shard int, data binary").groupBy("shard").applyInArrow(levels_2_and_3, "shard int, pairs long, triples long").count()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, pair_score (by words and pairs alone) and score (the model's: all three levels)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", held_out(docs["doc_id"]).alias("held"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                own, size, first = [], 0, at
                while at < batch.num_rows and size < BATCH_TOKENS:
                    own.append(batch.column(1)[at].as_py())
                    size += len(own[-1]) // 6 + 1
                    at += 1
                h, ends = hashes(own)
                starts = np.concatenate([[0], ends[:-1]])
                distinct, back = np.unique(h, return_inverse=True)
                ids, count, code = model.words_of(distinct)
                logs = model.log_unigram(code)
                base = np.add.reduceat(np.log10((count + 1) / (model.tokens + model.words + 1))[back], starts)
                known = np.add.reduceat((count > 0)[back].astype(np.int64), starts)
                # contexts as places among the distinct words, the beginning after them
                prev = np.empty_like(back)
                prev[1:] = back[:-1]
                prev[starts] = len(distinct)
                pair = prev * np.int64(len(distinct)) + back
                pairs, where = np.unique(pair, return_inverse=True)
                u, w = pairs // len(distinct), pairs % len(distinct)
                uh, ui, cu = np.append(distinct, np.uint64(BEGIN)), np.append(ids, model.words), np.append(count, model.docs)
                found, shard, place = model.places_of(uh[u], distinct[w], ui[u], ids[w])
                missing = np.log10(PSEUDO / (cu[u] + PSEUDO)) + logs[w]
                by_pair = np.where(found < 0, missing, found * (model.low / LEVELS))
                full = np.add.reduceat(by_pair[where], starts)
                # the pair that ends before each word, and the word; a first word keeps its pair's probability
                later = np.ones(len(h), bool)
                later[starts] = False
                later = np.flatnonzero(later)
                triples, again = np.unique(where[later - 1] * np.int64(len(distinct)) + back[later], return_inverse=True)
                c, x = triples // len(distinct), triples % len(distinct)
                seen, of = model.triples_of(shard[c], place[c], ids[x])
                by_pair_too = np.empty(len(triples))
                by_pair_too[again] = by_pair[where[later]]
                by_word = by_pair[where]
                by_word[later] = np.log10((seen + PSEUDO * 10.0**by_pair_too) / (of + PSEUDO))[again]
                fuller = np.add.reduceat(by_word, starts)
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(ends - starts, pa.int64()), pa.array(known, pa.int64()),
                    pa.array([model.tokens] * len(own), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64()), pa.array(fuller, pa.float64()),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "pair_score", "score"])

    return docs.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, pair_score double, score double")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Trains on the documents that are not held out and scores all."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select("doc_id", text_of(docs).alias("text"))
    return score(own, train(own, path or scratch(spark, "lm")))

"""Elias-Fano sequences over memory maps, for whole arrays of positions or values at a time."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one buffer, each at a multiple of 8 bytes behind a JSON directory."""
    import json

    at, directory, parts = 0, {}, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        directory[name] = [a.dtype.str, at, len(a)]
        parts.append(a.tobytes() + bytes(-a.nbytes % 8))
        at += len(parts[-1])
    head = json.dumps(directory).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


def unpack(buffer) -> dict[str, np.ndarray]:
    """The arrays of pack(); views of the buffer, so a memory map is read only where it is used."""
    import json

    n = int.from_bytes(buffer[:8], "little")
    return {k: np.frombuffer(buffer, dtype=t, count=c, offset=8 + n + at) for k, (t, at, c) in json.loads(bytes(buffer[8 : 8 + n])).items()}


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each word."""
    place = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & U64((1 << width) - 1)
        c = np.bitwise_count(low).astype(np.int64)
        up = r >= c
        r = np.where(up, r - c, r)
        word = np.where(up, word >> U64(width), low)
        place += width * up
    return place


class EliasFano:
    """A sorted sequence of unsigned numbers.

    The low halves are kept in whole bytes, one plane for each; the high halves are a bit vector of
    unary gaps with the count of ones before every word.
    """

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.high, self.ones = arrays[prefix + "h"], arrays[prefix + "o"]
        self.n, self.bits = (int(x) for x in arrays[prefix + "n"])
        self.planes = [arrays[f"{prefix}{i}"] for i in range(self.bits // 8)]
        self.zeros = arrays[prefix + "z"]
        self.last = int(self.get(np.array([self.n - 1]))[0]) if self.n else -1

    @staticmethod
    def build(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        v = np.asarray(values, U64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = 0
        while n and (top >> bits) > 4 * n:
            bits += 8
        out = {prefix + "n": np.array([n, bits], np.int64)}
        for i in range(bits // 8):
            out[f"{prefix}{i}"] = (v >> U64(8 * i)).astype(np.uint8)
        size = n + (top >> bits) + 2
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        if n:
            flags[(v >> U64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]
        return out | {prefix + "h": high, prefix + "o": ones, prefix + "z": 64 * np.arange(len(ones), dtype=np.int64) - ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), U64)
        for k, plane in enumerate(self.planes):
            out |= plane[i].astype(U64) << U64(8 * k)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i (from 0)."""
        w = np.searchsorted(self.ones, i, "right") - 1
        place = 64 * w + _select_in_word(self.high[w], i - self.ones[w])
        return ((place - i).astype(U64) << U64(self.bits)) | self._low(i)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """How many numbers have a high half of at most h."""
        w = np.searchsorted(self.zeros, h, "right") - 1
        place = 64 * w + _select_in_word(~self.high[w], h - self.zeros[w])
        return place - h

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first number of high half h and of the first one past it."""
        z = np.maximum(h - 1, 0)
        w = np.searchsorted(self.zeros, z, "right") - 1
        place = np.where(h > 0, 64 * w + _select_in_word(~self.high[w], z - self.zeros[w]), -1) + 1  # just behind the zero that ends the bucket before
        # the ones that follow are the bucket
        w, s = place >> 6, (place & 63).astype(U64)
        word = self.high[np.minimum(w, len(self.high) - 1)] >> s
        after = self.high[np.minimum(w + 1, len(self.high) - 1)]
        word = np.where(s > 0, word | (after << ((U64(64) - s) & U64(63))), word)
        gap = ~word
        size = np.bitwise_count((gap & (~gap + U64(1))) - U64(1)).astype(np.int64)
        start = place - h
        end = start + size
        long = np.flatnonzero(gap == 0)
        if len(long):
            end[long] = self._below(h[long])
        return start, end

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number of at least x (n where none is), and whether it equals x."""
        x = np.asarray(x, U64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        far = x > U64(self.last)
        h = np.where(far, 0, (x >> U64(self.bits)).astype(np.int64))
        low = x & U64((1 << self.bits) - 1)
        at, end = self._bucket(h)
        # binary search by the low halves: a bucket may be large where the numbers crowd
        to = end.copy()
        live = np.flatnonzero((at < to) & ~far)
        while len(live):
            mid = (at[live] + to[live]) >> 1
            less = self._low(mid) < low[live]
            at[live] = np.where(less, mid + 1, at[live])
            to[live] = np.where(less, to[live], mid)
            live = live[at[live] < to[live]]
        equal = np.zeros(len(x), bool)
        inside = np.flatnonzero((at < end) & ~far)
        equal[inside] = self._low(at[inside]) == low[inside]
        at[far] = self.n
        return at, equal


class BitVector:
    """Packed bits; ones are counted before every block of 512 and, within a block, before every word."""

    def __init__(self, flags: np.ndarray):
        bits = np.zeros(-(-max(len(flags), 1) // 512) * 64, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        bits[: len(packed)] = packed
        self.n, self.words = len(flags), bits.view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, 8).astype(np.int64)
        self.inner = (np.cumsum(counts, axis=1) - counts).astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before places i."""
        i = np.asarray(i, np.int64)
        w = np.minimum(i >> 6, len(self.words) - 1)
        left = (i - 64 * w).astype(U64)
        mask = np.where(left > 63, ~U64(0), (U64(1) << (left & U64(63))) - U64(1))
        return self.before[w >> 3] + self.inner.ravel()[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)

    def select(self, r: np.ndarray) -> np.ndarray:
        """Places of the r-th ones (from 0); the length where there are no more than r."""
        r = np.asarray(r, np.int64)
        out = np.full(len(r), self.n, np.int64)
        there = np.flatnonzero(r < self.ones)
        q = r[there]
        block = np.searchsorted(self.before, q, "right") - 1
        q = q - self.before[block]
        word = (self.inner[block] <= q[:, None]).sum(axis=1) - 1
        at = 8 * block + word
        out[there] = 64 * at + _select_in_word(self.words[at], q - self.inner[block, word])
        return out

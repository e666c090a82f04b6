"""Hashes of all words of many texts at once.

A word's hash is a polynomial of its bytes' random 64-bit values, taken from one running sum over the
buffer and then mixed: a few passes over the bytes, no Python object a word.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
WINDOW = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_white = np.zeros(256, bool)
_white[list(b" \t\n\x0b\x0c\r")] = True
_value = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_value[_white] = 0
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, for n places."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)]), dtype=U64) for b in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _window(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ends of the words of a buffer that ends with white space."""
    up, down = _tables(len(buffer))
    run = np.cumsum(_value[buffer] * up, dtype=U64)
    end = np.flatnonzero(_white[buffer])
    start = np.concatenate([[0], end[:-1] + 1])
    full = end > start
    start, end = start[full], end[full]
    before = np.where(start > 0, run[np.maximum(start - 1, 0)], U64(0))
    return mix((run[end] - before) * down[start]), end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other than ASCII white space) of all texts in order, and how many each text has."""
    joined = b" ".join(texts) + b" "
    buffer = np.frombuffer(joined, np.uint8)
    hashes, ends, at = [], [], 0
    while at < len(buffer):
        stop = at + WINDOW
        if stop < len(buffer):
            near = np.flatnonzero(_white[buffer[at:stop]])
            if len(near):
                stop = at + int(near[-1]) + 1
            else:  # one word longer than the window
                while stop < len(buffer) and not _white[buffer[stop]]:
                    stop += 1
                stop += 1
        h, e = _window(buffer[at : min(stop, len(buffer))])
        hashes.append(h)
        ends.append(e + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.empty(0, U64)
    e = np.concatenate(ends) if ends else np.empty(0, np.int64)
    upto = np.searchsorted(e, np.cumsum([len(t) + 1 for t in texts]) - 1, "right") if texts else np.empty(0, np.int64)
    return h, np.diff(np.concatenate([[0], upto])).astype(np.int64)

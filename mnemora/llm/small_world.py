"""Hierarchical navigable small-world graphs as flat arrays, built and searched for blocks of vectors at a time.

Vectors are unit rows of a matrix of doubles (near copies differ beyond the digits of floats), ordered by falling level, so those of level l and above are
the first ``counts[l]`` rows and a level's graph is one matrix of row numbers (-1: none), ``2 * m`` wide
at level 0 and ``m`` above. Levels are built from the top; a block of new rows is searched for among the
rows that are in, and meets its own rows by brute force. Nearness is the dot product.
"""

from __future__ import annotations

import numpy as np

#: Rows taken in or asked for at once, and bytes of marks of the rows that a block has seen.
BLOCK, SEEN_BYTES = 512, 32 << 20
#: Rows expanded at once for each query.
AT_ONCE = 4


def level_counts(keys: np.ndarray, m: int) -> tuple[np.ndarray, list[int]]:
    """The order of rows by falling level, then key, and how many have each level or a higher one. keys: 64-bit hashes, which decide the levels."""
    u = (keys.astype(np.uint64).astype(np.float64) + 1) / 2.0**64
    level = np.minimum(-np.log(np.clip(u, 2.0**-64, 1.0)) / np.log(m), 24).astype(np.int64)
    # the top level has one row at least, and no level is as large as the one below
    order = np.lexsort((keys, -level))
    counts = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
    return order, [c for i, c in enumerate(counts) if not i or c < counts[i - 1]]


def _unrepeated(ids: np.ndarray) -> np.ndarray:
    """Row numbers sorted within each line, repeats as -1."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ef nearest rows found from its entries, nearest first: numbers (-1: none) and nearness."""
    n, b = len(x), len(q)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # what -1 points at
    ids, near, fresh = np.full((b, ef), -1, np.int32), np.full((b, ef), -np.inf), np.zeros((b, ef), bool)
    live, found = np.arange(b), _unrepeated(entry.astype(np.int32))
    while len(live):
        line, column = np.nonzero(~seen[live[:, None], found])
        new = found[line, column]
        seen[live[line], new] = True
        score = np.full(found.shape, -np.inf)
        score[line, column] = np.einsum("ij,ij->i", x[new], q[live[line]])
        every = np.concatenate([near[live], score], axis=1)
        best = np.argpartition(-every, ef - 1, axis=1)[:, :ef]
        near[live] = np.take_along_axis(every, best, 1)
        ids[live] = np.where(np.isneginf(near[live]), -1, np.take_along_axis(np.concatenate([ids[live], found], axis=1), best, 1))
        fresh[live] = np.take_along_axis(np.concatenate([fresh[live], ~np.isneginf(score)], axis=1), best, 1)
        open_near = np.where(fresh[live], near[live], -np.inf)
        step = min(AT_ONCE, ef)
        pick = np.argpartition(-open_near, step - 1, axis=1)[:, :step]
        some = ~np.isneginf(np.take_along_axis(open_near, pick, 1))
        on = some.any(axis=1)
        live, pick, some = live[on], pick[on], some[on]
        fresh[live[:, None], pick] = False
        at = np.where(some, ids[live[:, None], pick], -1)
        found = _unrepeated(np.where((at >= 0)[:, :, None], links[at], -1).reshape(len(live), step * links.shape[1]))
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _block(n: int) -> int:
    return max(16, min(BLOCK, SEEN_BYTES // (n + 1)))


def _descend(x: np.ndarray, above: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """Entries for the level below those given (from the top)."""
    entry = np.zeros((len(q), 1), np.int32)
    for links in above:
        entry = beam(x[: len(links)], links, q, np.maximum(entry, 0), 8)[0][:, :4]
    return np.maximum(entry, 0)


def _chosen(x: np.ndarray, ids: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """Of each line's candidates the near ones that no nearer choice is nearer to, filled up with the nearest others."""
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    out = np.full((len(ids), width), -1, np.int32)
    for a in range(0, len(ids), 1024):
        own, own_near = ids[a : a + 1024], near[a : a + 1024]
        v = x[own]
        pairs = np.matmul(v, v.transpose(0, 2, 1))
        none = own < 0
        blocked, kept, count = none.copy(), np.zeros(own.shape, bool), np.zeros(len(own), np.int64)
        for j in range(own.shape[1]):
            take = ~blocked[:, j] & (count < width)
            kept[:, j] = take
            count += take
            blocked |= take[:, None] & (pairs[:, j] > own_near)
        rank = np.argsort(np.where(kept, 0, np.where(none, 2, 1)), axis=1, kind="stable")[:, :width]
        out[a : a + 1024, : rank.shape[1]] = np.take_along_axis(own, rank, 1)
    return out


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Adds the links of new rows to the rows that they point at; where those have too many, they choose anew."""
    width = links.shape[1]
    source, target = np.repeat(new, width), links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    near = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-near, target))
    source, target = source[order], target[order]
    who, start = np.unique(target, return_index=True)
    place = np.arange(len(target)) - start[np.searchsorted(who, target)]
    first = place < width
    arrived = np.full((len(who), width), -1, np.int32)
    arrived[np.searchsorted(who, target[first]), place[first]] = source[first]
    every = _unrepeated(np.concatenate([links[who], arrived], axis=1))
    have = (every >= 0).sum(axis=1)
    few = have <= width
    links[who[few]] = np.sort(every[few], axis=1)[:, ::-1][:, :width]
    rest, every = who[~few], every[~few]
    if len(rest):
        score = np.concatenate([np.einsum("ijk,ik->ij", x[every[a : a + 1024]], x[rest[a : a + 1024]]) for a in range(0, len(rest), 1024)])
        links[rest] = _chosen(x, every, np.where(every < 0, -np.inf, score), width)


def _level(x: np.ndarray, width: int, ef: int, above: list[np.ndarray]) -> np.ndarray:
    n, done = len(x), 0
    links = np.full((n, width), -1, np.int32)
    while done < n:
        new = np.arange(done, min(n, done + min(_block(n), max(64, done))))
        q = x[new]
        near = q @ q.T
        np.fill_diagonal(near, -np.inf)
        k = min(ef, len(new))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, best, 1)
        ids = np.where(np.isneginf(near), -1, new[best]).astype(np.int32)
        if done:
            entry = _descend(x, above, q)
            old, old_near = beam(x[:done], links[:done], q, np.where(entry < done, entry, 0), ef)
            ids, near = np.concatenate([ids, old], axis=1), np.concatenate([near, old_near], axis=1)
            best = np.argpartition(-near, ef - 1, axis=1)[:, :ef]
            ids, near = np.take_along_axis(ids, best, 1), np.take_along_axis(near, best, 1)
        links[new] = _chosen(x, ids, near, width)
        _link_back(x, links, new)
        done += len(new)
    return links


def build(x: np.ndarray, counts: list[int], m: int, ef: int) -> list[np.ndarray]:
    """The links of each level, level 0 first."""
    graphs: list[np.ndarray] = []
    for level in reversed(range(len(counts))):
        graphs.append(_level(x[: counts[level]], m if level else 2 * m, ef, graphs))
    return graphs[::-1]


def search(x: np.ndarray, graphs: list[np.ndarray], q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest rows found for each query, nearest first."""
    parts = []
    for a in range(0, len(q), _block(len(x))):
        own = q[a : a + _block(len(x))]
        parts.append(beam(x, graphs[0], own, _descend(x, graphs[:0:-1], own), ef))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

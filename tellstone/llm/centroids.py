"""Centroids of balanced clusters, and a graph over them that is searched in memory."""

from __future__ import annotations

import math

import numpy as np

#: Parts a cluster is split into at a time, and rounds of refining them.
BRANCHES, ROUNDS = 8, 4
#: Neighbours of a centroid in the graph, and candidates kept during a search at least (more for many centroids).
DEGREE, WIDTH = 16, 24
#: So many centroids are compared sooner than a beam search, as wide as the root of their number at least, is through.
COMPARED = 32_768


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


def balanced_centroids(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of clusters of at most ``leaf`` sample vectors, and the number of each: clusters are split until they are small.

    Parts of one cluster follow each other. A cluster whose vectors can't be told apart stays whole.
    """
    todo, out, sizes = [np.arange(len(sample))], [], []
    while todo:
        rows = todo.pop()
        x = sample[rows]
        k = min(BRANCHES, -(-len(rows) // leaf))
        if k > 1:
            centers = x[rng.choice(len(rows), k, replace=False)]
            for _ in range(ROUNDS):
                part = (x @ centers.T).argmax(axis=1)
                sums = np.stack([np.bincount(part, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
                lengths = np.linalg.norm(sums, axis=1)
                centers = np.where(lengths[:, None] > 0, sums / np.maximum(lengths, 1e-12)[:, None], centers).astype(np.float32)
            part = (x @ centers.T).argmax(axis=1)
            parts = [rows[part == i] for i in range(k) if (part == i).any()]
            if len(parts) > 1:
                todo += parts
                continue
        mean = x.mean(axis=0, dtype=np.float64)
        length = np.linalg.norm(mean)
        out.append(mean / length if length > 1e-9 else x[0])
        sizes.append(len(rows))
    return np.array(out, np.float32), np.array(sizes)


class CentroidGraph:
    """Nearest centroids by a beam search over a neighbour graph, many queries at once.

    Each centroid is linked to its nearest ones and to a few random ones, which join
    regions that lie apart. A search begins at entry points chosen far from each other.
    """

    def __init__(self, centroids: np.ndarray, rng: np.random.Generator):
        self.centroids = centroids
        n = len(centroids)
        near = min(DEGREE - 4, n - 1)
        links = np.empty((n, near), np.int32)
        for at in range(0, n, 1024):
            sims = centroids[at : at + 1024] @ centroids.T
            sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
            links[at : at + 1024] = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near else 0
        self.links = np.concatenate([links, rng.integers(0, n, (n, min(4, n)), dtype=np.int32)], axis=1)
        entries, best = [int(rng.integers(n))], None
        while len(entries) < min(n, 8):
            sims = centroids @ centroids[entries[-1]]
            best = sims if best is None else np.maximum(best, sims)
            entries.append(int(best.argmin()))
        self.entries = np.unique(np.array(entries, np.int32))

    def search(self, queries: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ids of its ``count`` nearest centroids and their similarities, best first (-1 where there are fewer)."""
        ids = np.full((len(queries), count), -1, np.int32)
        sims = np.full((len(queries), count), -2, np.float32)
        for at in range(0, len(queries), 512):
            i, s = self._beam(queries[at : at + 512], max(2 * count, WIDTH, math.isqrt(len(self.centroids))))
            ids[at : at + 512, : i.shape[1]], sims[at : at + 512, : i.shape[1]] = i[:, :count], s[:, :count]
        return ids, sims

    def within(self, queries: np.ndarray, ratio: float, first: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, centroid and place of all centroids at most ``ratio`` times as far as a query's nearest; a query's come nearest first.

        Up to COMPARED centroids are compared all. Of more the search is repeated with a wider beam for the queries whose last centroid is still
        within the ratio, and where it would be as wide as a quarter of the graph, all are compared.
        """
        if len(self.centroids) <= COMPARED:
            return self._all_within(queries, ratio)
        out, active, count = [], np.arange(len(queries)), first
        while len(active):
            if 4 * count >= len(self.centroids):
                row, ids, place = self._all_within(queries[active], ratio)
                out.append((active[row], ids, place))
                break
            ids, sims = self.search(queries[active], count)
            far = np.where(ids >= 0, np.sqrt(np.maximum(0, 2 - 2 * sims)), np.inf)
            near = far <= far[:, :1] * ratio
            done = ~near[:, -1] | (ids.shape[1] >= len(self.centroids))
            row, place = np.nonzero(near & done[:, None])
            out.append((active[row], ids[row, place], place))
            active, count = active[~done], 4 * count
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def _all_within(self, queries: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``within`` by comparing all centroids; only those within the ratio are sorted."""
        out, some = [(np.empty(0, np.int64),) * 3], max(1, 4_000_000 // len(self.centroids))
        for at in range(0, len(queries), some):
            sims = queries[at : at + some] @ self.centroids.T
            nearest = np.sqrt(np.maximum(0, 2 - 2 * sims.max(axis=1)))
            row, ids = np.divmod(np.flatnonzero(sims >= (1 - (nearest * ratio) ** 2 / 2 - 1e-5)[:, None]), sims.shape[1])
            found = sims[row, ids]
            good = np.sqrt(np.maximum(0, 2 - 2 * found)) <= nearest[row] * np.float32(ratio)
            row, ids, found = row[good], ids[good], found[good]
            order = np.lexsort((-found, row))
            row, ids = row[order], ids[order]
            out.append((at + row, ids, np.arange(len(row)) - np.searchsorted(row, row)))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(q), len(self.centroids)
        width = min(width, k)
        met = np.zeros((n, k), bool)
        met[:, self.entries] = True
        start = q @ self.centroids[self.entries].T
        pad = max(0, width - len(self.entries))
        ids = np.pad(np.broadcast_to(self.entries, start.shape), ((0, 0), (0, pad)), constant_values=-1)
        sims = np.pad(start, ((0, 0), (0, pad)), constant_values=-2)
        order = np.argsort(-sims, axis=1)[:, :width]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        tried = ids < 0
        active = np.arange(n)
        while len(active):
            a_ids, a_sims, a_tried = ids[active], sims[active], tried[active]
            line = np.arange(len(active))
            pick = (~a_tried).argmax(axis=1)  # sorted, so the first that is untried is the best
            a_tried[line, pick] = True
            links = self.links[a_ids[line, pick]]
            fresh = ~met[active[:, None], links]
            met[active[:, None], links] = True
            first = np.sort(links, axis=1)
            if (first[:, 1:] == first[:, :-1]).any():  # a link may be there twice
                order = np.argsort(links, axis=1, kind="stable")
                same = np.zeros_like(fresh)
                ordered = np.take_along_axis(links, order, 1)
                np.put_along_axis(same, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
                fresh &= ~same
            found = np.where(fresh, np.einsum("nd,nkd->nk", q[active], self.centroids[links], optimize=False), np.float32(-2))
            all_ids, all_sims = np.concatenate([a_ids, links], 1), np.concatenate([a_sims, found], 1)
            all_tried = np.concatenate([a_tried, ~fresh], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[active], sims[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
            tried[active] = np.take_along_axis(all_tried, order, 1)
            active = active[~tried[active].all(axis=1)]
        return np.where(sims > -2, ids, -1), sims

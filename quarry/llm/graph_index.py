"""A robust-pruned directed graph over unit vectors and beam search in it.

Points are inserted in batches that double up to a part of the graph: a greedy
beam search in the graph so far proposes their neighbours; relaxed distance
pruning (a neighbour is dropped if one already kept is ``alpha`` times closer
to it than the point) keeps diverse edges; reverse edges are added and pruned
likewise.  A second pass searches the whole graph from every point and prunes
what it finds together with the edges, so points of one batch meet as well.
Every step is an array operation over a block of queries.
"""

from __future__ import annotations

import numpy as np

DEGREE, SLACK = 20, 20
BEAM, BUILD_BEAM, WIDTH = 12, 24, 4
ALPHA = 1.2
BATCH, QUERIES = 1024, 256
ENTRIES, STARTS = 1024, 16


class Graph:
    """The index of one shard; ``x`` holds unit vectors as float32 rows."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        self.x = np.ascontiguousarray(x, np.float32)
        self.n = len(x)
        self.edges = np.full((self.n + 1, DEGREE + SLACK), -1, np.int32)  # the last row stands for no point
        self.degree = np.zeros(self.n, np.int32)
        order = np.random.default_rng(seed).permutation(self.n).astype(np.int32)
        self.entries, done = order[:1], 1
        while done < self.n:
            batch = order[done : done + min(BATCH, done)]
            self._link(batch, *self.search(self.x[batch], BUILD_BEAM))
            done += len(batch)
            self.entries = order[: min(ENTRIES, done)]
        for at in range(0, self.n, BATCH):
            batch = order[at : at + BATCH]
            ids, sims = self.around(batch, BUILD_BEAM)
            known = self.edges[batch]
            near = np.where(known < 0, -np.inf, np.einsum("ijk,ik->ij", self.x[known], self.x[batch]))
            self._link(batch, np.hstack([ids, known]), np.hstack([sims, near]))

    def _prune(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Up to ``DEGREE`` diverse neighbours among candidates (-1 is none)."""
        by_id = np.argsort(ids, axis=1)
        ids, sims = np.take_along_axis(ids, by_id, 1), np.take_along_axis(sims, by_id, 1)
        bad = (ids < 0) | (ids == points[:, None])
        bad[:, 1:] |= ids[:, 1:] == ids[:, :-1]
        sims = np.where(bad, -np.inf, sims)
        keep = min(DEGREE + SLACK, ids.shape[1])
        order = np.argsort(-sims, axis=1)[:, :keep]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        gap = np.maximum(1 - sims, 0)  # half the squared distance to the point
        vectors = self.x[ids]
        hides = ALPHA * ALPHA * np.maximum(1 - vectors @ vectors.transpose(0, 2, 1), 0) <= gap[:, None, :]
        alive, kept = sims > -np.inf, np.zeros(ids.shape, bool)
        taken = np.zeros(len(points), np.int64)
        for j in range(keep):
            chosen = alive[:, j] & (taken < DEGREE)
            kept[:, j] = chosen
            taken += chosen
            alive &= ~(hides[:, j] & chosen[:, None])
        out = np.full((len(points), DEGREE), -1, np.int32)
        row, col = np.nonzero(kept)
        out[row, (np.cumsum(kept, axis=1) - 1)[row, col]] = ids[row, col]
        return out

    def _link(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Edges of points to pruned candidates, and back."""
        for at in range(0, len(points), 512):
            some = points[at : at + 512]
            out = self._prune(some, ids[at : at + 512], sims[at : at + 512])
            self.edges[some] = -1
            self.edges[some, :DEGREE] = out
            self.degree[some] = (out >= 0).sum(1)
        rows, cols = np.nonzero(self.edges[points, :DEGREE] >= 0)
        source, target = points[rows], self.edges[points[rows], cols]
        fresh = ~(self.edges[target] == source[:, None]).any(1)
        source, target = source[fresh], target[fresh]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            first = np.flatnonzero(np.diff(target, prepend=-1))
            counts = np.diff(np.append(first, len(target)))
            rank = np.arange(len(target)) - np.repeat(first, counts)
            room = self.edges.shape[1] - self.degree[target]
            fits = rank < room
            self.edges[target[fits], self.degree[target[fits]] + rank[fits]] = source[fits]
            np.add.at(self.degree, target[fits], 1)
            source, target = source[~fits], target[~fits]
            full = np.unique(target)
            for at in range(0, len(full), 512):
                some = full[at : at + 512]
                ids = self.edges[some]
                near = np.einsum("ijk,ik->ij", self.x[ids], self.x[some])
                self.edges[some] = -1
                self.edges[some, :DEGREE] = out = self._prune(some, ids, near)
                self.degree[some] = (out >= 0).sum(1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first, of ``beam`` points near each query; -1 where there are fewer."""
        parts = []
        for at in range(0, len(q), QUERIES):
            some = q[at : at + QUERIES]
            near = some @ self.x[self.entries].T
            k = min(STARTS, len(self.entries), beam)
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            parts.append(self._beam(some, self.entries[top], np.take_along_axis(near, top, 1), beam))
        return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])

    def around(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """``search`` for points of the graph, each starting from itself; it is the first of its own answers."""
        parts = [self._beam(self.x[s], s[:, None], np.ones((len(s), 1), np.float32), beam) for at in range(0, len(points), QUERIES) for s in [points[at : at + QUERIES]]]
        return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])

    def _beam(self, q: np.ndarray, starts: np.ndarray, near: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        b, n, k = len(q), self.n, starts.shape[1]
        out_ids, out_sims = np.full((b, beam), -1, np.int32), np.full((b, beam), -np.inf, np.float32)
        met = np.zeros(b * n, bool)
        # a row holds 2 id + 1 once the point was opened, so that one array is moved about
        ids, sims = np.full((b, beam), -1, np.int32), np.full((b, beam), -np.inf, np.float32)
        ids[:, :k], sims[:, :k] = starts * 2, near
        live, base = np.arange(b), np.arange(b) * n
        met[(base[:, None] + starts).ravel()] = True
        w = min(WIDTH, beam)
        while True:
            open_sims = np.where(ids & 1, -np.inf, sims)
            pick = np.argpartition(-open_sims, w - 1, axis=1)[:, :w]
            line = np.arange(len(live)) * beam
            flat = pick + line[:, None]
            real = open_sims.ravel()[flat] > -np.inf
            some = real.any(1)
            if not some.all():
                out_ids[live[~some]], out_sims[live[~some]] = ids[~some], sims[~some]
                if not some.any():
                    break
                live, base, ids, sims, pick, real, q = live[some], base[some], ids[some], sims[some], pick[some], real[some], q[some]
                line = line[: len(live)]
                flat = pick + line[:, None]
            nodes = ids.ravel()[flat]
            ids.ravel()[flat] = nodes | 1
            new = self.edges[np.where(real, nodes >> 1, n)].reshape(len(live), -1)
            new = np.sort(new, axis=1)
            again = new < 0
            again[:, 1:] |= new[:, 1:] == new[:, :-1]
            at = new + base[:, None]
            row, col = np.nonzero(~again)
            spot = at[row, col]
            unseen = ~met[spot]
            row, spot = row[unseen], spot[unseen]
            if not len(row):
                continue
            met[spot] = True
            found = (spot - base[row]).astype(np.int32)
            value = np.einsum("ij,ij->i", self.x[found], q[row])
            better = value > sims.min(1)[row]
            row, found, value = row[better], found[better], value[better]
            counts = np.bincount(row, minlength=len(live))
            most = int(counts.max(initial=0))
            if not most:
                continue
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            all_ids, all_sims = np.full((len(live), beam + most), -1, np.int32), np.full((len(live), beam + most), -np.inf, np.float32)
            all_ids[:, :beam], all_sims[:, :beam] = ids, sims
            all_ids[row, beam + place], all_sims[row, beam + place] = found * 2, value
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids, sims = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
        out_ids = np.where(np.isneginf(out_sims), -1, out_ids >> 1)
        order = np.argsort(-out_sims, axis=1, kind="stable")
        return np.take_along_axis(out_ids, order, 1), np.take_along_axis(out_sims, order, 1)

"""A hierarchical navigable small-world graph as flat neighbour arrays."""

from __future__ import annotations

import heapq

import numpy as np


class Graph:
    """Inner-product search through an HNSW graph over unit-length rows of ``x``.

    Level ``l`` keeps ``links[l]``: one row of neighbour numbers a node, -1 where free.
    Nodes of a level come first in a seeded order, so a level is a prefix of the nodes.
    """

    def __init__(self, x: np.ndarray, m: int = 16, reach: int = 64, seed: int = 7):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.m, self.reach = m, reach
        draw = np.random.default_rng(seed).random(n)
        height = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(int), 12)
        order = np.argsort(-height, kind="stable")
        self.x, self.of = self.x[order], order  # node -> row of the input
        sizes = [int((height >= l).sum()) for l in range(int(height.max(initial=0)) + 1)]
        self.links = [np.full((s, 2 * m if l == 0 else m), -1, np.int32) for l, s in enumerate(sizes)]
        self.seen = np.zeros(n, np.int64)
        self.round = 0
        for i in range(1, n):
            self._insert(i)

    def _greedy(self, q: np.ndarray, at: int, level: int) -> int:
        links = self.links[level]
        best = float(self.x[at] @ q)
        while True:
            near = links[at]
            near = near[near >= 0]
            if not len(near):
                return at
            near_scores = self.x[near] @ q
            i = int(near_scores.argmax())
            if near_scores[i] <= best:
                return at
            at, best = int(near[i]), float(near_scores[i])

    def _beam(self, q: np.ndarray, at: int, level: int, reach: int) -> list[tuple[float, int]]:
        """Up to ``reach`` of the nearest nodes met, best first."""
        links, x, seen = self.links[level], self.x, self.seen
        self.round += 1
        mark = self.round
        s = float(x[at] @ q)
        seen[at] = mark
        todo, found = [(-s, at)], [(s, at)]
        while todo:
            s, at = heapq.heappop(todo)
            if len(found) >= reach and -s < found[0][0]:
                break
            near = links[at]
            near = near[near >= 0]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            scores = x[near] @ q
            if len(found) >= reach:
                ok = scores > found[0][0]
                near, scores = near[ok], scores[ok]
            for s, j in zip(scores.tolist(), near.tolist()):
                if len(found) < reach:
                    heapq.heappush(found, (s, j))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, j))
                else:
                    continue
                heapq.heappush(todo, (-s, j))
        return sorted(found, reverse=True)

    def _spread(self, nodes: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Of nodes sorted by nearness, those nearer to the centre than to one taken before."""
        if len(nodes) <= most:
            return nodes
        between = self.x[nodes] @ self.x[nodes].T
        taken: list[int] = []
        for i in range(len(nodes)):
            if not taken or between[i, taken].max() < scores[i]:
                taken.append(i)
                if len(taken) == most:
                    break
        if len(taken) < most:  # fill with the nearest left out
            rest = [i for i in range(len(nodes)) if i not in set(taken)]
            taken = sorted(taken + rest[: most - len(taken)])
        return nodes[taken]

    def _insert(self, i: int) -> None:
        q, at = self.x[i], 0
        own = max(l for l, k in enumerate(self.links) if i < len(k))
        for level in range(len(self.links) - 1, own, -1):
            at = self._greedy(q, at, level)
        for level in range(own, -1, -1):
            links = self.links[level]
            found = self._beam(q, at, level, self.reach)
            at = found[0][1]
            scores, nodes = np.array([s for s, _ in found]), np.array([j for _, j in found])
            mine = self._spread(nodes, scores, self.m)
            links[i, : len(mine)] = mine
            for j in mine.tolist():
                row = links[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                    continue
                all_of = np.append(row, i)
                s = self.x[all_of] @ self.x[j]
                order = np.argsort(-s, kind="stable")
                keep = self._spread(all_of[order], s[order], links.shape[1])
                row[:] = -1
                row[: len(keep)] = keep

    def search(self, q: np.ndarray, k: int, reach: int) -> np.ndarray:
        """Rows of the input nearest to ``q``, best first, at most ``k``."""
        if not len(self.x):
            return np.zeros(0, np.int64)
        q, at = np.asarray(q, np.float32), 0
        for level in range(len(self.links) - 1, 0, -1):
            at = self._greedy(q, at, level)
        return self.of[[j for _, j in self._beam(q, at, 0, max(reach, k))[:k]]]

    def dump(self) -> dict[str, bytes | list[int]]:
        """The graph as flat arrays: neighbour rows of all levels one after another."""
        return {
            "sizes": [len(x) for x in self.links],
            "links": b"".join(x.tobytes() for x in self.links),
            "nodes": self.of.astype(np.int64).tobytes(),
        }

    @classmethod
    def load(cls, x: np.ndarray, m: int, sizes: list[int], links: bytes, nodes: bytes) -> Graph:
        """The graph over input rows ``x`` from what ``dump`` wrote."""
        g = cls.__new__(cls)
        g.m, g.round, g.of = m, 0, np.frombuffer(nodes, np.int64)
        g.x = np.ascontiguousarray(x[g.of], np.float32)
        g.seen, g.reach = np.zeros(len(x), np.int64), 0
        flat, at, g.links = np.frombuffer(links, np.int32), 0, []
        for level, n in enumerate(sizes):
            wide = 2 * m if level == 0 else m
            g.links.append(flat[at : at + n * wide].reshape(n, wide))
            at += n * wide
        return g

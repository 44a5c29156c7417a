"""A hierarchical Hamming index over fingerprints in Gray order, as plain arrays.

Fingerprints of one bucket are sorted by their rank in the Gray sequence, where neighbours
tend to share bits.  Every FAN consecutive ones hang under a node; a node holds the bits
that all of its members share (value and mask) and passes on only the rest, so a shared
pattern is compared once for the whole group.  A search walks down level by level: the
differences found in the nodes above are carried along, and a group is left as soon as they
exceed the limit.  All searches of a level are one vectorised step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
FRONT = 1 << 20  # (search, node) pairs held at once

U64 = np.uint64


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence: the inverse of ``i ^ (i >> 1)``."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> U64(s)
    return r


class GrayIndex:
    """A forest: one tree per bucket.  ``bucket`` must be sorted, codes in Gray order within."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        full = np.full(len(codes), ~U64(0))
        values, masks, owner = codes, full, bucket
        shared: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # bottom up: what the members of each group agree on
        while True:
            new = np.r_[True, owner[1:] != owner[:-1]]
            at = np.flatnonzero(new)
            rank = np.arange(len(owner)) - np.repeat(at, np.diff(np.r_[at, len(owner)]))
            head = np.flatnonzero(new | (rank % FAN == 0))
            size = np.diff(np.r_[head, len(owner)])
            shared.append((values, masks, owner))
            low, high = np.bitwise_and.reduceat(values, head), np.bitwise_or.reduceat(values, head)
            mask = np.bitwise_and.reduceat(masks, head) & ~(low ^ high)
            self.levels.append((head, size, values, masks))
            values, masks, owner = low & mask, mask, owner[head]
            if len(at) == len(head):
                break
        self.roots, self.root_values, self.root_masks = owner, values, masks
        # top down: bits settled above are not compared again below
        above = masks
        residual = []
        for head, size, v, m in reversed(self.levels):
            up = np.repeat(above, size)
            residual.append((head, size, v, m & ~up))
            above = m
        self.levels = residual

    def within(self, codes: np.ndarray, trees: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(search, leaf) index pairs at ``limit`` or fewer differing bits; blocks of FRONT.

        ``trees`` is the root of each search's own bucket.
        """
        step = max(1, FRONT // (FAN * FAN))
        for at in range(0, len(codes), step):
            q = np.arange(at, min(at + step, len(codes)))
            node = trees[q]
            far = np.bitwise_count((codes[q] ^ self.root_values[node]) & self.root_masks[node])
            near = far <= limit
            yield from self._down(0, codes, q[near], node[near], far[near], limit)

    def _down(self, level, codes, q, node, far, limit):
        if level == len(self.levels):
            if len(q):
                yield q, node
            return
        head, size, values, masks = self.levels[level]
        step = max(1, FRONT // FAN)
        for at in range(0, len(q), step):
            qs, ns, fs = q[at : at + step], node[at : at + step], far[at : at + step]
            n = size[ns]
            first = np.cumsum(n) - n
            child = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(head[ns], n)
            qs, fs = np.repeat(qs, n), np.repeat(fs, n)
            fs = fs + np.bitwise_count((codes[qs] ^ values[child]) & masks[child])
            near = fs <= limit
            yield from self._down(level + 1, codes, qs[near], child[near], fs[near], limit)


def close_pairs(bucket: np.ndarray, codes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of codes of one bucket (larger, smaller) that differ in 1 to ``limit`` bits."""
    order = np.lexsort((gray_rank(codes), bucket))
    bucket, codes = bucket[order], codes[order]
    index = GrayIndex(bucket, codes)
    tree = np.searchsorted(index.roots, bucket)
    for q, leaf in index.within(codes, tree, limit):
        up = codes[q] > codes[leaf]
        yield codes[q[up]], codes[leaf[up]]

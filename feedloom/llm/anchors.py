"""Anchors: in every window of a text the position whose k-gram hash is least."""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 32
CHUNK = 1 << 19  # window starts handled at once
POSITION_BITS = 20

U64 = np.uint64
_MIX = U64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings, by doubling their length."""
    h = (raw.astype(U64) + U64(1)) * _MIX
    h ^= h >> U64(29)
    step = 1
    while step < GRAM:
        h = (h[:-step] * U64(0xBF58476D1CE4E5B9)) ^ (h[step:] * U64(0x94D049BB133111EB))
        h ^= h >> U64(31)
        step *= 2
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def runs(text: bytes, width: int) -> list[tuple[int, int, int, int, int]]:
    """(anchor hash, context hash, anchor, first, last) of each run of windows.

    The windows that start at first..last are all those anchored at ``anchor``; the context
    is the bytes they cover, with the anchor's place in it.  Equal windows have their
    anchor at the same place, whatever surrounds them.
    """
    n = len(text)
    out: list[tuple[int, int, int, int, int]] = []
    reach = width - GRAM + 1
    for at in range(0, n - width + 1, CHUNK):
        end = min(n, at + CHUNK + width - 1)
        h = gram_hashes(np.frombuffer(text, np.uint8, end - at, at))
        low = U64((1 << POSITION_BITS) - 1)
        least = sliding_least((h & ~low) | np.arange(len(h), dtype=U64), reach)
        anchor = (least & low).astype(np.int64)
        head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        tail = np.r_[head[1:] - 1, len(anchor) - 1]
        pos = anchor[head]
        for a, x, p, z in zip(h[pos].view(np.int64).tolist(), (pos + at).tolist(), (head + at).tolist(), (tail + at).tolist()):
            if out and out[-1][2] == x:  # a run over the edge of two chunks
                a, _, x, p, _ = out.pop()
            context = xxhash.xxh3_64_intdigest(text[p : z + width], seed=x - p)
            out.append((a, context - (1 << 64) if context >> 63 else context, x, p, z))
    return out

"""Sets of five-word shingles, and the texts whose sets have a Jaccard similarity of 0.8 or more.

Shingles are the same words as in ``fingerprints``, five at a time, each named by its
XXH64; fewer words make one shingle of all words, a text without words has none.

Two sets at SIMILAR or more share a shingle among the first ``n - ceil(0.8 n) + 1`` of
each, in any one order of all shingles (prefix filter), so texts that share one of these
leading shingles are candidates and no similar pair is missed.  The order is that of the
hashes, with shingles seen in many texts last; which ones those are changes the number of
candidates, never the result.

A candidate row carries what tells most pairs apart where they meet: the size of its set,
the place of the shingle in it, and a bitmap of BITS parities (a bit is the number of
shingles that fall on it, modulo two).  Sets that differ in d shingles have bitmaps that
differ in at most d bits, and from the first shingle they share no more can be common than
what is left of either; both bounds are exact, so no similar pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .fingerprints import BLOCK, SEED, signed

SHINGLE = 5
SIMILAR = (4, 5)  # 0.8
ALL_PAIRS = 64  # texts under one shingle that are compared each with each at once
BITS = 256
ROWS_AT_ONCE = 200_000


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower touches A-Z only
    if not words:
        return np.empty(0, np.uint64)
    hash64, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= width:
        return np.array([hash64(join(words), SEED)], np.uint64)
    n = len(words) - width + 1
    parts = []
    for at in range(0, n, BLOCK):
        end = min(at + BLOCK, n)
        cols = zip(*[words[at + i : end + i] for i in range(width)])
        parts.append(np.unique(np.fromiter((hash64(join(w), SEED) for w in cols), np.uint64, end - at)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def name(found: np.ndarray) -> int:
    """A signed long that names the set."""
    return signed(xxhash.xxh3_64_intdigest(found.tobytes(), SEED))


def leading(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of a set one of which any similar set leads with as well; ``common`` (sorted) stand last."""
    up, down = SIMILAR
    n = len(found)
    if not n:
        return found
    size = n - -(-n * up // down) + 1
    if len(common):
        last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~last], found[last]])
    return found[:size]


def bitmap(found: np.ndarray) -> list[int]:
    """BITS parities of a set as signed longs."""
    odd = np.bincount((found & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def possible(n: np.ndarray, place: np.ndarray, bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) of rows under a shingle can be similar, if it is the first one they share.

    ``n``: sizes of the sets, ``place``: of the shingle in each (from 0), ``bits``: bitmaps, a row each.
    """
    up, down = SIMILAR
    need = -(-up * (n[x] + n[y]) // (up + down))  # shingles that similar sets have in common
    ok = np.minimum(n[x] - place[x], n[y] - place[y]) >= need  # so their sizes fit as well
    at = np.flatnonzero(ok)
    x, y = x[at], y[at]
    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
    ok[at] = apart <= n[x] + n[y] - 2 * need[at]
    return ok


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (shingle, ...), sorted by shingle, whose shingle another row has as well."""
    last, like = None, False  # the row not decided yet, and whether it is like the one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
        key = rows.column(0).to_numpy()
        same = key[1:] == key[:-1]
        before = np.r_[like, same]
        keep = before[:-1] | same
        if keep.any():
            yield from rows.slice(0, len(key) - 1).filter(pa.array(keep)).to_batches()
        last, like = rows.slice(len(key) - 1).combine_chunks().to_batches()[0], bool(before[-1])
    if like:
        yield last


def candidates(pivots: int, all_pairs: int = ALL_PAIRS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (shingle, node, n, place, root, bits...) sorted by shingle and node: pairs (a, b) of nodes to compare.

    Up to ``all_pairs`` nodes under a shingle are paired each with each; of more, the first
    ``pivots`` with all.  Nodes of one group (``root``) need no pair, nor do those that cannot be similar.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs_of(shingle):
        new = np.r_[True, shingle[1:] != shingle[:-1]]
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, len(shingle)])
        few = np.repeat(size <= all_pairs, size)
        for step in range(1, min(int(size.max()), all_pairs)):
            x = np.flatnonzero(few[:-step] & (shingle[step:] == shingle[:-step]))
            if not len(x):
                break
            yield x, x + step
        many = size > all_pairs
        rank = np.arange(len(shingle)) - np.repeat(head, size)
        for p in range(min(pivots, int(size.max()))):  # the p-th of every crowded shingle, all at once
            x = np.flatnonzero(np.repeat(many, size) & (rank > p))
            if not len(x):
                break
            yield x - rank[x] + p, x

    def distinct(made):
        x, y = (np.concatenate(z) for z in zip(*made))
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        head = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(x[head]), pa.array(y[head])], schema=out)

    def flush(cols):
        shingle, node, n, place, root = cols[:5]
        bits = np.stack(cols[5:], axis=1).view(np.uint64)  # of signed numbers the bits of the absolute value are counted
        made, held = [], 0
        for x, y in pairs_of(shingle):
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            ok = possible(n, place, bits, x, y)
            made.append((node[x[ok]], node[y[ok]]))
            held += len(made[-1][0])
            if held >= ROWS_AT_ONCE:
                yield distinct(made)
                made, held = [], 0
        if held:
            yield distinct(made)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(batch.num_columns)))
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                cols = tuple(np.concatenate(x) for x in zip(*held))
                edge = np.flatnonzero(cols[0][1:] != cols[0][:-1])
                cut = int(edge[-1]) + 1 if len(edge) else 0
                if cut:
                    yield from flush(tuple(c[:cut] for c in cols))
                held, rows = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
        if rows:
            yield from flush(tuple(np.concatenate(x) for x in zip(*held)))

    return run

"""Column-wise ordering of aligned byte strings with their common prefixes.

The strings of a batch lie in columns; rounds go from the last column to the first, and
each inserts one symbol in front of every string.  The order of the suffixes that start at
a column follows from the order at the column to its right by one stable sort on the new
symbols, and the common prefix of two neighbours is one more than the least common prefix
between their old places, or nothing if their symbols differ.  The new symbols, read in the
old order, are the Burrows-Wheeler column of that round.  Columns are written once to a
file and read back in sequence, one a round; nothing else grows with the strings' length.
"""

from __future__ import annotations

import tempfile

import numpy as np

GAP = 256  # beyond a string's end; equal to no symbol, itself included


def repeated_windows(group: np.ndarray, texts: list[bytes], left: np.ndarray, width: int, reach: int) -> np.ndarray:
    """Which windows of ``width`` bytes occur in another string of the same group.

    ``group`` is sorted; string ``i`` starts ``left[i]`` columns before the anchor column.
    Returns hits[i, d]: the window that starts ``d`` columns before the anchor, 0 <= d < reach.
    """
    n = len(texts)
    hits = np.zeros((n, reach), bool)
    size = np.array([len(t) for t in texts])
    columns = reach - 1 + width
    with tempfile.TemporaryFile() as file:
        # row-major lines in, column-major file out, a few columns at a time
        grid = np.full((n, columns), GAP, np.uint16)
        for i, t in enumerate(texts):
            at = reach - 1 - left[i]
            grid[i, at : at + len(t)] = np.frombuffer(t, np.uint8)
        for c in range(columns - 1, -1, -1):
            file.write(np.ascontiguousarray(grid[:, c]).tobytes())
        del grid
        file.seek(0)
        order = np.arange(n)
        first = np.r_[True, group[1:] != group[:-1]]  # groups keep their places in every order
        block = np.cumsum(first)
        common = np.zeros(n, np.int32)
        starts = reach - 1 - left  # first column of each string
        ends = starts + size - width  # last column where a window starts
        for c in range(columns - 1, -1, -1):
            symbols = np.frombuffer(file.read(2 * n), np.uint16)[order]
            perm = np.argsort(block * 512 + symbols, kind="stable")
            u, v = perm[:-1], perm[1:]
            symbols = symbols[perm]
            same = np.r_[False, (symbols[1:] == symbols[:-1]) & (symbols[1:] != GAP) & (block[1:] == block[:-1])]
            new = np.zeros(n, np.int32)
            near = np.flatnonzero(same[1:] & (v == u + 1))
            new[near + 1] = common[v[near]] + 1
            apart = np.flatnonzero(same[1:] & (v != u + 1))
            if len(apart):
                apart = apart[np.argsort(u[apart], kind="stable")]
                lo, hi = u[apart] + 1, v[apart] + 1
                cut = np.empty(2 * len(apart), np.int64)
                cut[0::2], cut[1::2] = lo, np.minimum(hi, n - 1)
                least = np.minimum.reduceat(common, cut)[0::2]
                least = np.where(hi == n, np.minimum(least, common[n - 1]), least)
                new[apart + 1] = least + 1
            common, order = np.minimum(new, width), order[perm]
            if c < reach:
                full = common >= width
                full[:-1] |= full[1:]
                at = order[full]
                at = at[(starts[at] <= c) & (c <= ends[at])]
                hits[at, reach - 1 - c] = True
    return hits

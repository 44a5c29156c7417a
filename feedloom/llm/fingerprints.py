"""SimHash fingerprints of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 3
SEED = 42
BLOCK = 65536


def simhash(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64.

    Shingles keep repeats; fewer words than ``width`` make one shingle of all words; a text
    without words, or null, has fingerprint zero.  Memory is bounded for long texts: hashes
    are counted in blocks.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower touches A-Z only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    hash64, join = xxhash.xxh64_digest, b" ".join
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        end = min(at + BLOCK, n)
        cols = zip(*[words[at + i : end + i] for i in range(width)])
        raw = b"".join([hash64(join(w), seed) for w in cols])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x

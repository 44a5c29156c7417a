"""What the quality rules measure of one text: counts over words, lines and characters."""

from __future__ import annotations

import numpy as np

WINDOW = 5
BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
UPPER = bytes(range(65, 91))

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "max_word", "max_word_chars")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more.

    Windows are named exactly, by doubling: pairs get a number, then pairs of pairs, then
    the window of five; no hash decides equality.
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    have, last = 1, names
    while have < width:
        step = min(have, width - have)
        size = n - (have + step) + 1
        both = last[:size] * (int(last.max()) + 1) + last[step : step + size]
        values, last = np.unique(both, return_inverse=True)
        have += step
        if len(values) == len(last):
            return 0
    twice = np.flatnonzero(np.bincount(last)[last] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: str | None) -> tuple[int, ...]:
    """The FIELDS of one whole text; a null text has no words and no lines."""
    if not text:
        return (0,) * len(FIELDS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    longest = max(words, key=len, default=b"")
    seen: set[bytes] = set()
    lines = copies = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                copies += 1
            else:
                seen.add(line)
    return (
        len(words),
        len(text) - sum(raw.count(b) for b in BLANKS),
        sum(raw.count(b) for b in SYMBOLS),
        copies,
        repeated_words(words),
        len(raw) - len(raw.translate(None, UPPER)),
        lines,
        len(longest),
        len(longest.decode("utf-8", "surrogatepass")),
    )

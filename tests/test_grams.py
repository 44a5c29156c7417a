"""Grams in arrays against grams one by one."""

import time
from collections import Counter

import numpy as np

from feedloom.operators import grams as g

WIDE = "".join(chr(0x4E00 + i) for i in range(7000))  # more characters than fit one number a gram
TEXTS = ["", "ab", "abc", "abcd", "abcde", "aaaaaa", "wörd😀 a\0b\0\0", "\0\0\0\0", "abcabcabc"]


def longest(t, lo=3, hi=5):
    return [t[i : i + hi] for i in range(len(t) - lo + 1)]


def test_cut_as_one_by_one():
    for texts in (TEXTS, [*TEXTS, WIDE], ["a"], []):
        grams, which, doc = g.cut(texts, 3, 5)
        names = g.spell(grams)
        assert len(set(names)) == len(names)
        assert [(int(d), names[w]) for d, w in zip(doc, which)] == [(i, x) for i, t in enumerate(texts) for x in longest(t)]


def test_weights_of_every_length():
    known = ["abc", "abcd", "bcd", "😀 a", "\0b\0", "zzzzz"]
    weights = g.Weights(known, np.array([[i + 1.0, np.nan] for i in range(len(known))]), 5)
    grams, which, doc = g.cut(TEXTS, 3, 5)
    each = weights.sums(weights.find(grams)[2:])
    got = np.bincount(doc, each[which, 0], len(TEXTS)).tolist()
    assert got == [sum(known.index(x) + 1 for p in longest(t) for x in {p[:n] for n in (3, 4, 5)} if x in known) for t in TEXTS]
    assert not each[:, 1].any()


def test_a_million_characters_in_little_time():
    """Cut one by one in the JVM they took tens of seconds of a core."""
    text = " ".join(f"w{i * 7919 % 5003}" for i in range(170_000))
    at = time.time()
    grams, which, _ = g.cut([text], 3, 5)
    names = g.spell(grams)
    assert time.time() - at < 10
    assert Counter(dict(zip(names, np.bincount(which).tolist()))) == Counter(longest(text))

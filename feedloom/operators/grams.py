"""Grams of characters, counted and weighed many texts at once in arrays.

A text stands as its code points plus one, so that zero is no character.  The longest gram at a
place is cut, ``hi`` characters or what the text has left, ``lo`` at least; what it begins with
are the shorter ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

PIECE = 500_000  # characters that are cut at once, or one text
POINT = 21  # bits of a code point


def _points(texts: Sequence[str], gap: int) -> np.ndarray:
    """The texts one after another, each before ``gap`` zeros."""
    ends = np.cumsum([len(t) + gap for t in texts], dtype=np.int64)
    out = np.frombuffer("".join(t + "\0" * gap for t in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64) + 1
    for g in range(1, gap + 1):
        out[ends - g] = 0
    return out


def cut(texts: Sequence[str], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct longest grams, a row of ``hi`` points each; which one stands at a place; the text of the place)."""
    points = _points(texts, hi)
    real = points > 0
    starts = real[: len(points) - hi].copy()
    for j in range(1, lo):
        starts &= real[j : len(points) - hi + j]
    at = np.flatnonzero(starts)
    doc = np.repeat(np.arange(len(texts)), [max(len(t) - lo + 1, 0) for t in texts])
    used, small = np.unique(points, return_inverse=True)  # zero is among them
    if len(used) ** hi >= 2**63:  # too many characters for one number a gram
        grams, which = np.unique(points[at[:, None] + np.arange(hi)], axis=0, return_inverse=True)
        return grams, which.reshape(-1), doc
    number = np.zeros(len(at), dtype=np.int64)
    for j in range(hi):
        number = number * len(used) + small[at + j]
    number, which = np.unique(number, return_inverse=True)
    grams = np.empty((len(number), hi), dtype=np.int64)
    for j in reversed(range(hi)):
        number, rest = np.divmod(number, len(used))
        grams[:, j] = used[rest]
    return grams, which, doc


def spell(grams: np.ndarray) -> list[str]:
    if (grams == 1).any():  # U+0000, which an array of strings takes for padding
        return ["".join(chr(p - 1) for p in row if p) for row in grams.tolist()]
    rows = np.ascontiguousarray(np.where(grams > 0, grams - 1, 0).astype(np.uint32))
    return rows.view(f"<U{grams.shape[1]}").reshape(-1).tolist() if len(rows) else []


def _pieces(batch: pa.RecordBatch, text: str, by: Sequence[str]) -> Iterator[tuple[tuple, list[int], list[str]]]:
    """Rows with a text by their values of ``by``, about PIECE characters at once."""
    groups: dict[tuple, list[int]] = {}
    texts = batch.column(text).to_pylist()
    values = zip(*[batch.column(c).to_pylist() for c in by]) if by else (() for _ in texts)
    for i, (t, v) in enumerate(zip(texts, values)):
        if t is not None:
            groups.setdefault(v, []).append(i)
    for v, rows in groups.items():
        own, size = [], 0
        for i in rows:
            own.append(i)
            size += len(texts[i])
            if size >= PIECE:
                yield v, own, [texts[j] for j in own]
                own, size = [], 0
        if own:
            yield v, own, [texts[j] for j in own]


Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def counting(keys: Sequence[str], text: str, lo: int, hi: int) -> Pass:
    """Rows to ``keys``, ``gram`` (a longest one) and its occurrences ``k`` among some of the rows."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, _, texts in _pieces(batch, text, keys):
                grams, which, _ = cut(texts, lo, hi)
                own = [pa.array([v], batch.schema.field(c).type).take(pa.array(np.zeros(len(grams), dtype=np.int64))) for c, v in zip(keys, values)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(spell(grams), pa.string()), pa.array(np.bincount(which, minlength=len(grams)), pa.int64())], [*keys, "gram", "k"])

    return run


class Weights:
    """Grams with a weight a class, found level by level: a gram's number is its beginning's and one more character."""

    def __init__(self, grams: Sequence[str], weights: np.ndarray, hi: int):
        self._rows = np.vstack([np.nan_to_num(weights), np.zeros((1, weights.shape[1]))])  # the last one: none
        self._levels = []
        points = _points(grams, hi)
        first = np.concatenate([[0], np.cumsum([len(g) + hi for g in grams], dtype=np.int64)])[:-1].astype(np.int64)
        size = np.array([len(g) for g in grams], dtype=np.int64)
        number = np.zeros(len(grams), dtype=np.int64)
        for j in range(hi):
            long = size > j
            key = number << POINT | points[first + j] if len(grams) else number
            known = np.unique(key[long])
            number[long] = np.searchsorted(known, key[long])
            row = np.full(len(known), -1, dtype=np.int64)
            row[number[size == j + 1]] = np.flatnonzero(size == j + 1)
            self._levels.append((known, row))

    def find(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each length, the row of the gram's beginning of that length; -1 for none."""
        number, alive, found = np.zeros(len(grams), dtype=np.int64), np.ones(len(grams), dtype=bool), []
        for j, (known, row) in enumerate(self._levels):
            if not len(known):
                found.append(np.full(len(grams), -1, dtype=np.int64))
                alive = np.zeros(len(grams), dtype=bool)
                continue
            key = number << POINT | grams[:, j]
            number = np.minimum(np.searchsorted(known, key), len(known) - 1)
            alive = alive & (known[number] == key)
            found.append(np.where(alive, row[number], -1))
        return found

    def sums(self, found: Sequence[np.ndarray]) -> np.ndarray:
        return sum(self._rows[f] for f in found)


def weighing(keys: Sequence[str], by: Sequence[str], text: str, model, classes: int, lo: int, hi: int) -> Pass:
    """Rows to ``keys`` and ``_w0``...: what the grams of a row in ``model`` (a broadcast of Weights by ``by``) weigh for each class."""
    keys, by, names = list(keys), list(by), [f"_w{i}" for i in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, rows, texts in _pieces(batch, text, by):
                grams, which, doc = cut(texts, lo, hi)
                weights = model.value.get(values)
                each = np.zeros((len(grams), classes)) if weights is None else weights.sums(weights.find(grams)[lo - 1 :])
                own = [batch.column(c).take(pa.array(rows)) for c in keys]
                sums = [pa.array(np.bincount(doc, each[which, i], len(texts)).astype(float), pa.float64()) for i in range(classes)]
                yield pa.RecordBatch.from_arrays([*own, *sums], [*keys, *names])

    return run


def missing(keys: Sequence[str], by: Sequence[str], text: str, model, lo: int, hi: int) -> Pass:
    """Rows to ``keys``, ``gram`` and its occurrences ``k``: the grams of a row, of any length, that ``model`` does not have."""
    keys, by = list(keys), list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, rows, texts in _pieces(batch, text, by):
                grams, which, doc = cut(texts, lo, hi)
                weights = model.value.get(values)
                found = [np.full(len(grams), -1)] * hi if weights is None else weights.find(grams)
                for n in range(lo, hi + 1):
                    lost = (found[n - 1] < 0) & (grams[:, n - 1] > 0)
                    at = np.flatnonzero(lost[which])
                    pair, k = np.unique(doc[at] * len(grams) + which[at], return_counts=True)
                    if len(pair):
                        row, gram = np.divmod(pair, len(grams))
                        own = [batch.column(c).take(pa.array(np.asarray(rows)[row])) for c in keys]
                        yield pa.RecordBatch.from_arrays([*own, pa.array(spell(grams[gram, :n]), pa.string()), pa.array(k, pa.int64())], [*keys, "gram", "k"])

    return run

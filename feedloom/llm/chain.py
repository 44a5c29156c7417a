"""A two-state linear-chain conditional random field over words: clean or offending."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

SLOTS = 1 << 18
PREFIXES = (5, 6, 7, 8)
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
WORD = re.compile(r"\S+")
CACHE_WORDS = 800_000
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 3, 0.02, 12.0  # of a feature that marks offending words


def features(word: str) -> list[str]:
    """The word itself and its beginnings, lower case and without marks at its ends."""
    w = word.lower().strip(EDGE)
    return [f"w={w}"] + [f"p={w[:n]}" for n in PREFIXES if len(w) >= n]


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % SLOTS for f in features(word)]


def forward_backward(odds: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    """Marginals of the offending state for each sequence.

    ``odds`` are emission odds, ``step[a, b]`` the transition weights.  With two states a
    message is one ratio, and a step maps it by a fraction of linear terms; sequences are
    walked side by side, the longest first.
    """
    if not odds:
        return []
    order = sorted(range(len(odds)), key=lambda i: -len(odds[i]))
    sizes = np.array([len(odds[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.concatenate([odds[i] for i in order]) if sizes.sum() else np.zeros(0)
    ahead, back = np.ones_like(flat), np.ones_like(flat)
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    (oo, ot), (to, tt) = step
    r = np.zeros(len(order))
    for t, n in enumerate(live):
        at = starts[:n] + t
        r = r[:n]
        r = flat[at] if t == 0 else flat[at] * (ot + r * tt) / (oo + r * to)
        ahead[at] = r
    b = np.ones(len(order))
    for t in range(len(live) - 2, -1, -1):
        n = live[t + 1]
        at = starts[:n] + t
        x = flat[at + 1] * b[:n]
        b[:n] = (to + tt * x) / (oo + ot * x)
        back[at] = b[:n]
    post = ahead * back
    post /= 1 + post
    out: list[np.ndarray] = [flat] * len(order)
    for i, s, n in zip(order, starts, sizes):
        out[i] = post[s : s + n]
    return out


def label_tokens(texts: list[list[str]], toxic: list[int]) -> list[np.ndarray]:
    """Word labels: in an offending text, words with a feature that marks such texts.

    A feature marks if it stands in enough different offending texts and is much more
    frequent there than in clean ones.
    """
    n = [max(1, toxic.count(0)), max(1, toxic.count(1))]
    seen = [Counter(), Counter()]
    for words, y in zip(texts, toxic):
        seen[y].update({f for w in set(words) for f in features(w)})
    least = max(LEAST_DOCS, LEAST_SHARE * n[1])
    marks = {f for f, k in seen[1].items() if k >= least and k / n[1] > LEAST_RATIO * (seen[0][f] + 0.5) / n[0]}
    held: dict[str, bool] = {}

    def hit(w: str) -> bool:
        if w not in held:
            held[w] = any(f in marks for f in features(w))
        return held[w]

    return [np.array([y and hit(w) for w in words], dtype=np.int64) for words, y in zip(texts, toxic)]


def apart(texts: list[str], toxic: list[int]) -> list[int]:
    """Which texts to learn from: of copies and near copies (by least word hashes) the first."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        hashes = {zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in t.split()}
        key = (toxic[i], tuple(sorted(hashes)[:2]))
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


@dataclass
class Chain:
    """Emission weights by hashed feature, transitions, and the fit of the document score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.float32))
    step: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    bias: float = 0.0
    score: np.ndarray | None = None

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def _learn(self, words: list[str]) -> None:
        """Emission odds of new words, all at once."""
        found = [slots(w) for w in words]
        flat = np.fromiter((f for x in found for f in x), np.int64)
        heads = np.cumsum([0] + [len(x) for x in found[:-1]])
        total = np.add.reduceat(self.weights[flat].astype(np.float64), heads)
        self.known.update(zip(words, np.exp(np.clip(self.bias + total, -30, 30)).tolist()))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        known, every = self.known, set().union(*texts)
        if len(known) + len(every) > CACHE_WORDS:
            known.clear()
        new = [w for w in every if w not in known]
        if new:
            self._learn(new)
        return forward_backward([np.array([known[w] for w in t]) for t in texts], self.step)

    @staticmethod
    def summary(p: np.ndarray) -> tuple[float, float, float]:
        """What the document score sees of its words' marginals."""
        total = float(p[p >= 0.5].sum())  # faint doubts of a long text do not add up
        return (1.0, np.log1p(total), float(p.max()) if len(p) else 0.0)

    def rate(self, p: np.ndarray) -> float:
        if self.score is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.score @ np.array(self.summary(p)), -30, 30))))


def fit(texts: list[str], toxic: list[int], rounds: int = 30, rate: float = 0.5, decay: float = 1e-4, piece: int = 64) -> Chain:
    """Maximum likelihood by AdaGrad on every second text; the others fit the document score."""
    chain = Chain()
    use = apart(texts, toxic)
    texts, toxic = [texts[i] for i in use], [toxic[i] for i in use]
    if len(set(toxic)) < 2:
        return chain
    words = [t.split() for t in texts]
    labels = label_tokens(words, toxic)
    by_class = [[i for i, y in enumerate(toxic) if y == c] for c in (0, 1)]
    first = [i for c in by_class for i in c[::2]]
    other = [i for c in by_class for i in c[1::2]] or first
    # sequences of at most ``piece`` words, as flat feature and label arrays
    cuts = [(i, a) for i in first for a in range(0, len(words[i]), piece)]
    seqs = [words[i][a : a + piece] for i, a in cuts]
    gold = [labels[i][a : a + piece] for i, a in cuts]
    table: dict[str, list[int]] = {}
    rows = [table.setdefault(w, slots(w)) for s in seqs for w in s]
    of_token = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], dtype=np.int64)
    y = np.concatenate(gold).astype(float)
    sizes = [len(s) for s in seqs]
    ends = np.cumsum(sizes)
    inner = np.ones(len(y), bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    want = np.zeros((2, 2))
    np.add.at(want, (y[at].astype(int), y[at + 1].astype(int)), 1)
    want = (want + 1) / (want + 1).sum(1, keepdims=True)
    chain.step = want  # transition odds by counting; emissions carry the rest
    w, b = np.zeros(SLOTS), 0.0
    seen_w, seen_b = np.full(SLOTS, 1e-6), 1e-6
    weight = np.where(y > 0, min(20.0, max(1.0, (y == 0).sum() / max(1, y.sum()) / 20)), 1.0)
    for _ in range(rounds):
        e = np.exp(np.clip(b + np.bincount(of_token, w[feature], len(y)), -30, 30))
        p = np.concatenate(forward_backward(np.split(e, ends[:-1]), chain.step))
        g = (y - p) * weight
        gw = np.bincount(feature, g[of_token], SLOTS) - decay * w * len(y) / 100
        gb = g.sum()
        seen_w, seen_b = seen_w + gw * gw, seen_b + gb * gb
        w, b = w + rate * gw / np.sqrt(seen_w), b + rate * gb / np.sqrt(seen_b)
    chain.weights, chain.bias = w.astype(np.float32), float(b)
    x = np.array([chain.summary(p) for p in chain.marginals([words[i] for i in other])])
    t = np.array([toxic[i] for i in other], float)
    balance = np.where(t > 0, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9))
    s = np.zeros(x.shape[1])
    for _ in range(500):  # balanced logistic regression, a little drawn to zero
        q = 1 / (1 + np.exp(-np.clip(x @ s, -30, 30)))
        s += 2.0 * (x.T @ ((t - q) * balance) / len(t) - 1e-4 * s)
    chain.score = s
    return chain

"""A context-mixing range coder for token ids, many blocks side by side.

A block is coded alone: models start afresh, and its ids carry a checksum.  Three models
propose an id: order 2 and order 1 the one last seen after the same two ids or one id,
order 0 one of SLOTS recent ids, whatever came before.  How far to trust them is learnt:
each order keeps adaptive distributions over what happens (order 2 right, order 1 right,
among the recent, none) by its own confidence, and the three distributions are mixed with
weights that move to whoever gave the outcome more.  The mixed distribution drives a range
coder; a recent id is then coded by its slot, another by its 16 bits.

Blocks are lanes of the same arrays: one step codes one id of every block.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
TABLE = 1024  # contexts of order 1 and of order 2 kept in a block
SLOT_BITS = 9
PREC = 12
RATE = 4

U64 = np.uint64
_TOP, _LOW = U64(1) << U64(48), U64(1) << U64(32)
_ID = U64(16)
_BITS = np.array([0, 0, SLOT_BITS, 16], U64)

# A distribution over the four outcomes is its three inner bounds, 12 bits each, in fields of
# 20 bits of one word: a weighted sum of words with weights that add up to 256 mixes all
# bounds at once.
_FIELDS = sum(0xFFF << s for s in (0, 20, 40))
_FALL = sum(0xFF << s for s in (0, 20, 40))
_BELOW = np.array([60, 0, 20, 40])  # shift to the bound below an outcome (nothing is at 60)
_ABOVE = np.array([0, 20, 40, 60])
_REST = np.array([0, 0, 0, 1 << PREC])


def _word(b1: int, b2: int, b3: int) -> int:
    return b1 | b2 << 20 | b3 << 40


# Where an outcome draws the bounds, over 2 ** RATE; each outcome keeps some room.
_DRAW = np.array([_word(253, 254, 255), _word(1, 254, 255), _word(1, 2, 255), _word(1, 2, 3)])
# Where the weights of order 2 and order 1 move to if order 0, 1 or 2 gave the outcome most.
_PULL2, _PULL1 = np.array([24, 24, 208]), np.array([24, 208, 24])


class Models:
    """The state of all lanes; ``predict`` and ``learn`` alternate, in coder and decoder alike."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.seen1, self.seen2 = np.zeros(lanes * TABLE, np.int32), np.zeros(lanes * TABLE, np.int32)  # trust and id
        self.recent = np.zeros(lanes << SLOT_BITS, np.uint16)
        self.bounds = [np.full(lanes * 4, _word(512, 1024, 2048)) for _ in range(3)]
        self.weight2, self.weight1 = np.full(lanes, 85), np.full(lanes, 85)
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.last = np.zeros(lanes, np.int64)

    def shrink(self, n: int) -> None:
        """Only the first ``n`` lanes go on."""
        if n < len(self.lane):
            for name in ("lane", "one", "two", "last", "weight1", "weight2"):
                setattr(self, name, getattr(self, name)[:n])

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of order 2 and order 1, and the word of the mixed distribution."""
        base, mine = self.lane * TABLE, self.one * 40503
        self.at1 = base + (mine >> 4 & TABLE - 1)
        self.at2 = base + (self.two * 27191 + mine >> 5 & TABLE - 1)
        self.was1, self.was2 = self.seen1.take(self.at1), self.seen2.take(self.at2)
        four = self.lane * 4
        self.rows = (four + self.last, four + (self.was1 >> 16), four + (self.was2 >> 16))
        self.parts = [b.take(r) for b, r in zip(self.bounds, self.rows)]
        w2, w1 = self.weight2, self.weight1
        p0, p1, p2 = self.parts
        mixed = p0 * (256 - w1 - w2) + p1 * w1 + p2 * w2 >> 8 & _FIELDS
        return self.was2 & 0xFFFF, self.was1 & 0xFFFF, mixed

    @staticmethod
    def slot(ids: np.ndarray) -> np.ndarray:
        return ids * 40503 >> 3 & (1 << SLOT_BITS) - 1

    def learn(self, outcome: np.ndarray, ids: np.ndarray, guess2: np.ndarray, guess1: np.ndarray) -> None:
        below, above, draw = _BELOW.take(outcome), _ABOVE.take(outcome), _DRAW.take(outcome)
        c0, c1, c2 = ((p >> above & 0xFFF) - (p >> below & 0xFFF) for p in self.parts)
        best = np.where(c2 >= np.maximum(c0, c1), 2, (c1 >= c0) * 1)
        self.weight2 = self.weight2 + (_PULL2.take(best) - self.weight2 >> 4)
        self.weight1 = self.weight1 + (_PULL1.take(best) - self.weight1 >> 4)
        for b, r, p in zip(self.bounds, self.rows, self.parts):
            b[r] = p - (p >> RATE & _FALL) + draw
        step = 1 << 16
        self.seen2[self.at2] = np.where(guess2 == ids, np.minimum((self.was2 & ~0xFFFF) + step, 3 * step), 0) | ids
        self.seen1[self.at1] = np.where(guess1 == ids, np.minimum((self.was1 & ~0xFFFF) + step, 3 * step), 0) | ids
        self.recent[(self.lane << SLOT_BITS) + self.slot(ids)] = ids
        self.last = outcome
        self.two, self.one = self.one, ids


class _Words:
    """Output of all lanes: 16-bit words, as many as each needs."""

    def __init__(self, lanes: int, most: int):
        self.words = np.zeros((lanes, most), np.uint16)
        self.n = np.zeros(lanes, np.int64)


def _ends(mixed, outcome):
    """The part of 2 ** PREC that the outcome has in the mixed distribution."""
    lo = mixed >> _BELOW.take(outcome) & 0xFFF
    hi = (mixed >> _ABOVE.take(outcome) & 0xFFF) + _REST.take(outcome)
    return lo.view(U64), hi.view(U64)


def _narrow(low, span, lo, hi, extra, bits):
    """Part [lo, hi) of 2 ** PREC, then value ``extra`` of 2 ** ``bits``."""
    r = span >> U64(PREC)
    low = low + r * lo
    span = r * (hi - lo)
    r = span >> bits
    return low + r * extra, r


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The payload of each block of uint16 ids."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((int(sizes[0]), len(blocks)), np.int64)
    for lane, i in enumerate(order):
        ids[: len(blocks[i]), lane] = blocks[i]
    model, out = Models(len(blocks)), _Words(len(blocks), int(sizes[0]) * 3 // 2 + 16)
    low, span = np.zeros(len(blocks), U64), np.full(len(blocks), ~U64(0))
    for t, n in enumerate(np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")):
        model.shrink(n)
        x = ids[t, :n]
        guess2, guess1, mixed = model.predict()
        slot = model.slot(x)
        known = model.recent.take((model.lane << SLOT_BITS) + slot) == x
        outcome = np.where(guess2 == x, 0, np.where(guess1 == x, 1, np.where(known, 2, 3)))
        extra = np.where(outcome == 3, x, np.where(outcome == 2, slot, 0)).view(U64)
        lo, sp = _narrow(low[:n], span[:n], *_ends(mixed, outcome), extra, _BITS.take(outcome))
        while True:
            short = sp < _LOW
            ready = np.flatnonzero(((lo ^ (lo + sp)) < _TOP) | short)
            if not len(ready):
                break
            cut = ready[short[ready] & ((lo[ready] ^ (lo[ready] + sp[ready])) >= _TOP)]
            sp[cut] = (U64(0) - lo[cut]) & (_LOW - U64(1))
            out.words[ready, out.n[ready]] = lo[ready] >> U64(48)
            out.n[ready] += 1
            lo[ready] <<= _ID
            sp[ready] <<= _ID
        low[:n], span[:n] = lo, sp
        model.learn(outcome, x, guess2, guess1)
    made: list[bytes] = [b""] * len(blocks)
    for lane, i in enumerate(order):
        tail = [(int(low[lane]) >> s) & 0xFFFF for s in (48, 32, 16, 0)]
        made[i] = out.words[lane, : out.n[lane]].astype("<u2").tobytes() + np.array(tail, "<u2").tobytes()
    return made


def decode(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block, as many as ``lengths`` says."""
    if not payloads:
        return []
    order = sorted(range(len(payloads)), key=lambda i: -lengths[i])
    sizes = np.array([lengths[i] for i in order])
    raw = np.zeros((len(order), max(len(p) for p in payloads) // 2 + 8), np.uint16)
    for lane, i in enumerate(order):
        raw[lane, : len(payloads[i]) // 2] = np.frombuffer(payloads[i], "<u2")
    lanes = np.arange(len(order))
    code = np.zeros(len(order), U64)
    for k in range(4):
        code = (code << _ID) | raw[:, k].astype(U64)
    at = np.full(len(order), 4)
    model = Models(len(order))
    low, span = np.zeros(len(order), U64), np.full(len(order), ~U64(0))
    ids = np.zeros((int(sizes[0]), len(order)), np.uint16)
    for t, n in enumerate(np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")):
        model.shrink(n)
        guess2, guess1, mixed = model.predict()
        lo, sp, cd = low[:n].copy(), span[:n].copy(), code[:n].copy()
        seen = np.minimum((cd - lo) // (sp >> U64(PREC)), U64(4095)).view(np.int64)
        outcome = (seen >= (mixed & 0xFFF)) * 1 + (seen >= (mixed >> 20 & 0xFFF)) + (seen >= (mixed >> 40))
        lo, sp = _narrow(lo, sp, *_ends(mixed, outcome), U64(0), _BITS.take(outcome))
        extra = (cd - lo) // sp
        lo = lo + sp * extra
        extra = extra.view(np.int64)
        slot_id = model.recent.take((model.lane << SLOT_BITS) + (extra & (1 << SLOT_BITS) - 1))
        x = np.where(outcome == 3, extra & 0xFFFF, np.where(outcome == 2, slot_id, np.where(outcome == 1, guess1, guess2)))
        while True:
            short = sp < _LOW
            ready = np.flatnonzero(((lo ^ (lo + sp)) < _TOP) | short)
            if not len(ready):
                break
            cut = ready[short[ready] & ((lo[ready] ^ (lo[ready] + sp[ready])) >= _TOP)]
            sp[cut] = (U64(0) - lo[cut]) & (_LOW - U64(1))
            cd[ready] = (cd[ready] << _ID) | raw[ready, at[ready]].astype(U64)
            at[ready] += 1
            lo[ready] <<= _ID
            sp[ready] <<= _ID
        low[:n], span[:n], code[:n] = lo, sp, cd
        ids[t, :n] = x
        model.learn(outcome, x, guess2, guess1)
    out: list[np.ndarray] = [ids[:0, 0]] * len(payloads)
    for lane, i in zip(lanes, order):
        out[i] = ids[: lengths[i], lane].copy()
    return out


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u2").tobytes())

"""Updates that are left out for silent rows would not have changed anything."""

import random
from types import SimpleNamespace

import pandas as pd

from feedloom.streaming import fold, memory
from feedloom.streaming.rulebook import CLASSES, Verdict

HUSHED, SAID = ("nothing", "already-notified:near", "off:say_destination", "already-notified:line"), ("launch:destination", "launch:confirmed", "near:new")


def some(rng):
    one = lambda *xs: rng.choice(xs)
    cls = one(None, *CLASSES)
    v = SimpleNamespace(
        ts_s=rng.randrange(10_000), state=one(None, "alert", "clear"), official=one(True, False), cls=cls, eff=cls or one(None, *CLASSES),
        live=one(True, False), recheck=one(True, False), reappeared=one(True, False), after_recheck=one(True, False), says_new=one(True, False),
        says_launch=one(True, False), partial=one(True, False), cleared=one(None, *CLASSES), scope=one(0, 1, 2, 3, 4, 9), certainty=one("confirmed", "lost"),
        behaviour=one("drone", "launch", "approach", None), own_tone="drone", count=rng.randrange(5), kinds=one((), ("x",)), places=one([], ["p"]),
        at_home=one(True, False), ring_memory_s=600, silent_dedup_s=60)
    level = one(None, None, "info", "alert")
    return v, Verdict(level, None if level is None else one("none", "alert", "clear", "drone"), one(*(HUSHED if level is None else SAID)))


def test_as_if_all_were_made():
    rng, e, r = random.Random(3), memory.fresh_episode(0), memory.RECIPIENT_FIRST
    for _ in range(20_000):
        v, d = some(rng)
        for fields, before in ((memory.EPISODE, e), (memory.RECIPIENT, r)):
            assert memory.updated(fields, before, v, d) == before | {k: new(before, v, d) for k, (_, new) in fields.items()}
        e, r = memory.updated(memory.EPISODE, e, v, d), memory.updated(memory.RECIPIENT, r, v, d)


def test_silent_rows_make_fewer():
    made = {k: len(x) for k, x in memory._may_change(memory.EPISODE).items()}
    assert made[True, True] == len(memory.EPISODE) and made[False, False] == len(memory.EPISODE) - 14


def test_rows_are_plain_values():
    """As ``to_dict`` gives them, a column at a time."""
    pdf = pd.DataFrame({"k": ["a", "a", "b"], "n": [1, 2, 3], "x": [0.5, None, 2.0], "o": [True, None, False], "p": [["q"], [], None]}, index=[5, 6, 7])
    rows = []
    out = list(fold.walk(iter([pdf]), ["k"], lambda s, r: rows.append(r) or {"y": len(rows)}, ["k", "n"], lambda r: {}))[0]
    assert repr(rows) == repr(pdf.to_dict("records")) and [type(r["n"]) for r in rows] == [int] * 3
    assert out["y"].tolist() == [1, 2, 3] and out.index.tolist() == [5, 6, 7]


def test_a_row_makes_what_its_facts_call_for():
    """Before, a silent row of no threat made half of all updates."""
    none = memory._Updates(memory.EPISODE)[0]
    assert [k for k, _ in none] == ["peak"] and set(memory.WHEN) <= memory.EPISODE.keys() | memory.RECIPIENT.keys()

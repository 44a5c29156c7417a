"""What a recipient's fold remembers: one declared update per field.

An update reads the state before the row (``b``), the view of the row (``v``) and its
verdict (``d``), and returns the field's new value; no update sees another's result.
"""

from __future__ import annotations

import json

from .rulebook import CITY, CLASSES, FAR, NOWHERE, OBLAST, RING, RUNG, Verdict

UNPLACED_S = 120  # a launch nobody has placed cannot have arrived sooner


def line_key(v, code: str) -> str:
    return "|".join([code, v.eff or "", ",".join(sorted(v.places)), str(v.scope)])


def _with(xs: list, *more) -> list:
    return sorted({*xs, *(x for x in more if x)})


def _declares(v, d) -> bool:
    return v.state == "alert" and (v.official or d.tone == "alert")


def _names(v, d) -> bool:
    """The row says a class that is in the air, and the rules had use for it."""
    return bool(v.cls and v.live and d.code != "nothing")


def _rechecks(v, d) -> bool:
    return bool(v.recheck and d.level)


def _air(b, v, d):
    air = b["air"]
    if _declares(v, d) and not b["announced"]:
        air = _with(air, "drone", b["cls"])
    air = [c for c in air if c != v.cleared]
    flying = (b["announced"] or _declares(v, d)) and v.live and not v.partial
    return _with(air, v.eff) if flying else air


def _recheck_at(b, v, d):
    if _rechecks(v, d):
        waiting = b["unplaced_at"] is not None and v.ts_s - b["unplaced_at"] < UNPLACED_S
        return b["recheck_at"] if waiting else v.ts_s
    return None if d.level == RING and v.after_recheck else b["recheck_at"]


def _unplaced_at(b, v, d):
    launch = v.behaviour == "launch"
    if launch and d.level == RING and d.tone == v.own_tone:
        return v.ts_s if v.scope in (FAR, NOWHERE) else None
    return None if launch and v.live and v.scope not in (FAR, NOWHERE) else b["unplaced_at"]


def _rechecked(b, v, d):
    if _rechecks(v, d):
        return _with(b["rechecked"], v.eff or "all")
    spoken = d.level and v.live and v.eff
    return [] if spoken or (v.reappeared and v.scope != FAR) else b["rechecked"]


def _launched(b, v, d):
    counts = d.level == RING and v.eff and (d.code == "launch:confirmed" or (v.says_launch and v.certainty == "confirmed"))
    return _with(b["launched"], v.eff) if counts else b["launched"]


# field: (value in a fresh episode, update)
EPISODE = {
    "live_at": (None, lambda b, v, d: v.ts_s if v.live or v.state == "alert" else b["live_at"]),
    "cls": (None, lambda b, v, d: v.eff if _names(v, d) else b["cls"]),
    "cls_at": (None, lambda b, v, d: v.ts_s if _names(v, d) else b["cls_at"]),
    "sent": (0, lambda b, v, d: b["sent"] + (d.level is not None)),
    "rang": (None, lambda b, v, d: v.ts_s if d.level == RING and not v.official else b["rang"]),
    "tones": ([], lambda b, v, d: _with(b["tones"], d.tone) if d.level == RING else b["tones"]),
    "peak": (0, lambda b, v, d: v.count if d.level else max(b["peak"], v.count)),
    "air": ([], _air),
    "cleared": ([], lambda b, v, d: [c for c in _with(b["cleared"], v.cleared) if not (_names(v, d) and c == v.eff)]),
    "rechecked": ([], _rechecked),
    "recheck_at": (None, _recheck_at),
    "recheck_of": ({}, lambda b, v, d: b["recheck_of"] | {v.eff or "all": v.ts_s} if _rechecks(v, d) else b["recheck_of"]),
    "lifted_of": ({}, lambda b, v, d: b["lifted_of"] | {v.cleared: v.ts_s} if v.cleared else b["lifted_of"]),
    "launched": ([], _launched),
    "launch_at": (None, lambda b, v, d: v.ts_s if v.says_new else b["launch_at"]),
    "unplaced_at": (None, _unplaced_at),
    "located": (False, lambda b, v, d: False if _rechecks(v, d) else b["located"] or d.code == "launch:destination"),
    "announced": (False, lambda b, v, d: b["announced"] or _declares(v, d)),
    "official": (False, lambda b, v, d: b["official"] or bool(_declares(v, d) and v.official)),
    "scope_known": (False, lambda b, v, d: b["scope_known"] or bool(_declares(v, d) and (v.official or v.scope <= CITY))),
    "alert_at": (None, lambda b, v, d: v.ts_s if _declares(v, d) and not b["announced"] else b["alert_at"]),
    "explained": (False, lambda b, v, d: b["explained"] or bool(d.level and not v.official and v.eff and v.scope <= OBLAST)),
    "rung": (0, lambda b, v, d: max(b["rung"], RUNG.get(v.scope, 0)) if d.level == RING and v.behaviour == "approach" else b["rung"]),
    "kinds": ([], lambda b, v, d: _with(b["kinds"], *v.kinds) if v.live and v.kinds else b["kinds"]),
    # the two memories by place and line forget what no rule can ask for any more
    "seen": ({}, lambda b, v, d: _recent(b["seen"], v.places, v.ts_s, v.ring_memory_s) if v.live and not d.code.startswith("already-notified") else b["seen"]),
    "lines": ({}, lambda b, v, d: _recent(b["lines"], [line_key(v, d.code)], v.ts_s, v.silent_dedup_s) if d.level == "info" else b["lines"]),
}
RECIPIENT = {
    "said_clear": (False, lambda b, v, d: d.tone == "clear" or (b["said_clear"] and not (v.official and v.state == "alert"))),
    "home_said": (None, lambda b, v, d: v.ts_s if d.level == RING and v.at_home else b["home_said"]),
    "home_rang": (None, lambda b, v, d: v.ts_s if d.level == RING and v.at_home and d.tone == CLASSES["ballistic"][1] else b["home_rang"]),
}


# Fields that stay as they are unless the row says something, and unless it is a declaration.
SPOKEN = {"sent", "rang", "tones", "recheck_at", "recheck_of", "launched", "located", "explained", "rung", "lines"}
DECLARED = {"announced", "official", "scope_known", "alert_at"}


def _recent(held: dict, names, now: int, keep_s: int) -> dict:
    if not names:
        return held
    return {k: t for k, t in held.items() if now - t <= keep_s} | dict.fromkeys(names, now)


def fresh(fields: dict) -> dict:
    return {k: first for k, (first, _) in fields.items()}


RECIPIENT_FIRST = fresh(RECIPIENT)


def fresh_episode(ts: int) -> dict:
    return fresh(EPISODE) | {"opened": ts, "live_at": ts}


def _may_change(fields: dict) -> dict[tuple[bool, bool], list]:
    """(field, update) by whether the row says something and whether it may be a declaration."""
    return {(said, alert): [(k, new) for k, (_, new) in fields.items() if (said or k not in SPOKEN) and (alert or k not in DECLARED)]
            for said in (False, True) for alert in (False, True)}


# What has to hold of a row for a field to change, any of these; a field that is not here may change with every row.
SAID, RANG, ALERT, LIVE, NAMED, LIFTED, BACK, NEW, LAUNCH = (1 << i for i in range(9))
WHEN = {
    "live_at": LIVE | ALERT, "cls": NAMED, "cls_at": NAMED, "sent": SAID, "rang": RANG, "tones": RANG, "air": ALERT | LIVE | LIFTED,
    "cleared": LIFTED | NAMED, "rechecked": SAID | BACK, "recheck_at": SAID, "recheck_of": SAID, "lifted_of": LIFTED, "launched": RANG,
    "launch_at": NEW, "unplaced_at": LAUNCH, "located": SAID, "announced": ALERT, "official": ALERT, "scope_known": ALERT, "alert_at": ALERT,
    "explained": SAID, "rung": RANG, "kinds": LIVE, "seen": LIVE, "lines": SAID,
    "said_clear": SAID | ALERT, "home_said": RANG, "home_rang": RANG,
}


def facts(v, d: Verdict) -> int:
    held = 0 if d.level is None else SAID | RANG if d.level == RING else SAID
    if v.live:
        held |= LIVE | NAMED if v.cls else LIVE
    if v.state == "alert":
        held |= ALERT
    if v.cleared:
        held |= LIFTED
    if v.reappeared:
        held |= BACK
    if v.says_new:
        held |= NEW
    return held | LAUNCH if v.behaviour == "launch" else held


class _Updates(dict):
    """(field, update) of those that may change, by the facts of a row."""

    def __init__(self, fields: dict):
        super().__init__()
        self._fields = fields

    def __missing__(self, held: int) -> list:
        self[held] = [(k, new) for k, (_, new) in self._fields.items() if k not in WHEN or held & WHEN[k]]
        return self[held]


_EPISODE, _RECIPIENT = _Updates(EPISODE), _Updates(RECIPIENT)


def updated(fields: dict, before: dict, v, d: Verdict, held: int | None = None) -> dict:
    updates = _EPISODE if fields is EPISODE else _RECIPIENT if fields is RECIPIENT else _Updates(fields)
    after = before.copy()
    for k, new in updates[facts(v, d) if held is None else held]:
        after[k] = new(before, v, d)
    return after


def remember(state: dict, v, d: Verdict) -> dict:
    """The state after the row: an accepted clear ends the episode, a live row opens one."""
    held = facts(v, d)
    after = updated(RECIPIENT, RECIPIENT_FIRST | state, v, d, held)
    episode = after.pop("ep", None)
    if v.accepted:
        return after
    if episode is None and (v.live or v.state == "alert" or v.nationwide):
        episode = fresh_episode(v.ts_s)
    return after if episode is None else after | {"ep": updated(EPISODE, episode, v, d, held)}


# --- how a state is written ---------------------------------------------------

VERSION = 2
# what the stream keeps besides the fold
STREAM = {"official_at": None, "waiting": [], "backlog": [], "folded": None, "member": False, "timer": None, "limits": None}


def _ordered(x):
    """Sets as sorted lists, tuples as lists, so that equal states are equal texts."""
    if isinstance(x, (set, frozenset)):
        return sorted(map(_ordered, x))
    if isinstance(x, (list, tuple)):
        return [_ordered(y) for y in x]
    if isinstance(x, dict):
        return {k: _ordered(x[k]) for k in sorted(x)}
    return x


def dump(held: dict) -> str:
    """A state as text."""
    return json.dumps({"v": VERSION, **_ordered(held)}, ensure_ascii=False)


def load(text: str | None) -> dict:
    """A state from text: unknown fields are ignored, missing ones have their first value."""
    got = json.loads(text) if text else {}
    known = RECIPIENT_FIRST | {k: v.copy() if isinstance(v, list) else v for k, v in STREAM.items()}
    held = {k: got.get(k, first) for k, first in known.items()}
    if got.get("ep") is not None:
        first = fresh_episode(got["ep"].get("opened", 0))
        held["ep"] = {k: got["ep"].get(k, x) for k, x in first.items()}
    return held


def expire(held: dict, now: int) -> None:
    """Forget the facts of an episode that no rule can ask for at ``now`` or later."""
    e, limits = held.get("ep"), held["limits"]
    if e is not None and limits:
        for name, keep_s in zip(("seen", "lines"), limits[1:]):
            if any(now - t > keep_s for t in e[name].values()):
                e[name] = {k: t for k, t in e[name].items() if now - t <= keep_s}

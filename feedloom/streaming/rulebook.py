"""The decision rules as a table, and the walker that reads it.

A rule is a condition on the view of one row (its columns, plus what the memory says), and
an outcome: level, tone and a code.  A rule with ``then`` opens a group that always decides.
The first rule that holds gives the verdict.  Codes are what is stored; TEXTS says them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

HOME, NEAR, CITY, OBLAST, FAR, NOWHERE = 0, 1, 2, 3, 4, 9
RUNG = {OBLAST: 1, CITY: 2, NEAR: 3, HOME: 4}
RING, LINE, HUSH = "alert", "info", None
OWN = "own"  # the tone of the row's class

# The class table: severity rank, tone, and how the class behaves.
CLASSES = {
    "drone": (1, "drone", "drone"),
    "jet": (2, "drone-jet", "drone"),
    "cruise": (3, "cruise", "approach"),
    "carrier": (4, "carrier", "carrier"),
    "ballistic": (5, "ballistic", "launch"),
}
# What a recipient may turn off; all are on by default.
SWITCHES = ("say_clear", "say_alert", "say_recheck", "say_destination", "say_near_drone", "say_approach")


class Verdict(NamedTuple):
    level: str | None
    tone: str | None
    code: str


class Rule(NamedTuple):
    when: Callable[[object], object]
    level: str | None = HUSH
    code: str = ""
    tone: str | None = "none"
    switch: str | None = None
    then: tuple = ()


def hush(code: str, when=lambda v: True) -> Rule:
    return Rule(when, HUSH, code, None)


def line(code: str, when=lambda v: True, switch: str | None = None) -> Rule:
    return Rule(when, LINE, code, "none", switch)


def ring(code: str, when=lambda v: True, tone: str = OWN, switch: str | None = None) -> Rule:
    return Rule(when, RING, code, tone, switch)


def group(when, *then: Rule) -> Rule:
    return Rule(when, then=then)


CLEARS = (
    group(
        lambda v: v.partial and v.sent,
        hush("already-notified:lifted", lambda v: v.cleared and v.cleared in v.was["cleared"]),
        ring("clear:part", tone="clear-partial", switch="say_clear"),
    ),
    group(
        lambda v: v.official or v.fallback,
        hush("already-notified:cleared", lambda v: v.said_clear),
        ring("clear:official", lambda v: v.official, "clear", "say_clear"),
        ring("clear:stand-in", tone="clear", switch="say_clear"),
    ),
    hush("refinement:cleared", lambda v: v.has_official),
    ring("clear:heard", lambda v: v.in_city, "clear", "say_clear"),
    hush("too-far:cleared"),
)

DECLARATIONS = (
    group(
        lambda v: v.official,
        hush("already-notified:official", lambda v: v.was and v.was["official"]),
        ring("declared:official", tone="alert", switch="say_alert"),
    ),
    hush("refinement:declared", lambda v: v.has_official),
    hush("too-far:declared", lambda v: not v.in_city),
    # said before, unless only now it is said for a place
    hush("already-notified:declared", lambda v: v.on and not (v.scope != NOWHERE and not v.was["scope_known"])),
    hush("refinement:reply", lambda v: v.is_reply),
    ring("declared:heard", tone="alert", switch="say_alert"),
)

LAUNCHES = (
    group(
        lambda v: v.at_home,
        line("echo:home", lambda v: v.since(v.home_rang, v.home_dedup_s)),
        ring("launch:home"),
    ),
    group(
        lambda v: v.sent and not v.first_launch and not v.fresh and v.own_tone in v.was["tones"],
        line("wave:here", lambda v: v.in_city),
        line("wave:site", lambda v: v.launch_site and not v.says_launch),
        hush("already-notified:wave"),
    ),
    ring("launch:confirmed"),
)

CLOSE = (
    line("near:drone", lambda v: v.behaviour == "drone" and not v.at_home, "say_near_drone"),
    group(
        lambda v: not v.novel,
        hush("echo:home", lambda v: v.at_home and v.since(v.home_said, v.home_dedup_s)),
        line("already-notified:home", lambda v: v.at_home),
        hush("already-notified:near"),
    ),
    line("near:weak", lambda v: v.strength == "weak"),
    line("near:leaving", lambda v: v.heading == "away"),
    line("near:circling", lambda v: v.heading == "loitering"),
    ring("near:new"),
)

OVER_CITY = (
    hush("insufficient:drone", lambda v: v.behaviour in ("drone", None)),
    hush("already-notified:city", lambda v: v.sent),
    ring("city:threat", lambda v: v.on),
    hush("insufficient:no-alert"),
)

RULES = (
    group(lambda v: v.state == "clear", *CLEARS),
    group(lambda v: v.state is not None, *DECLARATIONS),
    hush("veto:aftermath", lambda v: v.veto == "aftermath"),
    hush("veto:summary", lambda v: v.veto == "summary"),
    hush("veto:other", lambda v: v.veto),
    group(
        lambda v: v.recheck and v.scope != FAR,
        hush("recheck:idle", lambda v: not v.on),
        hush("already-notified:recheck", lambda v: (v.eff or "all") in v.was["rechecked"]),
        line("recheck:gone", switch="say_recheck"),
    ),
    line("recheck:back", lambda v: v.reappeared and v.scope != FAR and v.was and v.was["rechecked"]),
    line(
        "launch:destination",
        lambda v: v.behaviour == "launch" and v.was and v.eff in v.was["launched"] and not v.was["located"]
        and not v.in_city and not v.says_launch and not (v.launch_site and v.after_recheck),
        "say_destination",
    ),
    hush("too-far:elsewhere", lambda v: not v.nationwide and v.scope in (FAR, NOWHERE) and not v.forecast),
    ring("home:falling", lambda v: v.falling and v.at_home and v.live),
    group(lambda v: v.impact and not v.falling, line("impact:near", lambda v: v.near), hush("impact:elsewhere")),
    line("launch:region", lambda v: v.behaviour == "launch" and v.scope == OBLAST),
    ring("level:rose", lambda v: v.on and v.stated and v.certainty not in ("clear", "lost") and v.rank > v.highest),
    group(
        lambda v: v.certainty == "probable" and v.behaviour in ("launch", "approach"),
        hush("veto:talk", lambda v: v.behaviour == "launch" and v.strength == "none"),
        line("insufficient:threatened"),
    ),
    hush("too-far:carried", lambda v: v.behaviour == "launch" and v.inherited and not v.in_city),
    hush("insufficient:no-alert-launch", lambda v: v.behaviour == "launch" and v.has_official and not (v.was and v.was["official"])),
    group(
        lambda v: v.behaviour == "launch" and v.certainty == "confirmed" and v.strength != "none"
        and (v.says_launch or v.scope != FAR or v.launch_site),
        *LAUNCHES,
    ),
    group(
        lambda v: v.behaviour == "carrier" and v.strength != "none",
        hush("already-notified:carrier", lambda v: v.was and v.own_tone in v.was["tones"] and not v.fresh),
        ring("carrier:up"),
    ),
    group(lambda v: v.near and v.live, *CLOSE),
    line("declared:cause", lambda v: v.was and v.was["official"] and not v.was["explained"] and v.live and v.eff and v.scope <= OBLAST),
    ring(
        "approach:closer",
        lambda v: v.behaviour == "approach" and v.live and not v.inherited and v.certainty != "probable" and v.on
        and RUNG.get(v.scope, 0) > v.was["rung"],
        switch="say_approach",
    ),
    line("forecast:alert", lambda v: v.forecast and not v.on),
    group(lambda v: v.live and v.scope == CITY, *OVER_CITY),
    hush("too-far:region", lambda v: v.live and v.scope == OBLAST),
    line("wave:site", lambda v: v.launch_site and v.live and v.behaviour in ("launch", "carrier")),
    hush("nothing"),
)

# Words for people; a code without one is said as it is.
TEXTS = {
    "already-notified:lifted": "that class was lifted before", "already-notified:cleared": "the clear was said before",
    "already-notified:official": "the official alert was said before", "already-notified:declared": "the alert was said before",
    "already-notified:wave": "belongs to a wave that rang", "already-notified:recheck": "the recheck was said before",
    "already-notified:carrier": "the carrier was said before", "already-notified:home": "known target at home",
    "already-notified:near": "known target close by", "already-notified:city": "somebody is awake already", "already-notified:line": "same line within a minute",
    "clear:part": "one class is lifted", "clear:official": "clear by the official source", "clear:stand-in": "clear, the official source being silent",
    "clear:heard": "clear", "declared:official": "official alert", "declared:heard": "alert", "declared:cause": "what the alert is about",
    "recheck:gone": "probably gone", "recheck:back": "back again", "recheck:idle": "a recheck outside an alert",
    "launch:home": "a launch, and home is named", "launch:confirmed": "launch", "launch:destination": "where it goes", "launch:region": "launch, over the region",
    "wave:here": "the wave, now here", "wave:site": "a launch site is named", "home:falling": "falls at home", "level:rose": "a graver class",
    "near:new": "new target close by", "near:weak": "weak sign close by", "near:leaving": "goes away", "near:circling": "circles", "near:drone": "drone close by",
    "approach:closer": "one step closer", "carrier:up": "carrier in the air", "city:threat": "threat over the city", "forecast:alert": "an alert may follow",
}


def walk(rules: Sequence[Rule], v) -> Verdict:
    """The verdict of the first rule that holds; every table ends with one that does."""
    while True:
        for hit in rules:
            if hit.when(v):
                break
        else:
            raise ValueError("a table of rules has to end with one that holds")
        if not hit.then:
            break
        rules = hit.then
    if hit.switch and getattr(v, hit.switch) is False:
        return Verdict(HUSH, None, f"off:{hit.switch}")
    return Verdict(hit.level, v.own_tone if hit.tone == OWN else hit.tone, hit.code)

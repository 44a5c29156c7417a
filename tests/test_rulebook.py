"""Rules of the table, walked without a session: one timeline each."""

import pytest

from feedloom.streaming import policy
from feedloom.streaming.memory import EPISODE, fresh_episode, updated
from feedloom.streaming.rulebook import CITY, FAR, HOME, NEAR, NOWHERE, OBLAST, RULES, SWITCHES, TEXTS, Verdict

ROW = {
    "official": False, "has_official": False, "accepted": False, "fallback": False, "state": None, "partial": False, "cleared": None,
    "cls": None, "scope": NOWHERE, "veto": None, "certainty": "confirmed", "strength": "strong", "heading": "position", "recheck": False,
    "reappeared": False, "says_new": False, "says_launch": False, "falling": False, "impact": False, "is_reply": False, "forecast": False,
    "nationwide": False, "launch_site": False, "buried": False, "count": 1, "places": [], "kinds": [], "quiet": False,
    **dict.fromkeys(policy.FLAGS, False), **dict.fromkeys(SWITCHES, True), **policy.SETTINGS,
}
ALERT = {"state": "alert", "scope": CITY}
OFFICIAL = {"state": "alert", "official": True, "has_official": True}
LAUNCH = {"cls": "ballistic", "scope": CITY, "says_launch": True}
GONE = {"recheck": True, "scope": CITY}


def play(*rows):
    state, out = {}, []
    for ts, r in rows:
        r = {**ROW, "ts_s": ts, **r}
        r.setdefault("live", r["state"] != "clear")
        r["at_home"], r["near"], r["in_city"] = r["scope"] == HOME, r["scope"] <= NEAR, r["scope"] in (HOME, NEAR, CITY, NOWHERE)
        r["live"] = r.get("live", True)
        got = policy.step(state, r)
        out.append((got["level"], got["reason"]))
    return out


def last(*rows):
    return play(*rows)[-1]


@pytest.mark.parametrize("rows,want", [
    ([(0, ALERT), (5, {"state": "clear", "partial": True, "cleared": "cruise"}), (9, {"state": "clear", "partial": True, "cleared": "cruise"})], (None, "already-notified:lifted")),
    ([(0, {"state": "clear", "official": True, "accepted": True})], ("alert", "clear:official")),
    ([(0, {"state": "clear", "official": True, "accepted": True}), (9, {"state": "clear", "official": True, "accepted": True})], (None, "already-notified:cleared")),
    ([(0, {"state": "clear", "fallback": True, "accepted": True})], ("alert", "clear:stand-in")),
    ([(0, {"state": "clear", "has_official": True})], (None, "refinement:cleared")),
    ([(0, {"state": "clear", "scope": CITY})], ("alert", "clear:heard")),
    ([(0, {"state": "clear", "scope": FAR})], (None, "too-far:cleared")),
    ([(0, OFFICIAL), (5, OFFICIAL)], (None, "already-notified:official")),
    ([(0, {"state": "alert", "has_official": True})], (None, "refinement:declared")),
    ([(0, {"state": "alert", "scope": OBLAST})], (None, "too-far:declared")),
    ([(0, ALERT), (5, ALERT)], (None, "already-notified:declared")),
    ([(0, {**ALERT, "is_reply": True})], (None, "refinement:reply")),
    ([(0, {"veto": "aftermath"})], (None, "veto:aftermath")),
    ([(0, GONE)], (None, "recheck:idle")),
    ([(0, ALERT), (5, GONE)], ("info", "recheck:gone")),
    ([(0, ALERT), (5, GONE), (9, GONE)], (None, "already-notified:recheck")),
    ([(0, ALERT), (5, GONE), (9, {"reappeared": True, "scope": CITY})], ("info", "recheck:back")),
    ([(0, LAUNCH), (5, {"cls": "ballistic", "scope": OBLAST})], ("info", "launch:destination")),
    ([(0, {"cls": "cruise", "scope": FAR})], (None, "too-far:elsewhere")),
    ([(0, {"falling": True, "scope": HOME})], ("alert", "home:falling")),
    ([(0, {"impact": True, "scope": NEAR})], ("info", "impact:near")),
    ([(0, {"impact": True, "scope": CITY})], (None, "impact:elsewhere")),
    ([(0, {"cls": "ballistic", "scope": OBLAST})], ("info", "launch:region")),
    ([(0, ALERT), (5, {"cls": "cruise", "scope": CITY})], ("alert", "level:rose")),
    ([(0, {"cls": "cruise", "certainty": "probable", "scope": CITY})], ("info", "insufficient:threatened")),
    ([(0, {"cls": "ballistic", "certainty": "probable", "strength": "none", "scope": CITY})], (None, "veto:talk")),
    ([(0, {"cls": "ballistic", "scope": CITY, "has_official": True})], (None, "insufficient:no-alert-launch")),
    ([(0, LAUNCH)], ("alert", "launch:confirmed")),
    ([(0, {**LAUNCH, "scope": HOME})], ("alert", "launch:home")),
    ([(0, {**LAUNCH, "scope": HOME}), (9, {**LAUNCH, "scope": HOME})], ("info", "echo:home")),
    ([(0, LAUNCH), (5, LAUNCH)], ("info", "wave:here")),
    ([(0, {"cls": "carrier", "scope": CITY})], ("alert", "carrier:up")),
    ([(0, {"cls": "carrier", "scope": CITY}), (5, {"cls": "carrier", "scope": CITY})], (None, "already-notified:carrier")),
    ([(0, {"cls": "drone", "scope": NEAR})], ("info", "near:drone")),
    ([(0, {"cls": "cruise", "scope": NEAR, "strength": "weak"})], ("info", "near:weak")),
    ([(0, {"cls": "cruise", "scope": NEAR, "heading": "away"})], ("info", "near:leaving")),
    ([(0, {"cls": "cruise", "scope": NEAR})], ("alert", "near:new")),
    ([(0, {"cls": "cruise", "scope": NEAR}), (5, {"cls": "cruise", "scope": NEAR})], (None, "already-notified:near")),
    ([(0, OFFICIAL), (5, {"cls": "jet", "scope": OBLAST, "strength": "none"})], ("info", "declared:cause")),
    ([(0, ALERT), (5, {"cls": "cruise", "scope": OBLAST, "strength": "none"})], ("alert", "approach:closer")),
    ([(0, {"forecast": True})], ("info", "forecast:alert")),
    ([(0, {"cls": "drone", "scope": CITY})], (None, "insufficient:drone")),
    ([(0, {"cls": "cruise", "scope": CITY})], (None, "insufficient:no-alert")),
    ([(0, {"cls": "cruise", "scope": OBLAST})], (None, "too-far:region")),
    ([(0, {"scope": CITY, "live": False})], (None, "nothing")),
])
def test_each_rule(rows, want):
    assert last(*rows) == want


def test_a_new_kind_after_a_recheck_opens_a_wave():
    old, new = {**LAUNCH, "says_launch": False, "kinds": ["k1"], "ordinal": True}, {**LAUNCH, "says_launch": False, "kinds": ["k2"], "ordinal": True}
    start = [(0, ALERT), (5, {**LAUNCH, "kinds": ["k1"]}), (300, GONE)]
    assert last(*start, (310, old))[0] == "info"
    assert last(*start, (310, new)) == ("alert", "launch:confirmed")


def test_a_warning_is_not_a_first_launch():
    """The warning spends the tone; the first real launch rings all the same."""
    row = {"cls": "ballistic", "scope": CITY, "strength": "strong"}
    heard = play((0, ALERT), (5, {**row, "warning": True}), (10, {**row, "warning": True}), (20, row))
    assert heard[1:] == [("alert", "level:rose"), ("info", "wave:here"), ("alert", "launch:confirmed")]
    assert last((0, LAUNCH), (5, {**row, "warning": True}))[0] == "info"


def test_a_launch_nobody_has_placed_is_not_rechecked_away():
    far = {**LAUNCH, "scope": NOWHERE, "launch_site": True, "nationwide": True}
    again = {**LAUNCH, "says_launch": False}
    assert last((0, ALERT), (5, far), (40, GONE), (60, again))[0] == "info"
    assert last((0, ALERT), (5, far), (200, GONE), (260, again)) == ("alert", "launch:confirmed")


def test_a_generic_word_belongs_to_the_launch_in_the_air():
    got = play((0, LAUNCH), (2, {"cls": "cruise", "scope": CITY, "generic": True}), (3, {"cls": "cruise", "scope": NEAR, "count": 2}))
    assert [x for x, _ in got] == ["alert", "info", "alert"]


def test_a_launch_site_after_a_recheck_is_the_next_wave():
    site = {"cls": "ballistic", "scope": FAR, "launch_site": True, "nationwide": True}
    assert last((0, ALERT), (5, LAUNCH), (9, site)) == ("info", "launch:destination")
    assert last((0, ALERT), (5, LAUNCH), (300, GONE), (310, site)) == ("alert", "launch:confirmed")


@pytest.mark.parametrize("switch,rows", [
    ("say_clear", [(0, {"state": "clear", "scope": CITY})]), ("say_alert", [(0, ALERT)]), ("say_recheck", [(0, ALERT), (5, GONE)]),
    ("say_destination", [(0, LAUNCH), (5, {"cls": "ballistic", "scope": OBLAST})]), ("say_near_drone", [(0, {"cls": "drone", "scope": NEAR})]),
    ("say_approach", [(0, ALERT), (5, {"cls": "cruise", "scope": OBLAST, "strength": "none"})]),
])
def test_switches(switch, rows):
    assert last(*rows[:-1], (rows[-1][0], {**rows[-1][1], switch: False})) == (None, f"off:{switch}")


def test_place_and_line_memories_are_pruned():
    state = {}
    for i in range(200):
        r = {**ROW, "ts_s": 700 * i, "cls": "cruise", "scope": NEAR, "places": [f"p{i}"], "live": True, "at_home": False, "near": True, "in_city": True}
        policy.step(state, r)
    assert len(state["ep"]["seen"]) == 1


def test_updates_see_only_the_state_before_the_row():
    before = fresh_episode(0)
    held = {k: list(x) if isinstance(x, list) else dict(x) if isinstance(x, dict) else x for k, x in before.items()}
    v = policy.View({"ep": before}, {**ROW, "ts_s": 5, **LAUNCH, "live": True, "at_home": False, "near": False, "in_city": True})
    updated(EPISODE, before, v, Verdict("alert", "ballistic", "launch:confirmed"))
    assert before == held


def test_every_table_ends_with_a_rule_that_holds():
    def closed(rules):
        assert rules[-1].then == () and rules[-1].when(None)
        for r in rules:
            if r.then and r.then[0].code != "impact:near":
                closed(r.then)

    closed(RULES)
    assert all(TEXTS.values())

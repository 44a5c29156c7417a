"""A neutral rule pack over the words of the demo texts (vocabulary is user data)."""

from __future__ import annotations

from ..operators.classify import Pack


def at_word(*stems: str) -> str:
    """A word beginning with one of the stems; engine-neutral, so no \\b and no \\w."""
    return "(?i)(?:^|[^\\p{L}])(?:" + "|".join(stems) + ")"


RULES: dict[str, list[tuple[str, str]]] = {
    "class": [
        (at_word("erst", "ontion"), "ballistic"),
        (at_word("rere", "orre"), "cruise"),
        (at_word("anea", "nicht"), "jet"),
        (at_word("this", "dans", "sich"), "drone"),
    ],
    "override": [(at_word("inoran"), "carrier")],
    "override_veto": [(at_word("ononst"), "")],
    "denied": [("(?i)(?:erst|rere|anea|this)[\\p{L}]* (?:(?:the|of|on) )*(?:than|thre|of)", "")],
    "conditional": [("(?i)(?:^|[^\\p{L}])(?:from|pour)[^.!?\\n]*", "")],
    "kind": [("(?i)erst", "erst"), ("(?i)ontion", "ontion"), ("(?i)rere", "rere"), ("(?i)anea", "anea"), ("(?i)dans", "dans")],
    "clear": [("with", ""), ("avec", "")],
    "alert": [(at_word("that", "nque"), "")],
    "awaiting": [("(?i)thing|eine", "")],
    "canonical": [("(?i)with the|that of", "")],
    "opinion": [(at_word("thon"), "")],
    "advice": [(at_word("erin"), "")],
    "retracted": [(at_word("thnd"), "")],
    "level": [("(?i)rere[\\p{L}]* (?:the|of)", "")],
    "forecast_phrase": [(at_word("thwh"), "")],
    "forecast": [(at_word("erwh", "rewh"), "")],
    "forecast_past": [(at_word("ernd"), "")],
    "recheck": [("(?i)thth|keit", "")],
    "reappear": [("(?i)eror", "")],
    "work_report": [(at_word("hehe"), "")],
    "work_as_warning": [("(?i)or the", "")],
    "gone": [("(?i)heit[^.!?]{0,20}(?:der|und)", "")],
    "specific": [("(?i)rere|thly", "")],
    "negated": [("(?i)ernt [\\p{L}]+", "")],
    "shape": [("[0-9]+", "count-marker"), (at_word("thtion"), "launch"), ("(?i)thing|ering", "movement"),
              (at_word("then"), "phase-word"), (at_word("this", "sich"), "place-with-threat")],
    "marker": [("[!%#]", "")],
    "beside": [(at_word("anea", "erst"), "")],
    "loud": [(at_word("thsh"), "")],
    "social": [("the", ""), ("anti", ""), ("inan", ""), ("ench", "")],
    "social_opener": [("^[^\\p{L}]*[Ee]rti", "")],
    "summary": [(at_word("asci"), "")],
    "outlook": [(at_word("para"), "")],
    "weather": [(at_word("onst"), "")],
    "ours": [(at_word("onnd"), "")],
    "promo": [("(?i)licen", "")],
    "impact": [(at_word("erea", "elle"), "")],
    "aftermath": [(at_word("onat", "heit"), "")],
    "resolved": [(at_word("ered", "lich"), "")],
    "lost": [(at_word("ernt"), "")],
    "anticipated": [(at_word("onth"), "")],
    "possible": [(at_word("oner"), "")],
    "hedge": [("(?i)onou|ener", "")],
    "duration": [("(?i)from [\\p{L}]+", "")],
    "novel": [(at_word("from", "than", "keit"), "")],
    "ordinal": [(at_word("thes"), "")],
    "launch": [(at_word("thtion", "ment"), "")],
    "hit": [(at_word("erea"), "")],
}
TONES = {"ballistic": "ballistic", "cruise": "missile", "jet": "drone-jet", "drone": "drone", "carrier": "carrier", "none": "none"}
STRONG = ["count-marker", "launch", "threat-with-place", "place-with-threat", "movement", "bare-place-list"]
FILLER = ["the", "of", "and", "to", "in"]
PACK = Pack({k: tuple(v) for k, v in RULES.items()})


def rule_table(spark):
    """The pack as the table a user would keep it in."""
    rows = [(fam, i, p, l) for fam, rules in RULES.items() for i, (p, l) in enumerate(rules)]
    return spark.createDataFrame(rows, "family STRING, priority INT, pattern STRING, label STRING")

"""The decision cascade and its memory as SQL, written from the survey's appendices.

The check of the fold: a recursion over the rows of a recipient in order, with the whole memory as
columns.  Rows after a whole clear by the declaring source, outside quiet hours and at least the echo
time later, begin a part of their own: there the clear is said, no episode is open, and nothing else
of the memory can matter.  The demo feed has no recipient switches, kinds, or warning words, so the
rules that ask for those are not written out here (``tests/test_rulebook.py`` has a timeline for each).
"""

from __future__ import annotations

from .common import FEED, ZONE

KLASSES = "['drone', 'jet', 'cruise', 'carrier', 'ballistic']"

OBS = f"""obs AS (
SELECT 'region' || r AS recipient, ts_s, channel, message_id, said AND n % 2 = 0 AS official,
  CASE channel WHEN 'signup' THEN 'alert' WHEN 'purchase' THEN 'clear' ELSE '' END AS state,
  channel = 'purchase' AND n % 3 = 0 AS partial, n % 5 = 0 AS canonical,
  CASE WHEN channel = 'purchase' AND n % 3 = 0 THEN {KLASSES}[who % 5 + 1] END AS lifted,
  CASE WHEN NOT said AND (who + n) % 7 < 5 THEN {KLASSES}[(who + n) % 7 + 1] END AS cls, scope,
  n % 13 = 0 AS aftermath, n % 13 <> 0 AND n % 17 = 0 AS summary, n % 13 <> 0 AND n % 17 <> 0 AND n % 19 = 0 AS other,
  CASE WHEN value < 3 THEN 'probable' WHEN n % 23 = 0 THEN 'lost' ELSE 'confirmed' END AS certainty,
  ['none', 'weak', 'strong', 'strong'][n % 4 + 1] AS strength, ['toward', 'away', 'loitering', 'position'][who % 4 + 1] AS heading,
  channel = 'click' AND n % 11 = 0 AS recheck, n % 29 = 0 AS reappeared, n % 6 = 0 AS says_new, n % 9 = 0 AS says_launch, n % 31 = 0 AS falling,
  n % 37 = 0 AS impact, message_id % 4 = 0 AS is_reply, n % 43 = 0 AS forecast, (who + n) % 7 = 4 AND n % 3 = 0 AND NOT said AS nationwide,
  lost AND n % 2 = 0 AS launch_site, n % 47 = 0 AS buried, n // 10 AS cnt, CASE WHEN scope <= 1 THEN n_name END AS place,
  CASE WHEN scope IN (2, 3) THEN n_name END AS far, CASE WHEN n % 43 = 0 THEN (n % 9 + 1) || ' min' END AS eta,
  r % 2 = 0 AND (hour(ts) >= 22 OR hour(ts) < 7) AS quiet,
  CAST(CAST(timezone('{ZONE}', timezone('UTC', ts)) - INTERVAL 15 HOUR AS DATE) AS VARCHAR) AS night
FROM (SELECT f.*, n_name, r, said, lost, CASE WHEN lost THEN 9 WHEN away = 0 AND k % 3 = 0 THEN 0 WHEN away = 0 THEN 1 WHEN away = 1 THEN 2 WHEN away = 2 THEN 3 ELSE 4 END AS scope
  FROM (SELECT *, channel IN ('signup', 'purchase') AS said, who % 7 = 0 AS lost FROM feed) f
  JOIN (SELECT n_nationkey AS k, n_name, r, (r - n_regionkey + 5) % 5 AS away FROM nation, (SELECT unnest(range(5)) AS r)) p ON f.who % 25 = p.k))"""


def placed(keys: str) -> str:
    """The rows in order: what is accepted, and the part of its recipient's feed that each belongs to."""
    order = f"PARTITION BY {keys} ORDER BY ts_s, official, channel, message_id"
    return f"""aged AS (SELECT *, live AND NOT aftermath AND NOT summary AND NOT other AS alive,
  state = 'clear' AND NOT partial AND (official OR NOT has_official OR (age > 1800 AND canonical AND scope <> 4)) AS accepted FROM (
  SELECT *, state <> 'clear' AS live, bool_or(official) OVER (PARTITION BY {keys}) AS has_official,
    coalesce(ts_s - max(CASE WHEN official THEN ts_s END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS age FROM obs WINDOW o AS ({order}))),
turned AS (SELECT *, coalesce(lag(official AND accepted AND NOT quiet) OVER o AND ts_s - lag(ts_s) OVER o > 15, false) AS turn FROM aged WINDOW o AS ({order})),
parted AS (SELECT *, sum(CAST(turn AS INT)) OVER o AS part FROM turned WINDOW o AS ({order})),
lined AS (SELECT *, row_number() OVER (PARTITION BY {keys}, part ORDER BY ts_s, official, channel, message_id) AS i FROM parted)"""


FIRST = """false AS has_ep, CAST(NULL AS BIGINT) AS live_at, CAST(NULL AS BIGINT) AS opened, CAST(NULL AS VARCHAR) AS e_cls, CAST(NULL AS BIGINT) AS cls_at, 0 AS sent, CAST(NULL AS BIGINT) AS rang,
  CAST([] AS VARCHAR[]) AS tones, CAST(0 AS BIGINT) AS peak, CAST([] AS VARCHAR[]) AS air, CAST([] AS VARCHAR[]) AS gone, CAST([] AS VARCHAR[]) AS rechecked, CAST(NULL AS BIGINT) AS recheck_at,
  CAST([] AS VARCHAR[]) AS launched, CAST(NULL AS BIGINT) AS launch_at, CAST(NULL AS BIGINT) AS unplaced_at, false AS located, false AS announced, false AS declared, false AS scope_known,
  false AS explained, 0 AS rung, MAP([]::VARCHAR[], []::BIGINT[]) AS seen, MAP([]::VARCHAR[], []::BIGINT[]) AS lines,
  MAP([]::VARCHAR[], []::BIGINT[]) AS recheck_of, MAP([]::VARCHAR[], []::BIGINT[]) AS lifted_of"""


def _fields() -> dict[str, str]:
    """The fields of an episode and what each is before there is one."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(FIRST):
        depth += (ch in "([") - (ch in ")]")
        if ch == "," and depth == 0:
            out.append(FIRST[at:i])
            at = i + 1
    out.append(FIRST[at:])
    return {name.strip(): first.strip() for first, name in (x.rsplit(" AS ", 1) for x in out)}


FIRSTS = _fields()
RUNG = "CASE scope WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 WHEN 0 THEN 4 ELSE 0 END"
RANK = "CASE {} WHEN 'drone' THEN 1 WHEN 'jet' THEN 2 WHEN 'cruise' THEN 3 WHEN 'carrier' THEN 4 WHEN 'ballistic' THEN 5 ELSE 0 END"

# The rules in order; R rings, L is a line, H is silent.
CASCADE = f"""CASE
  WHEN state = 'clear' THEN CASE
    WHEN partial AND sent > 0 THEN CASE WHEN list_contains(gone, lifted) THEN 'H already-notified:lifted' ELSE 'R clear:part' END
    WHEN official OR fallback THEN CASE WHEN said_clear THEN 'H already-notified:cleared' WHEN official THEN 'R clear:official' ELSE 'R clear:stand-in' END
    WHEN has_official THEN 'H refinement:cleared'
    WHEN in_city THEN 'R clear:heard' ELSE 'H too-far:cleared' END
  WHEN state = 'alert' THEN CASE
    WHEN official THEN CASE WHEN declared THEN 'H already-notified:official' ELSE 'R declared:official' END
    WHEN has_official THEN 'H refinement:declared'
    WHEN NOT in_city THEN 'H too-far:declared'
    WHEN announced AND NOT (scope <> 9 AND NOT scope_known) THEN 'H already-notified:declared'
    WHEN is_reply THEN 'H refinement:reply' ELSE 'R declared:heard' END
  WHEN aftermath THEN 'H veto:aftermath'
  WHEN summary AND NOT recheck THEN 'H veto:summary'
  WHEN other THEN 'H veto:other'
  WHEN recheck AND scope <> 4 THEN CASE WHEN NOT announced THEN 'H recheck:idle' WHEN list_contains(rechecked, coalesce(eff, 'all')) THEN 'H already-notified:recheck' ELSE 'L recheck:gone' END
  WHEN reappeared AND scope <> 4 AND len(rechecked) > 0 THEN 'L recheck:back'
  WHEN eff = 'ballistic' AND has_ep AND list_contains(launched, eff) AND NOT located AND NOT in_city AND NOT says_launch AND NOT (launch_site AND after_recheck) THEN 'L launch:destination'
  WHEN NOT nationwide AND scope IN (4, 9) AND NOT forecast THEN 'H too-far:elsewhere'
  WHEN falling AND scope = 0 AND alive THEN 'R home:falling'
  WHEN impact AND NOT falling THEN CASE WHEN scope <= 1 THEN 'L impact:near' ELSE 'H impact:elsewhere' END
  WHEN eff = 'ballistic' AND scope = 3 THEN 'L launch:region'
  WHEN announced AND alive AND NOT inherited AND strength <> 'none' AND certainty NOT IN ('clear', 'lost') AND erank > highest THEN 'R level:rose'
  WHEN certainty = 'probable' AND eff IN ('ballistic', 'cruise') THEN CASE WHEN eff = 'ballistic' AND strength = 'none' THEN 'H veto:talk' ELSE 'L insufficient:threatened' END
  WHEN eff = 'ballistic' AND inherited AND NOT in_city THEN 'H too-far:carried'
  WHEN eff = 'ballistic' AND has_official AND NOT declared THEN 'H insufficient:no-alert-launch'
  WHEN eff = 'ballistic' AND certainty = 'confirmed' AND strength <> 'none' AND (says_launch OR scope <> 4 OR launch_site) THEN CASE
    WHEN scope = 0 THEN CASE WHEN ts_s - home_rang BETWEEN 0 AND 15 THEN 'L echo:home' ELSE 'R launch:home' END
    WHEN sent > 0 AND NOT first_launch AND NOT fresh AND list_contains(tones, tone0) THEN CASE
      WHEN in_city THEN 'L wave:here' WHEN launch_site AND NOT says_launch THEN 'L wave:site' ELSE 'H already-notified:wave' END
    ELSE 'R launch:confirmed' END
  WHEN eff = 'carrier' AND strength <> 'none' THEN CASE WHEN list_contains(tones, tone0) AND NOT fresh THEN 'H already-notified:carrier' ELSE 'R carrier:up' END
  WHEN scope <= 1 AND alive0 THEN CASE
    WHEN eff IN ('drone', 'jet') AND scope <> 0 THEN 'L near:drone'
    WHEN NOT novel THEN CASE WHEN scope = 0 AND ts_s - home_said BETWEEN 0 AND 15 THEN 'H echo:home' WHEN scope = 0 THEN 'L already-notified:home' ELSE 'H already-notified:near' END
    WHEN strength = 'weak' THEN 'L near:weak' WHEN heading = 'away' THEN 'L near:leaving' WHEN heading = 'loitering' THEN 'L near:circling' ELSE 'R near:new' END
  WHEN declared AND NOT explained AND alive0 AND eff IS NOT NULL AND scope <= 3 THEN 'L declared:cause'
  WHEN eff = 'cruise' AND alive0 AND NOT inherited AND certainty <> 'probable' AND announced AND {RUNG} > rung THEN 'R approach:closer'
  WHEN forecast AND NOT announced THEN 'L forecast:alert'
  WHEN alive0 AND scope = 2 THEN CASE WHEN eff IS NULL OR eff IN ('drone', 'jet') THEN 'H insufficient:drone' WHEN sent > 0 THEN 'H already-notified:city' WHEN announced THEN 'R city:threat' ELSE 'H insufficient:no-alert' END
  WHEN alive0 AND scope = 3 THEN 'H too-far:region'
  WHEN launch_site AND alive0 AND eff IN ('ballistic', 'carrier') THEN 'L wave:site'
  ELSE 'H nothing' END"""

FOR_EVER = 1 << 40
_LIST = "list_sort(list_distinct(list_filter({}, lambda c: c IS NOT NULL)))"


def _with(xs: str, *more: str) -> str:
    return _LIST.format(f"list_concat({xs}, CAST([{', '.join(more)}] AS VARCHAR[]))")


def _kept(m: str, now: str, most: int) -> str:
    return f"map_from_entries(list_filter(map_entries({m}), lambda e: {now} - e.value <= {most}))"


def _put(m: str, key: str, now: str, most: int) -> str:
    return (f"map_from_entries(list_concat(list_filter(map_entries({m}), lambda e: {now} - e.value <= {most} AND e.key <> {key}), "
            f"[{{'key': {key}, 'value': {now}}}]))")


UPDATES = {
    "live_at": "CASE WHEN alive OR state = 'alert' THEN ts_s ELSE live_at END",
    "opened": "coalesce(opened, ts_s)",
    "e_cls": "CASE WHEN names THEN eff ELSE e_cls END",
    "cls_at": "CASE WHEN names THEN ts_s ELSE cls_at END",
    "sent": "sent + CAST(level IS NOT NULL AS INT)",
    "rang": "CASE WHEN rings AND NOT official THEN ts_s ELSE rang END",
    "tones": f"CASE WHEN rings THEN {_with('tones', 'tone')} ELSE tones END",
    "peak": "CASE WHEN level IS NOT NULL THEN cnt ELSE greatest(peak, cnt) END",
    "air": _with(
        f"list_filter(CASE WHEN declares AND NOT announced THEN {_with('air', chr(39) + 'drone' + chr(39), 'e_cls')} ELSE air END, lambda c: c IS DISTINCT FROM lifted)",
        "CASE WHEN (announced OR declares) AND alive AND NOT partial THEN eff END"),
    "gone": f"list_filter({_with('gone', 'lifted')}, lambda c: NOT (names AND c = eff))",
    "rechecked": f"""CASE WHEN rechecks THEN {_with('rechecked', "coalesce(eff, 'all')")}
      WHEN (level IS NOT NULL AND alive AND eff IS NOT NULL) OR (reappeared AND scope <> 4) THEN CAST([] AS VARCHAR[]) ELSE rechecked END""",
    "recheck_at": """CASE WHEN rechecks THEN CASE WHEN ts_s - unplaced_at < 120 THEN recheck_at ELSE ts_s END
      WHEN rings AND after_recheck THEN NULL ELSE recheck_at END""",
    "launched": f"CASE WHEN rings AND eff IS NOT NULL AND (code = 'launch:confirmed' OR (says_launch AND certainty = 'confirmed')) THEN {_with('launched', 'eff')} ELSE launched END",
    "launch_at": "CASE WHEN says_new THEN ts_s ELSE launch_at END",
    "unplaced_at": """CASE WHEN eff = 'ballistic' AND rings AND tone = tone0 THEN CASE WHEN scope IN (4, 9) THEN ts_s END
      WHEN eff = 'ballistic' AND alive AND scope NOT IN (4, 9) THEN NULL ELSE unplaced_at END""",
    "located": "NOT rechecks AND (located OR code = 'launch:destination')",
    "announced": "announced OR declares",
    "declared": "declared OR (declares AND official)",
    "scope_known": "scope_known OR (declares AND (official OR scope <= 2))",
    "explained": "explained OR (level IS NOT NULL AND NOT official AND eff IS NOT NULL AND scope <= 3)",
    "rung": f"CASE WHEN rings AND eff = 'cruise' THEN greatest(rung, {RUNG}) ELSE rung END",
    "seen": f"CASE WHEN alive AND place IS NOT NULL AND code NOT LIKE 'already-notified%' THEN {_put('seen', 'place', 'ts_s', 600)} ELSE seen END",
    "recheck_of": f"CASE WHEN rechecks THEN {_put('recheck_of', "coalesce(eff, 'all')", 'ts_s', FOR_EVER)} ELSE recheck_of END",
    "lifted_of": f"CASE WHEN lifted IS NOT NULL THEN {_put('lifted_of', 'lifted', 'ts_s', FOR_EVER)} ELSE lifted_of END",
    "lines": f"CASE WHEN level = 'info' THEN {_put('lines', 'line', 'ts_s', 60)} ELSE lines END",
}


def _blank_unless(cond: str, prefix: str) -> str:
    """The episode's fields as they are where ``cond`` holds, else those of none."""
    return ", ".join(f"CASE WHEN {cond} THEN {prefix}{c} ELSE {first} END AS {c}" for c, first in FIRSTS.items() if c != "has_ep")


STAYED = """stays AS (SELECT * FROM (VALUES {}) s(recipient, stay, from_s, until_s)),
obs AS (SELECT o.*, stay FROM observed o JOIN stays USING (recipient) WHERE ts_s >= from_s - {} AND (until_s IS NULL OR ts_s < until_s))"""


def fold(keys: list[str], among: str = "") -> str:
    """CTEs up to ``decided``: keys, ts_s, channel, message_id, level, tone, reason, sky, effective, and of the open episode alive_s, its last sign of life, and held, its fields.

    ``among`` makes ``obs`` of all that is ``observed``.
    """
    seen = f"{OBS.replace('obs AS (', 'observed AS (', 1)},\n{among}" if among else OBS
    ks = ", ".join(keys)
    same = " AND ".join(f"x.{k} = s.{k}" for k in keys)
    return f"""{FEED}, {seen}, {placed(ks)},
r AS (
  SELECT {ks}, part, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ts_s, CAST(NULL AS VARCHAR) AS channel, CAST(NULL AS BIGINT) AS message_id,
    part > 0 AS said_clear, CAST(NULL AS BIGINT) AS home_said, CAST(NULL AS BIGINT) AS home_rang, {FIRST},
    CAST(NULL AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS tone, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS eff
  FROM lined GROUP BY {ks}, part
  UNION ALL
  SELECT {ks}, part, i, ts_s, channel, message_id,
    coalesce(tone = 'clear', false) OR (said_clear AND NOT (official AND state = 'alert')),
    CASE WHEN rings AND scope = 0 THEN ts_s ELSE home_said END, CASE WHEN rings AND scope = 0 AND tone = 'ballistic' THEN ts_s ELSE home_rang END,
    keeps, {', '.join(f"CASE WHEN keeps THEN {UPDATES[c]} ELSE {f} END" for c, f in FIRSTS.items() if c != "has_ep")},
    level, tone, code, eff
  FROM (
    SELECT *, has_ep OR alive OR state = 'alert' OR nationwide AS opens, NOT accepted AND (has_ep OR alive OR state = 'alert' OR nationwide) AS keeps
    FROM (
      SELECT * REPLACE (CASE WHEN has_ep THEN live_at ELSE ts_s END AS live_at), coalesce(level = 'alert', false) AS rings,
        state = 'alert' AND (official OR coalesce(tone = 'alert', false)) AS declares, cls IS NOT NULL AND alive AND code <> 'nothing' AS names, recheck AND level IS NOT NULL AS rechecks
      FROM (
        SELECT *, CASE WHEN again THEN NULL WHEN word = 'R' THEN 'alert' WHEN word = 'L' THEN 'info' END AS level,
          CASE WHEN again OR word = 'H' THEN NULL WHEN word = 'L' THEN 'none' WHEN code1 = 'clear:part' THEN 'clear-partial' WHEN code1 LIKE 'clear:%' THEN 'clear' WHEN code1 LIKE 'declared:%' THEN 'alert' ELSE tone0 END AS tone,
          CASE WHEN again THEN 'already-notified:line' ELSE code1 END AS code
        FROM (
          SELECT *, concat(code1, '|', coalesce(eff, ''), '|', coalesce(place, ''), '|', scope) AS line,
            coalesce(word = 'L' AND has_ep AND ts_s - lines[concat(code1, '|', coalesce(eff, ''), '|', coalesce(place, ''), '|', scope)] BETWEEN 0 AND 60, false) AS again
          FROM (
            SELECT *, CASE WHEN rule[1] = 'R' AND tone1 = 'ballistic' AND buried THEN 'H' WHEN rule[1] = 'R' AND hushed THEN 'L' ELSE rule[1] END AS word,
              CASE WHEN rule[1] = 'R' AND tone1 = 'ballistic' AND buried THEN 'veto:buried' WHEN rule[1] = 'R' AND hushed THEN rule[3:] || ':quiet' ELSE rule[3:] END AS code1
            FROM (
              SELECT *, quiet AND coalesce(eff NOT IN ('ballistic', 'carrier'), true) AS hushed,
                CASE WHEN rule LIKE 'R clear:%' OR rule LIKE 'R declared:%' THEN '' ELSE tone0 END AS tone1
              FROM (
                SELECT *, {CASCADE} AS rule FROM (
                  SELECT *, state <> 'clear' AND NOT aftermath AND NOT summary AND NOT other AS alive0,
                    coalesce(says_new AND (launch_at IS NULL OR ts_s - launch_at > 240), false) AS fresh,
                    sent = 0 OR cnt > peak OR (says_new AND (scope <= 1 OR nationwide)) OR (
                      coalesce(ts_s - rang >= CASE WHEN scope <= 1 THEN 300 ELSE 1200 END, true) AND place IS NOT NULL AND coalesce(ts_s - seen[place] > 600, true)) AS novel,
                    has_ep AND ((says_launch AND (unseen OR (after_recheck AND in_city)))
                      OR (NOT inherited AND (launch_site OR in_city) AND (after_recheck OR (unseen AND NOT recheck)))) AS first_launch
                  FROM (
                    SELECT *, {RANK.format('eff')} AS erank, CASE eff WHEN 'jet' THEN 'drone-jet' ELSE coalesce(eff, 'drone') END AS tone0,
                      coalesce(list_max(list_transform(air, lambda c: {RANK.format('c')})), 0) AS highest, NOT coalesce(list_contains(launched, eff), false) AS unseen,
                      coalesce(has_ep AND ts_s > recheck_at, false) AS after_recheck, scope IN (0, 1, 2, 9) AS in_city, accepted AND NOT official AND has_official AS fallback
                    FROM (
                      SELECT *, coalesce(cls, CASE WHEN NOT (state = 'alert' AND ts_s - cls_at > 600) THEN e_cls END) AS eff,
                        cls IS NULL AND e_cls IS NOT NULL AND NOT (state = 'alert' AND ts_s - cls_at > 600) AS inherited
                      FROM (
                        SELECT x.*, s.said_clear, s.home_said, s.home_rang, s.has_ep AND x.ts_s - s.live_at <= 2700 AS has_ep,
                          {_blank_unless('s.has_ep AND x.ts_s - s.live_at <= 2700', 's.')}
                        FROM r s JOIN lined x ON {same} AND x.part = s.part AND x.i = s.i + 1)))))))))))),
decided AS (SELECT {ks}, ts_s, channel, message_id, level, tone, code AS reason, CASE WHEN NOT has_ep THEN 'quiet' WHEN announced THEN 'alert' ELSE 'watching' END AS sky,
  eff AS effective, CASE WHEN has_ep THEN live_at END AS alive_s,
  CASE WHEN has_ep THEN struct_pack(opened, declared, e_cls, air, gone, rechecked, launched, recheck_of, lifted_of) END AS held FROM r WHERE i > 0)"""


def folded(body: str, keys: tuple[str, ...] = ("recipient",), among: str = "") -> str:
    return "WITH RECURSIVE " + fold(list(keys), among) + "\n" + body

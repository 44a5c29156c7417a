"""C operators over the lines of documents, read with the demo pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups
from ..operators import classify as cl
from ..operators import entities as en
from ..session import spread
from .common import sql
from .demo_pack import FILLER, PACK, RULES, STRONG, TONES, rule_table
from .entity_jobs import FAR, NEAR, PLACE, dictionary
from .registry import query, table
from .text_columns import sq_flatten, sq_squeeze

KEY = ["doc_id", "line"]


def lines(spark, d):
    """Every line of every document as a short message."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


LINES = "lines AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"
MENTIONS = f"""ws AS (SELECT doc_id, line, string_split_regex({sq_flatten('text')}, '[ \\-]+') AS ws FROM lines),
t1 AS (SELECT doc_id, line, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS k FROM ws),
hw AS (SELECT w, place.* FROM (SELECT DISTINCT w FROM t1) JOIN place ON starts_with(w, string_split(stem, ' ')[1])),
matches AS (
  SELECT doc_id, line, k AS s, k + len(p) AS e, length(stem) AS len, name, tier, landmark, origin, ambiguous
  FROM (SELECT *, string_split(stem, ' ') AS p FROM hw) JOIN t1 USING (w) JOIN ws USING (doc_id, line)
  WHERE k + len(p) <= len(ws) AND list_slice(ws, k + 1, k + len(p) - 1) = list_slice(p, 1, -2)
    AND CASE WHEN exact THEN ws[k + len(p)] = p[-1] ELSE starts_with(ws[k + len(p)], p[-1]) END),
c0 AS (SELECT doc_id, line, list({{'s': s, 'e': e, 'name': name, 'tier': tier, 'landmark': landmark, 'origin': origin, 'ambiguous': ambiguous}} ORDER BY len DESC, s, name) AS c FROM matches GROUP BY 1, 2),
m0 AS (SELECT doc_id, line, list_reduce(list_transform(c, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda t: x[1].s < t.e AND x[1].e > t.s)) > 0 THEN a ELSE list_concat(a, x) END) AS mentions FROM c0),
sp AS (SELECT doc_id, line, unnest(mentions, recursive := true) FROM m0),
o AS (SELECT DISTINCT doc_id, line, unnest(range(s, e)) AS k FROM sp),
left_over AS (SELECT t.doc_id, t.line, coalesce(sum(length(w)) FILTER (WHERE o.k IS NULL AND w NOT IN ('the', 'of', 'and', 'to', 'in')), 0) AS residue
   FROM t1 t LEFT JOIN o ON o.doc_id = t.doc_id AND o.line = t.line AND o.k = t.k GROUP BY 1, 2),
m AS (SELECT l.doc_id, l.line, l.text, coalesce(mentions, []) AS mentions, residue FROM lines l LEFT JOIN m0 USING (doc_id, line) JOIN left_over USING (doc_id, line))"""
TEXT = (LINES,)
FULL = (PLACE, LINES, MENTIONS)


def mentioned_lines(spark, d):
    return en.with_mentions(lines(spark, d), KEY, "text", dictionary(spark, d))


# --- the same evaluation written in SQL ---------------------------------------


def one(fam):
    return "|".join(f"(?:{p})" for p, _ in RULES[fam])


def hit(fam, c="text"):
    return f"regexp_matches({c}, '{one(fam)}')"


def blanked(c, fam):
    for p, _ in RULES[fam]:
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    return c


def first(c, fam="class"):
    over = " ".join(f"WHEN regexp_matches({c}, '{p}') AND NOT {hit('override_veto', c)} THEN '{l}'" for p, l in RULES["override"])
    rest = " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{l}'" for p, l in RULES[fam])
    return f"CASE {over} {rest} ELSE 'none' END"


def stated(c):
    return first(blanked(c, "level"))


def hint(c):
    plain = blanked(c, "denied")
    return f"coalesce(nullif({stated(blanked(plain, 'conditional'))}, 'none'), {stated(plain)})"


def masked(c):
    p = one("level")
    return (f"array_to_string(list_transform(list_zip(string_split_regex({c}, '{p}'), regexp_extract_all({c}, '{p}')), "
            f"lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE repeat(' ', length(z[2])) END), '')")


CLEAR = "(contains(lower(text), 'with') OR contains(lower(text), 'avec'))"
AWAIT = f"({hit('awaiting')} AND NOT {hit('canonical')})"
OPINION = f"({hit('opinion')} AND NOT {hit('canonical')})"
TRACKED = f"(({hit('work_report')} AND NOT {hit('work_as_warning')}) OR {hit('gone')})"
PARTIAL = f"(NOT {AWAIT} AND NOT {OPINION} AND {CLEAR} AND {hint('text')} <> 'none')"
STATE = f"""CASE WHEN (({hit('awaiting')} OR {hit('opinion')} OR {hit('advice')} OR {hit('retracted')}
   OR ({hit('level')} AND {CLEAR} AND {first(masked('text'))} = 'none')) AND NOT {hit('canonical')}) OR {hit('forecast_phrase')} THEN NULL
   WHEN {CLEAR} THEN 'clear' WHEN {hit('alert')} THEN 'alert' END"""


def distances(src, c):
    """Rows (doc_id, line, dist, prio, label) of class words against the first clear word."""
    at = f"least(nullif(strpos(lower({c}), 'with'), 0), nullif(strpos(lower({c}), 'avec'), 0)) - 1"
    parts = []
    for i, (p, l) in enumerate(RULES["override"] + RULES["class"]):
        parts.append(f"""SELECT doc_id, line, abs(unnest(list_transform(range(1, len(regexp_extract_all({c}, '{p}')) + 1),
            lambda i: length(array_to_string(string_split_regex({c}, '{p}')[1:i], '')) + length(array_to_string(regexp_extract_all({c}, '{p}')[1:i - 1], '')))) - ({at})) AS dist,
            {i} AS prio, '{l}' AS label FROM {src} WHERE {at} IS NOT NULL""")
    return " UNION ALL ".join(parts)


PART = f"part AS (SELECT doc_id, line, text, {masked('text')} AS mtext, {PARTIAL} AS partial, {hint('text')} AS hint FROM lines)"
DIST = f"""dm AS ({distances('part', 'mtext')}), dp AS ({distances('part', 'text')}),
near AS (SELECT doc_id, line, arg_min(label, (dist, prio)) AS label FROM dm GROUP BY 1, 2),
lift AS (SELECT doc_id, line, arg_min(label, (dist, label)) AS lifted FROM dp GROUP BY 1, 2),
still AS (SELECT doc_id, line, arg_min(label, (dist, label)) FILTER (WHERE label <> lifted) AS label, any_value(lifted) AS lifted FROM dp JOIN lift USING (doc_id, line) GROUP BY 1, 2),
read AS (SELECT p.*, CASE WHEN partial THEN near.label END AS cleared, CASE WHEN partial AND s.lifted IS NOT NULL THEN coalesce(s.label, 'none') ELSE hint END AS active
  FROM part p LEFT JOIN near USING (doc_id, line) LEFT JOIN still s USING (doc_id, line))"""
SLACK = 20
SHAPES = f"""sh0 AS (SELECT doc_id, line, text, mentions, len(mentions) > 0 AS placed, list_filter([
  CASE WHEN regexp_matches({blanked('text', 'negated')}, '[0-9]+') THEN 'count-marker' END,
  CASE WHEN regexp_matches({blanked('text', 'negated')}, '{RULES['shape'][1][0]}') THEN 'launch' END,
  CASE WHEN regexp_matches({blanked('text', 'negated')}, '{RULES['shape'][2][0]}') THEN 'movement' END,
  CASE WHEN regexp_matches({blanked('text', 'negated')}, '{RULES['shape'][3][0]}') THEN 'phase-word' END,
  CASE WHEN regexp_matches({blanked('text', 'negated')}, '{RULES['shape'][4][0]}') AND len(mentions) > 0 THEN 'place-with-threat' END,
  CASE WHEN len(mentions) > 0 AND residue <= {SLACK} THEN 'bare-place-list' END,
  CASE WHEN {hit('marker')} AND len(mentions) > 0 THEN 'emoji-with-place' END,
  CASE WHEN {hit('beside')} AND len(mentions) > 0 THEN 'threat-with-place' END,
  CASE WHEN {hit('loud')} AND len(mentions) > 0 THEN 'loud-over-place' END], lambda x: x IS NOT NULL) AS f FROM m),
sh AS (SELECT *, CASE WHEN len(f) = 1 AND f[1] IN ('emoji-with-place', 'phase-word') AND length({sq_squeeze('text')}) > 150 THEN [] ELSE f END AS shapes FROM sh0)"""
STRENGTH = "CASE WHEN list_has_any(shapes, ['count-marker', 'launch', 'threat-with-place', 'place-with-threat', 'movement', 'bare-place-list']) THEN 'strong' WHEN len(shapes) > 0 THEN 'weak' ELSE 'none' END"
SOCIAL = "(contains(lower(text), 'the') OR contains(lower(text), 'anti') OR contains(lower(text), 'inan') OR contains(lower(text), 'ench'))"
SOCIALLY = f"({hit('social_opener')} OR (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'anti') AS INT) + CAST(contains(lower(text), 'inan') AS INT) + CAST(contains(lower(text), 'ench') AS INT)) >= 3)"


def sq_modality(hint_col):
    return f"""CASE WHEN {hit('summary')} OR {hit('outlook')} THEN 'summary-news' WHEN {hit('weather')} THEN 'non-threat' WHEN {hit('ours')} THEN 'non-threat'
  WHEN {hit('retracted')} THEN 'non-threat' WHEN {hit('promo')} THEN 'non-threat' WHEN {hit('impact')} THEN 'live-threat' WHEN {SOCIALLY} THEN 'non-threat'
  WHEN {SOCIAL} AND len(shapes) = 0 THEN 'non-threat' WHEN {hit('aftermath')} THEN 'aftermath' WHEN {hit('resolved')} OR {hit('lost')} THEN 'live-threat'
  WHEN len(shapes) > 0 THEN 'live-threat' WHEN {hint_col} <> 'none' THEN 'live-threat' ELSE 'non-threat' END"""


CERTAIN = f"""CASE WHEN {hit('lost')} OR {TRACKED} THEN 'lost' WHEN {hit('resolved')} THEN 'clear' WHEN {hit('impact')} AND NOT placed THEN 'lost'
  WHEN {hit('anticipated')} OR {hit('possible')} OR {hit('hedge')} THEN 'probable' ELSE 'confirmed' END"""


def _per_line(name, column, expr, ctes=TEXT, src="lines"):
    @query(name, sql(f"SELECT doc_id, line, {expr} AS out FROM {src}", *ctes))
    def run(spark, d):
        return lines(spark, d).select("doc_id", "line", column(F.col("text")).alias("out"))

    return run


_per_line("c01_first_match_class", lambda c: cl.first_match(c, PACK), first("text"))
_per_line("c02_without_denials", lambda c: cl.blank(c, PACK, "denied"), blanked("text", "denied"))
_per_line("c03_class_hint", lambda c: cl.class_hint(c, PACK), hint("text"))
_per_line("c04_all_match_set", lambda c: F.array_join(cl.all_labels(c, PACK, "kind"), ","),
          "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{l}' END" for p, l in RULES["kind"]) + ")")
_per_line("c05_nearest_to_marker", lambda c: cl.cleared_class(c, PACK), "cleared", (LINES, PART, DIST), "read")
_per_line("c06_active_class", lambda c: cl.active_class(c, PACK), "active", (LINES, PART, DIST), "read")
_per_line("c07_partial_clear", lambda c: cl.partial_clear(c, PACK), PARTIAL)
_per_line("c08_alert_state", lambda c: cl.alert_state(c, PACK), STATE)
_per_line("c09_level_mask", lambda c: cl.without_level(c, PACK), masked("text"))
_per_line("c10_siren_forecast", lambda c: cl.forecast(c, PACK), f"{hit('forecast')} AND NOT {hit('forecast_past')}")
ETA_AFTER, ETA_BEFORE = "(?:in|of) ([a-z]{2}) (?:and ([a-z]{2}) )?the", "on ([a-z]{2}) in"
_per_line("c10_forecast_eta", lambda c: cl.forecast_eta(c, ETA_AFTER, ETA_BEFORE, "min"), f"""
  CASE WHEN regexp_extract(text, '{ETA_AFTER}', 1) <> '' AND regexp_extract(text, '{ETA_AFTER}', 2) <> '' THEN regexp_extract(text, '{ETA_AFTER}', 1) || '–' || regexp_extract(text, '{ETA_AFTER}', 2) || ' min'
  WHEN regexp_extract(text, '{ETA_AFTER}', 1) <> '' THEN regexp_extract(text, '{ETA_AFTER}', 1) || ' min'
  WHEN regexp_extract(text, '{ETA_BEFORE}', 1) <> '' THEN regexp_extract(text, '{ETA_BEFORE}', 1) || ' min' END""")
_per_line("c11_recheck", lambda c: cl.recheck(c, PACK), f"{hit('recheck')} OR {TRACKED} OR {OPINION}")
_per_line("c11_reappeared", lambda c: cl.reappeared(c, PACK), hit("reappear"))
_per_line("c12_generic_only", lambda c: cl.generic_only(c, PACK), f"NOT {hit('specific')}")
_per_line("c15_marker_emoji", lambda c: cl.hits(c, PACK, "marker"), hit("marker"))
_per_line("c18_strongly_social", lambda c: cl.strongly_social(c, PACK), SOCIALLY)
_per_line("c20_says_new", lambda c: cl.says_new(c, PACK), f"regexp_matches({blanked('text', 'duration')}, '{one('novel')}') AND NOT {hit('ordinal')}")
_per_line("c21_term_hits", lambda c: cl.hits(c, PACK, "hedge"), hit("hedge"))
_per_line("c24_landed_word", lambda c: cl.landed_word(c, cl.hits(c, PACK, "impact"), PACK, "hit", "explosion"),
          f"CASE WHEN {hit('impact')} AND {hit('hit')} THEN 'hit' WHEN {hit('impact')} THEN 'explosion' END")


def _shapes(df):
    return df.withColumn("shapes", cl.live_shapes(F.col("text"), F.col("mentions"), PACK, FILLER, SLACK))


@query("c13_live_shapes", sql("SELECT doc_id, line, array_to_string(shapes, ',') AS shapes FROM sh", *FULL, SHAPES))
def c13(spark, d):
    return _shapes(mentioned_lines(spark, d)).select("doc_id", "line", F.array_join("shapes", ",").alias("shapes"))


@query("c14_live_strength", sql(f"SELECT doc_id, line, {STRENGTH} AS strength FROM sh", *FULL, SHAPES))
def c14(spark, d):
    return _shapes(mentioned_lines(spark, d)).select("doc_id", "line", cl.live_strength(F.col("shapes"), STRONG).alias("strength"))


@query("c16_modality", sql(f"SELECT doc_id, line, {sq_modality(hint('text'))} AS modality FROM sh", *FULL, SHAPES))
def c16(spark, d):
    return _shapes(mentioned_lines(spark, d)).select(
        "doc_id", "line", cl.modality(F.col("text"), F.size("shapes") > 0, cl.class_hint(F.col("text"), PACK), PACK).alias("modality"))


@query("c17_certainty", sql(f"SELECT doc_id, line, {CERTAIN} AS certainty FROM sh", *FULL, SHAPES))
def c17(spark, d):
    return mentioned_lines(spark, d).select("doc_id", "line", cl.certainty(F.col("text"), F.size("mentions") > 0, PACK).alias("certainty"))


@query("c19_buried_headline", sql(f"""
, f AS (SELECT doc_id, line, string_split(d.text, chr(10)) AS ls, length(d.text) AS n FROM documents d JOIN lines l USING (doc_id) WHERE line = 0),
h AS (SELECT doc_id, n, list_filter(ls, lambda x: trim(x) <> '')[1] AS head, list_position(ls, list_filter(ls, lambda x: trim(x) <> '')[1]) - 1 AS line FROM f)
SELECT doc_id, n > 140 AND NOT coalesce(length(head) <= 70 AND r.active = 'ballistic', false) AS buried FROM h LEFT JOIN read r USING (doc_id, line)""", LINES, PART, DIST))
def c19(spark, d):
    return table(spark, d, "documents").select("doc_id", cl.buried(F.col("text"), "ballistic", PACK).alias("buried"))


@query("c20_says_launch", sql(f"""
SELECT doc_id, line, {hit('launch')} AND len(list_filter(mentions, lambda x: x.tier <> 4)) = 0 AS out FROM m""", *FULL))
def c20b(spark, d):
    return mentioned_lines(spark, d).select("doc_id", "line", cl.says_launch(F.col("text"), F.col("mentions"), FAR, PACK).alias("out"))


@query("c22_suggest", sql(f"""
, j AS (SELECT sh.*, r.active, r.cleared, r.hint, {STATE.replace('text', 'sh.text')} AS alert_state FROM sh JOIN read r USING (doc_id, line)),
k AS (SELECT *, CASE WHEN active = 'none' AND (len(shapes) > 0 OR {hit('impact')}) THEN 'unknown' ELSE active END AS c1 FROM j),
l AS (SELECT *, CASE WHEN c1 = 'unknown' AND coalesce(alert_state = 'clear', false) THEN 'none' ELSE c1 END AS class FROM k)
SELECT doc_id, line, class, {STRENGTH} AS strength, alert_state, coalesce(alert_state, CASE class WHEN 'ballistic' THEN 'ballistic' WHEN 'cruise' THEN 'missile' WHEN 'jet' THEN 'drone-jet'
   WHEN 'drone' THEN 'drone' WHEN 'carrier' THEN 'carrier' WHEN 'none' THEN 'none' ELSE 'drone' END) AS tone, cleared, {sq_modality('hint')} AS modality, {CERTAIN} AS certainty, array_to_string(shapes, ',') AS shapes
FROM l""", *FULL, PART, DIST, SHAPES))
def c22(spark, d):
    pack = cl.Pack.from_rows(rule_table(spark))
    got = cl.classify(mentioned_lines(spark, d), "text", pack, TONES, STRONG, FILLER, FAR, NEAR, slack=SLACK)
    return got.select("doc_id", "line", "class", "strength", "alert_state", "tone", "cleared", "modality", "certainty",
                      F.array_join("shapes", ",").alias("shapes"))


@query("c23_delivery_route", """
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'quiet' WHEN user_id % 3 = 0 THEN CASE event_type WHEN 'error' THEN 'shelter' WHEN 'signup' THEN 'siren' WHEN 'view' THEN 'clear' ELSE 'near' END
  WHEN event_type = 'view' THEN 'clear' ELSE 'quiet' END AS route FROM events""")
def c23(spark, d):
    e = F.col("event_type")
    tone = F.when(e == "error", "ballistic").when(e == "signup", "alert").when(e == "view", "clear-partial").otherwise("drone")
    level = F.when(e == "purchase", F.lit(None)).when(F.col("user_id") % 3 == 0, "alert").otherwise("info")
    return table(spark, d, "events").select("event_id", lookups.delivery_route(level, tone).alias("route"))

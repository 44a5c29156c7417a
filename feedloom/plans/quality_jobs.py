"""Label operators over labels and documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import quality as q
from ..session import width
from .common import EPOCH0, FEED, ZONE, feed, sql
from .registry import query, table
from .relate_jobs import NIGHTLY

TONES = {"none": "none", "drone": "drone", "cruise": "cruise", "ballistic": "ballistic", "unknown": "drone"}


def label_rows(spark, d):
    """labels with documents as full label rows, flaws included."""
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    k, n, t = F.col("doc_id"), F.col("n_chars"), F.col("toxic")
    lab = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    ring = F.col("quality") == 1
    return j.select(
        F.concat(F.lit("L"), (k - F.when(k % 37 == 0, 1).otherwise(0)).cast("string")).alias("id"),
        F.concat(F.lit("n"), F.floor(k / 100).cast("string")).alias("night"),
        F.concat(F.when(k % 29 == 0, "gone").otherwise(F.col("source")), F.lit("/"), k.cast("string")).alias("anchor"),
        (EPOCH0 + k * 30).alias("at_s"),
        F.when(k % 41 == 0, "maybe").when(ring, "notify").otherwise("silent").alias("decision"),
        F.when(ring & (k % 31 != 0), F.when((t == 1) | (n > 2000), "alert").otherwise("info")).alias("level"),
        F.when(k % 23 != 0, F.when(F.col("lang") == "en", "drone").when(F.col("lang") == "fr", "clear").when(
            F.col("lang") == "de", "ballistic").otherwise("none")).alias("alarm"),
        F.when(~ring, F.when(n < 500, "insufficient").when(t == 1, "already-notified").otherwise("too-far")).alias("silent_reason"),
        lab(["none", "drone", "cruise", "ballistic", "unknown"]).alias("threat"),
        lab(["live-threat", "live-threat", "aftermath", "non-threat"]).alias("modality"),
        lab(["city", "elsewhere", "near"]).alias("scope"), lab(["confirmed", "probable"]).alias("certainty"),
        lab(["toward", "away", "unknown", "position", "adrift"]).alias("heading"),
        F.when(k % 7 == 0, F.concat(F.lit("L"), F.when(k % 21 == 0, k + 5).otherwise(k - 5).cast("string"))).alias("repeat_of"),
        F.when(k % 19 == 0, "").otherwise(F.col("text")).alias("why"), (k % 3 == 0).alias("prefilled"), k.alias("doc_id"))


LABELS = f"""lab AS (SELECT 'L' || (k - CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END) AS id, 'n' || (k // 100) AS night, CASE WHEN k % 29 = 0 THEN 'gone' ELSE source END || '/' || k AS anchor,
  {EPOCH0} + k * 30 AS at_s, CASE WHEN k % 41 = 0 THEN 'maybe' WHEN quality = 1 THEN 'notify' ELSE 'silent' END AS decision,
  CASE WHEN quality = 1 AND k % 31 <> 0 THEN CASE WHEN toxic = 1 OR n_chars > 2000 THEN 'alert' ELSE 'info' END END AS level,
  CASE WHEN k % 23 <> 0 THEN CASE lang WHEN 'en' THEN 'drone' WHEN 'fr' THEN 'clear' WHEN 'de' THEN 'ballistic' ELSE 'none' END END AS alarm,
  CASE WHEN quality <> 1 THEN CASE WHEN n_chars < 500 THEN 'insufficient' WHEN toxic = 1 THEN 'already-notified' ELSE 'too-far' END END AS silent_reason,
  ['none', 'drone', 'cruise', 'ballistic', 'unknown'][k % 5 + 1] AS threat, ['live-threat', 'live-threat', 'aftermath', 'non-threat'][k % 4 + 1] AS modality,
  ['city', 'elsewhere', 'near'][k % 3 + 1] AS scope, ['confirmed', 'probable'][k % 2 + 1] AS certainty, ['toward', 'away', 'unknown', 'position', 'adrift'][k % 5 + 1] AS heading,
  CASE WHEN k % 7 = 0 THEN 'L' || CASE WHEN k % 21 = 0 THEN k + 5 ELSE k - 5 END END AS repeat_of, CASE WHEN k % 19 = 0 THEN '' ELSE text END AS why, k % 3 = 0 AS prefilled, k AS doc_id
  FROM (SELECT *, doc_id AS k FROM labels JOIN documents USING (doc_id)))"""


def doc_decisions(spark, d):
    """What a simple policy decided on every document."""
    k, n = F.col("doc_id"), F.col("n_chars")
    return table(spark, d, "documents").select(
        F.concat_ws("/", "source", k.cast("string")).alias("anchor"), (EPOCH0 + k * 30).alias("ts_s"),
        F.concat(F.lit("n"), F.floor(k / 100).cast("string")).alias("night"),
        (n > 400).alias("notify"), F.when(n > 3000, "alert").when(n > 400, "info").alias("level"))


SQL_SCORED = f"""dec AS (SELECT source || '/' || doc_id AS anchor, {EPOCH0} + doc_id * 30 AS ts_s, 'n' || (doc_id // 100) AS night, n_chars > 400 AS notify,
   CASE WHEN n_chars > 3000 THEN 'alert' WHEN n_chars > 400 THEN 'info' END AS got FROM documents),
sc AS (SELECT d.*, l.decision, l.level AS want, EXISTS (SELECT 1 FROM dec r WHERE r.night = d.night AND r.got = 'alert' AND abs(r.ts_s - d.ts_s) <= 120) AS near FROM dec d LEFT JOIN lab l ON l.anchor = d.anchor),
scored AS (SELECT anchor, night, CASE WHEN decision IS NULL THEN CASE WHEN got = 'alert' THEN 'wake-unlabelled' END
  WHEN decision <> 'notify' THEN CASE WHEN coalesce(got = 'alert', false) THEN 'false-wake' ELSE 'ok-silent' END
  WHEN coalesce(want = 'alert', false) AND near THEN 'hit' WHEN NOT notify OR (got = 'info' AND want IS DISTINCT FROM 'info') THEN 'miss' ELSE 'hit' END AS kind FROM sc)"""


@query("j09_score", sql("SELECT anchor, night, kind FROM scored WHERE kind IS NOT NULL", LABELS, SQL_SCORED))
def j09(spark, d):
    return q.score(label_rows(spark, d), doc_decisions(spark, d))


@query("a13_score_tally", sql("""
SELECT night, count(*) FILTER (WHERE kind = 'hit') AS hit, count(*) FILTER (WHERE kind = 'miss') AS miss, count(*) FILTER (WHERE kind = 'under') AS under,
  count(*) FILTER (WHERE kind = 'false-wake') AS false_wake, count(*) FILTER (WHERE kind = 'ok-silent') AS ok_silent, count(*) FILTER (WHERE kind = 'wake-unlabelled') AS wake_unlabelled
FROM scored WHERE kind IS NOT NULL GROUP BY ROLLUP (night)""", LABELS, SQL_SCORED))
def a13(spark, d):
    return q.score_tally(q.score(label_rows(spark, d), doc_decisions(spark, d)))


@query("j10_prefill_new", sql("SELECT id, anchor FROM lab WHERE prefilled AND id NOT IN (SELECT id FROM lab WHERE NOT prefilled)", LABELS))
def j10(spark, d):
    rows = label_rows(spark, d)
    return q.prefill_new(rows.filter("prefilled"), rows.filter("NOT prefilled")).select("id", "anchor")


@query("f11_human_only", sql("""
, known AS (SELECT night, id FROM lab WHERE NOT prefilled AND doc_id < 700), rows AS (SELECT * FROM lab WHERE NOT prefilled OR doc_id < 300),
mine AS (SELECT * FROM rows WHERE NOT prefilled),
touched AS (SELECT night FROM mine WHERE (night, id) NOT IN (SELECT night, id FROM known) UNION SELECT night FROM known WHERE (night, id) NOT IN (SELECT night, id FROM mine)
  UNION SELECT night FROM rows WHERE prefilled)
SELECT id, night FROM mine WHERE night IN (SELECT night FROM touched)""", LABELS))
def f11(spark, d):
    rows = label_rows(spark, d)
    known = rows.filter("NOT prefilled AND doc_id < 700")
    return q.human_only(rows.filter("NOT prefilled OR doc_id < 300"), known).select("id", "night")


@query("j11_repeat_refs", sql("""
, t AS (SELECT id, arg_max({'at_s': at_s, 'night': night}, (at_s, night, anchor)) AS t FROM lab GROUP BY id)
SELECT l.id, anchor, repeat_of, CASE WHEN t.id IS NULL THEN 'missing' WHEN t.t.at_s >= l.at_s THEN 'not earlier' WHEN t.t.night <> l.night THEN 'other night' END AS problem
FROM lab l LEFT JOIN t ON t.id = l.repeat_of WHERE repeat_of IS NOT NULL AND (t.id IS NULL OR t.t.at_s >= l.at_s OR t.t.night <> l.night)""", LABELS))
def j11(spark, d):
    return q.ref_checks(label_rows(spark, d))


@query("j12_missing_anchors", sql("SELECT id, anchor FROM lab WHERE anchor NOT IN (SELECT source || '/' || doc_id FROM documents)", LABELS))
def j12(spark, d):
    m = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("anchor"))
    return q.missing_anchors(label_rows(spark, d), m).select("id", "anchor")


@query("j13_label_diff", sql("""
, b AS (SELECT 'D' || doc_id AS id, decision, level, threat FROM lab WHERE doc_id % 10 <> 0),
a AS (SELECT 'D' || doc_id AS id, decision, CASE WHEN scope = 'near' THEN 'alert' ELSE level END AS level, CASE WHEN certainty = 'probable' THEN NULL ELSE threat END AS threat FROM lab),
j AS (SELECT a.id, b.id IS NULL AS fresh, unnest(['decision', 'level', 'threat']) AS field, unnest([b.decision, b.level, b.threat]) AS old, unnest([a.decision, a.level, a.threat]) AS new FROM a LEFT JOIN b USING (id))
SELECT DISTINCT id, CASE WHEN fresh THEN '+' ELSE field END AS field, CASE WHEN fresh THEN NULL ELSE old END AS old, CASE WHEN fresh THEN NULL ELSE new END AS new FROM j WHERE fresh OR old IS DISTINCT FROM new""", LABELS))
def j13(spark, d):
    rows = label_rows(spark, d).withColumn("id", F.concat(F.lit("D"), F.col("doc_id").cast("string")))
    after = rows.withColumn("level", F.when(F.col("scope") == "near", "alert").otherwise(F.col("level"))).withColumn(
        "threat", F.when(F.col("certainty") != "probable", F.col("threat")))
    return q.label_diff(rows.filter("doc_id % 10 <> 0"), after, ["decision", "level", "threat"])


@query("j14_stale_derived", sql("""
SELECT id, l.anchor, scope AS stored, CASE WHEN n_chars % 3 = 0 THEN 'city' WHEN n_chars % 3 = 1 THEN 'elsewhere' ELSE 'near' END AS now
FROM lab l JOIN documents d ON l.anchor = d.source || '/' || d.doc_id WHERE scope <> CASE WHEN n_chars % 3 = 0 THEN 'city' WHEN n_chars % 3 = 1 THEN 'elsewhere' ELSE 'near' END""", LABELS))
def j14(spark, d):
    n = F.col("n_chars") % 3
    now = table(spark, d, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("anchor"),
        F.when(n == 0, "city").when(n == 1, "elsewhere").otherwise("near").alias("scope"))
    return q.stale_derived(label_rows(spark, d), now, "scope")


@query("j19_training_rows", sql("""
, two AS (SELECT anchor, at_s, threat FROM lab UNION ALL SELECT anchor, at_s + 1, 'later' FROM lab)
SELECT t.anchor, arg_min(threat, at_s) AS threat, any_value(md5(text)) AS text_md5 FROM two t JOIN documents d ON t.anchor = d.source || '/' || d.doc_id GROUP BY 1""", LABELS))
def j19(spark, d):
    rows = label_rows(spark, d).select("anchor", "at_s", "threat")
    two = rows.unionByName(rows.withColumn("at_s", F.col("at_s") + 1).withColumn("threat", F.lit("later")))
    m = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("anchor"), "text")
    return q.training_rows(two, m, ["at_s"]).select("anchor", "threat", F.md5("text").alias("text_md5"))


FIELDS = ["level", "alarm", "silent_reason", "threat", "scope", "certainty", "night"]


@query("a16_label_summary", sql(" UNION ALL ".join(
    f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM lab WHERE {f} IS NOT NULL GROUP BY 2" for f in FIELDS), LABELS))
def a16(spark, d):
    return q.label_summary(label_rows(spark, d), FIELDS)


@query("a17_split_decisions", sql("""
SELECT threat, scope, certainty, modality, heading, count(*) AS moments, count(DISTINCT {'d': decision, 'l': coalesce(level, '~'), 's': coalesce(silent_reason, '~')}) AS answers FROM lab
GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1 AND count(DISTINCT {'d': decision, 'l': coalesce(level, '~'), 's': coalesce(silent_reason, '~')}) > 1""", LABELS))
def a17(spark, d):
    return q.split_decisions(label_rows(spark, d), ["threat", "scope", "certainty", "modality", "heading"], ["decision", "level", "silent_reason"])


_RING = "decision = 'notify' AND NOT coalesce(alarm IN ('clear', 'clear-partial'), false)"
_TONE = "CASE threat WHEN 'none' THEN 'none' WHEN 'drone' THEN 'drone' WHEN 'cruise' THEN 'cruise' WHEN 'ballistic' THEN 'ballistic' ELSE 'drone' END"
_CHECKS = [
    ("error", "dup > 1", "duplicate id"), ("error", "decision NOT IN ('notify', 'silent')", "unknown decision"),
    ("error", "heading NOT IN ('toward', 'away', 'loitering', 'position', 'unknown')", "unknown heading"),
    ("error", "decision = 'notify' AND level IS NULL", "notify without level"), ("error", "decision = 'notify' AND alarm IS NULL", "notify without alarm"),
    ("error", "decision = 'notify' AND coalesce(why, '') = ''", "notify without why"), ("error", "decision = 'silent' AND silent_reason IS NULL", "silent without reason"),
    ("warning", f"{_RING} AND scope = 'elsewhere'", "notify elsewhere"), ("warning", f"{_RING} AND threat = 'none' AND level IS DISTINCT FROM 'info'", "audible on nothing"),
    ("warning", f"{_RING} AND certainty = 'clear'", "tone on a clear"),
    ("warning", f"{_RING} AND alarm IS NOT NULL AND alarm <> 'alert' AND alarm <> {_TONE} AND NOT coalesce(level = 'info' AND alarm = 'none', false)", "tone of another class"),
    ("warning", f"{_RING} AND modality IN ('aftermath', 'summary-news', 'non-threat') AND level IS DISTINCT FROM 'info'", "audible on silent modality"),
]


@query("a18_label_checks", sql(", x AS (SELECT *, count(*) OVER (PARTITION BY id) AS dup FROM lab)\n" + " UNION ALL ".join(
    f"SELECT id, anchor, '{s}' AS severity, '{p}' AS problem FROM x WHERE {c}" for s, c, p in _CHECKS), LABELS))
def a18(spark, d):
    return q.check_labels(label_rows(spark, d), TONES)


PHRASES = {"too-far": ["the of", "de la"], "already-notified": ["that", "que"], "insufficient": ["and", "und"]}
WAKE = ["this", "with"]


@query("a19_note_contradictions", sql("""
, c AS (SELECT *, lower(why) AS w, modality IN ('aftermath', 'summary-news', 'non-threat') OR coalesce(silent_reason = 'too-far' AND scope IN ('elsewhere', 'oblast'), false) AS moot FROM lab WHERE decision = 'silent'),
s AS (SELECT id, anchor, silent_reason, CASE WHEN moot THEN NULL WHEN (contains(w, 'the of') OR contains(w, 'de la')) AND silent_reason IS DISTINCT FROM 'too-far' THEN 'too-far'
   WHEN (contains(w, 'that') OR contains(w, 'que')) AND silent_reason IS DISTINCT FROM 'already-notified' THEN 'already-notified'
   WHEN (contains(w, 'and') OR contains(w, 'und')) AND silent_reason IS DISTINCT FROM 'insufficient' THEN 'insufficient' END AS suggests, contains(w, 'this') OR contains(w, 'with') AS argues_for_ring FROM c)
SELECT * FROM s WHERE suggests IS NOT NULL OR argues_for_ring""", LABELS))
def a19(spark, d):
    return q.note_conflicts(label_rows(spark, d), PHRASES, WAKE)


def decided(spark, d):
    n = F.col("n")
    return feed(spark, d).select(
        "channel", "message_id", "ts", "ts_s", (n >= 60).alias("notify"), F.when(n >= 90, "alert").when((n >= 60) & (n < 80), "info").alias("level"),
        F.when(n >= 70, F.col("channel")).alias("alarm"), F.when(n % 2 == 0, "drone").otherwise("none").alias("cls"),
        F.when(n < 20, "too-far: not near").when(n < 40, "insufficient : threatened").when(n < 50, "summary").otherwise("spoken").alias("reason"))


@query("p23_prefill_labels", sql(f"""
, r AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M') AS minute FROM nightly),
s AS (SELECT *, row_number() OVER (PARTITION BY minute ORDER BY ts_s, message_id) AS seq FROM r)
SELECT minute || '-' || lpad(CAST(seq AS VARCHAR), 2, '0') AS id, night, channel || '/' || message_id AS anchor, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at,
  CASE WHEN n >= 60 THEN 'notify' ELSE 'silent' END AS decision, CASE WHEN n % 2 = 0 THEN 'drone' ELSE 'none' END AS threat,
  CASE WHEN n >= 90 THEN 'alert' WHEN n >= 60 THEN 'info' END AS level, CASE WHEN n >= 70 THEN channel WHEN n >= 60 THEN 'none' END AS alarm,
  CASE WHEN n < 20 THEN 'too-far' WHEN n < 40 THEN 'insufficient' END AS silent_reason, channel || ':' || message_id AS evidence,
  CASE WHEN n < 20 THEN 'too-far: not near' WHEN n < 40 THEN 'insufficient : threatened' WHEN n < 50 THEN 'summary' ELSE 'spoken' END AS why, true AS prefilled FROM s""", FEED, NIGHTLY))
def p23(spark, d):
    got = q.prefill_labels(decided(spark, d), clock.night_id(F.col("ts"), ZONE))
    ev = F.element_at("evidence", 1)
    return got.withColumn("evidence", F.concat_ws(":", ev["channel"], ev["message_id"].cast("string")))


@query("p24_fill_missing_tone", sql("""
SELECT doc_id, CASE WHEN decision = 'notify' THEN coalesce(nullif(alarm, ''), CASE threat WHEN 'none' THEN 'none' WHEN 'drone' THEN 'drone' WHEN 'cruise' THEN 'cruise' WHEN 'ballistic' THEN 'ballistic' ELSE 'drone' END) ELSE alarm END AS alarm FROM lab""", LABELS))
def p24(spark, d):
    return q.fill_tone(label_rows(spark, d), TONES).select("doc_id", "alarm")


# --- baseline classifier --------------------------------------------------------


def labelled(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.repartition(width(spark), "doc_id").select(
        "doc_id", "text", "n_chars", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("label"))


SQL_GRAMS = """rows AS (SELECT doc_id, text, n_chars, 'q' || quality || 't' || toxic AS label FROM labels JOIN documents USING (doc_id)),
folded AS (SELECT doc_id, label, n_chars, text, (row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1) % 5 AS fold FROM rows),
p AS (SELECT doc_id, label, fold, string_split(' ' || regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') || ' ', '') AS c FROM folded),
u AS (SELECT doc_id, label, fold, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM p),
l AS (SELECT doc_id, label, fold, x, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c, lead(x, 3) OVER w AS d, lead(x, 4) OVER w AS e FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, label, fold, gram, count(*) AS k FROM (SELECT doc_id, label, fold, x || b || c AS gram FROM l WHERE c IS NOT NULL UNION ALL SELECT doc_id, label, fold, x || b || c || d FROM l WHERE d IS NOT NULL
   UNION ALL SELECT doc_id, label, fold, x || b || c || d || e FROM l WHERE e IS NOT NULL) GROUP BY ALL)"""


@query("a20_naive_bayes", sql("""
, cnt AS (SELECT gram, label, CAST(sum(k) AS DOUBLE) AS c FROM g GROUP BY 1, 2),
cls AS (SELECT label, ln(count(*) / (SELECT count(*) FROM rows)) AS prior FROM rows GROUP BY 1),
den AS (SELECT label, ln(sum(c) + 0.2 * (SELECT count(DISTINCT gram) FROM cnt)) AS ld FROM cnt GROUP BY 1),
gain AS (SELECT doc_id, cnt.label AS y, sum(k * (ln(c + 0.2) - ln(0.2))) AS gain FROM g JOIN cnt USING (gram) GROUP BY 1, 2),
len AS (SELECT doc_id, sum(k) AS n FROM g GROUP BY 1),
s AS (SELECT len.doc_id, cls.label AS y, round(prior + coalesce(gain, 0) + n * (ln(0.2) - ld), 6) AS p FROM len CROSS JOIN cls JOIN den USING (label) LEFT JOIN gain ON gain.doc_id = len.doc_id AND gain.y = cls.label)
SELECT doc_id, arg_max(y, (p, y)) AS got FROM s GROUP BY 1""", SQL_GRAMS))
def a20(spark, d):
    rows = labelled(spark, d)
    return q.nb_predict(q.nb_fit(rows, "doc_id", "text", "label"), rows, "doc_id", "text")


@query("a21_kfold", sql("SELECT doc_id, fold FROM folded", SQL_GRAMS))
def a21(spark, d):
    return q.kfold(labelled(spark, d), "doc_id", 5, 7).select("doc_id", "fold")


SQL_CV = """bf AS (SELECT gram, label, fold, sum(k) AS c FROM g GROUP BY 1, 2, 3),
tr AS (SELECT f.fold, b.gram, b.label, CAST(sum(c) AS DOUBLE) AS c FROM (SELECT DISTINCT fold FROM folded) f JOIN bf b ON b.fold <> f.fold GROUP BY 1, 2, 3),
cls AS (SELECT f.fold, r.label, count(*) AS n FROM (SELECT DISTINCT fold FROM folded) f JOIN folded r ON r.fold <> f.fold GROUP BY 1, 2),
pri AS (SELECT fold, label, ln(n / sum(n) OVER (PARTITION BY fold)) AS prior FROM cls),
den AS (SELECT fold, label, ln(sum(c) + 0.2 * any_value(v)) AS ld FROM tr JOIN (SELECT fold, count(DISTINCT gram) AS v FROM tr GROUP BY 1) USING (fold) GROUP BY 1, 2),
gain AS (SELECT g.doc_id, tr.label AS y, sum(k * (ln(c + 0.2) - ln(0.2))) AS gain FROM g JOIN tr ON tr.gram = g.gram AND tr.fold = g.fold GROUP BY 1, 2),
len AS (SELECT doc_id, fold, label AS want, sum(k) AS n FROM g GROUP BY 1, 2, 3),
s AS (SELECT len.doc_id, want, pri.label AS y, round(prior + coalesce(gain, 0) + n * (ln(0.2) - ld), 6) AS p FROM len JOIN pri USING (fold) JOIN den ON den.fold = len.fold AND den.label = pri.label
   LEFT JOIN gain ON gain.doc_id = len.doc_id AND gain.y = pri.label),
pairs AS (SELECT doc_id, any_value(want) AS want, arg_max(y, (p, y)) AS got FROM s GROUP BY 1)"""
SQL_METRICS = """, ys AS (SELECT want AS y FROM pairs UNION SELECT got FROM pairs),
f AS (SELECT y, (SELECT count(*) FROM pairs WHERE want = y AND got = y) AS tp, (SELECT count(*) FROM pairs WHERE want <> y AND got = y) AS fp, (SELECT count(*) FROM pairs WHERE want = y AND got <> y) AS fn FROM ys)
SELECT (SELECT count(*) FROM pairs) AS n, (SELECT round(count(*) FILTER (WHERE want = got) / count(*), 6) FROM pairs) AS accuracy, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM f"""


def _crossval(spark, d):
    return q.nb_crossval(q.kfold(labelled(spark, d), "doc_id", 5, 7), "doc_id", "text", "label", "fold")


@query("a22_clf_metrics", sql(SQL_METRICS, SQL_GRAMS, SQL_CV))
def a22(spark, d):
    return q.clf_metrics(_crossval(spark, d))


@query("a22_confusion", sql("SELECT want, got, count(*) AS n FROM pairs GROUP BY 1, 2", SQL_GRAMS, SQL_CV))
def a22b(spark, d):
    return q.confusion(_crossval(spark, d))


def by_length(n: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A classifier a user brings along."""
    for s in n:
        yield s.map(lambda x: "q0t0" if x < 700 else "q1t0")


@query("x02_custom_classifier", sql(", pairs AS (SELECT label AS want, CASE WHEN n_chars < 700 THEN 'q0t0' ELSE 'q1t0' END AS got FROM rows)" + SQL_METRICS,
       "rows AS (SELECT n_chars, 'q' || quality || 't' || toxic AS label FROM labels JOIN documents USING (doc_id))"))
def x02(spark, d):
    return q.clf_metrics(labelled(spark, d).select(F.col("label").alias("want"), F.pandas_udf(by_length, "string")("n_chars").alias("got")))

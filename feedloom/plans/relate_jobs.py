"""J and W operators bound to conversations, documents, events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import joins, windows
from .common import EPOCH0, FEED, POSTS, ZONE, feed, posts, sql
from .registry import query, table
from .source_jobs import SQL_SETTINGS, two_settings

HOURS6 = 21600


def talk(spark, d):
    """conversations as messages; every third turn answers an earlier one (a fork)."""
    c = table(spark, d, "conversations")
    back = F.greatest(F.lit(0), F.col("turn") - 1 - (F.col("conv_id") + F.col("turn")) % 3)
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("channel"), F.col("turn").alias("message_id"),
        F.when(F.col("turn") > 0, back).alias("reply_to"), "text", "role")


TALK = """talk AS (SELECT 'c' || conv_id AS channel, turn AS message_id,
  CASE WHEN turn > 0 THEN greatest(0, turn - 1 - (conv_id + turn) % 3) END AS reply_to, text, role FROM conversations)"""
TREE = """RECURSIVE tree AS (
  SELECT channel, message_id, message_id AS root, 0 AS depth, [message_id] AS path FROM talk WHERE reply_to IS NULL
  UNION ALL SELECT t.channel, t.message_id, p.root, p.depth + 1, list_append(p.path, t.message_id)
  FROM talk t JOIN tree p ON t.channel = p.channel AND t.reply_to = p.message_id)"""


def tree_sql(body):
    return "WITH RECURSIVE " + TALK + ",\n" + TREE.replace("RECURSIVE ", "") + ",\n" + """
leaf AS (SELECT * FROM tree t WHERE NOT EXISTS (SELECT 1 FROM talk c WHERE c.channel = t.channel AND c.reply_to = t.message_id)),
chains AS (SELECT channel, root, (SELECT count(*) FROM tree x WHERE x.channel = l.channel AND x.root = l.root) AS messages,
  count(*) AS ends, max(depth) + 1 AS length, arg_min(message_id, (-depth, message_id)) AS deepest FROM leaf l GROUP BY channel, root)
""" + body


@query("j01_with_parent", sql("""
SELECT t.channel, t.message_id, t.reply_to, p.role AS parent_role, md5(p.text) AS parent_md5
FROM talk t LEFT JOIN talk p ON p.channel = t.channel AND p.message_id = t.reply_to WHERE t.reply_to IS NOT NULL""", TALK))
def j01(spark, d):
    return joins.with_parent(talk(spark, d), ["role", "text"]).select(
        "channel", "message_id", "reply_to", "parent_role", F.md5("parent_text").alias("parent_md5"))


@query("j02_reply_chains", tree_sql("SELECT channel, root, messages, ends, CAST(length AS BIGINT) AS length, deepest FROM chains WHERE messages > 1"))
def j02(spark, d):
    return joins.ReplyChains(talk(spark, d)).chains()


@query("j02_longest_paths", tree_sql("""
SELECT c.channel, c.root, unnest(path) AS message_id, CAST(generate_subscripts(path, 1) - 1 AS BIGINT) AS step
FROM chains c JOIN tree t ON t.channel = c.channel AND t.message_id = c.deepest WHERE messages > 1"""))
def j02b(spark, d):
    return joins.ReplyChains(talk(spark, d)).longest_paths()


SQL_PAIRS = """w AS (SELECT channel, message_id, ts_s, list_sort(list_distinct(list_filter(list_transform(
     regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*'), lambda x: lower(x)), lambda x: length(x) > 3))) AS words FROM posts),
s AS (SELECT * FROM w WHERE len(words) > 0),
inv AS (SELECT channel, message_id, ts_s, len(words) AS n, unnest(words) AS word FROM s),
c AS (SELECT a.channel AS first_channel, a.message_id AS first_id, b.channel AS second_channel, b.message_id AS second_id,
       b.ts_s - a.ts_s AS lag_s, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
  FROM inv a JOIN inv b ON a.word = b.word AND a.channel <> b.channel AND b.ts_s - a.ts_s <= 300 AND (a.ts_s, a.message_id) < (b.ts_s, b.message_id)
  GROUP BY 1, 2, 3, 4, 5),
pairs AS (SELECT * FROM c WHERE jaccard >= 0.5)"""


@query("j03_near_duplicates", sql("""
SELECT first_channel, first_id, second_channel, second_id, lag_s, round(jaccard, 6) AS jaccard, CAST(1 AS BIGINT) AS pairs FROM pairs""", POSTS, SQL_PAIRS))
def j03(spark, d):
    return joins.near_duplicates(posts(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


SQL_LEADS = f"""leads AS (SELECT m.message_id, m.who, m.ts_s, m.n, (SELECT min(t.ts_s) FROM feed t WHERE t.channel = 'view' AND t.who = m.who
   AND t.ts_s BETWEEN m.ts_s - {HOURS6} AND m.ts_s + {HOURS6}) AS their_ts FROM feed m WHERE m.channel = 'click')"""


def _leads(spark, d):
    f = feed(spark, d).select("channel", "message_id", "who", "ts_s", "n")
    return joins.lead_table(f.filter("channel = 'click'"), f.filter("channel = 'view'"), ["who"], ["message_id"], HOURS6)


@query("j04_lead_table", sql("SELECT message_id, who, their_ts, their_ts - ts_s AS lead_s FROM leads", FEED, SQL_LEADS))
def j04(spark, d):
    return _leads(spark, d).select("message_id", "who", "their_ts", "lead_s")


@query("j04_lead_any_key", sql("""
, k AS (SELECT channel, message_id, ts_s, unnest(list_distinct([who % 25, n % 25])) AS key FROM feed),
l AS (SELECT m.message_id, m.ts_s, min(t.ts_s) AS their_ts FROM k m LEFT JOIN k t ON t.channel = 'view' AND t.key = m.key
   AND t.ts_s BETWEEN m.ts_s - 3600 AND m.ts_s + 3600 WHERE m.channel = 'click' GROUP BY 1, 2)
SELECT message_id, their_ts, their_ts - ts_s AS lead_s FROM l""", FEED))
def j04b(spark, d):
    f = feed(spark, d).select(
        "channel", "message_id", "ts_s", F.array_distinct(F.array(F.col("who") % 25, F.col("n") % 25)).alias("keys"))
    return joins.lead_any_key(f.filter("channel = 'click'"), f.filter("channel = 'view'"), "keys", ["message_id"], 3600).select(
        "message_id", "their_ts", "lead_s")


@query("j05_alone", sql("SELECT message_id, who, ts_s FROM leads WHERE their_ts IS NULL", FEED, SQL_LEADS))
def j05(spark, d):
    return joins.alone(_leads(spark, d)).select("message_id", "who", "ts_s")




@query("j06_carry_context", sql("""
, t AS (SELECT *, sum(CASE WHEN channel = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY ts_s, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g,
   CASE WHEN channel IN ('error', 'view') THEN channel END AS cls, CASE WHEN n % 3 = 0 AND channel <> 'purchase' THEN CAST(n % 5 AS VARCHAR) END AS scp FROM feed),
c AS (SELECT *, last_value(CASE WHEN cls IS NOT NULL THEN {'at': ts_s, 'v': cls} END IGNORE NULLS) OVER (PARTITION BY coalesce(g, 0) ORDER BY ts_s, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc,
   last_value(CASE WHEN scp IS NOT NULL THEN {'at': ts_s, 'v': scp} END IGNORE NULLS) OVER (PARTITION BY coalesce(g, 0) ORDER BY ts_s, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM t)
SELECT message_id, CASE WHEN ts_s - pc.at <= 900 THEN pc.v END AS inherited_class, CASE WHEN ts_s - ps.at <= 900 THEN ps.v END AS inherited_scope FROM c
""", FEED))
def j06(spark, d):
    return joins.carry_context(
        feed(spark, d), ["ts_s", "message_id"], F.when(F.col("channel").isin("error", "view"), F.col("channel")),
        F.when(F.col("n") % 3 == 0, (F.col("n") % 5).cast("string")), F.col("channel") == "purchase").select(
        "message_id", "inherited_class", "inherited_scope")


def told(f):
    """Declarations and all-clears of the demo feed: sign-ups declare, purchases clear."""
    return f.withColumn("state", F.when(F.col("channel") == "signup", "alert").when(F.col("channel") == "purchase", "clear"))


SQL_SPANS = """told AS (SELECT *, CASE channel WHEN 'signup' THEN 'alert' WHEN 'purchase' THEN 'clear' END AS state FROM feed WHERE channel IN ('signup', 'purchase')),
turn AS (SELECT *, lag(state) OVER (ORDER BY ts_s, message_id) AS prev FROM told),
kept AS (SELECT *, lead(ts_s) OVER (ORDER BY ts_s, message_id) AS end_s FROM turn WHERE coalesce(prev, 'clear') <> state),
spans AS (SELECT ts_s AS start_s, end_s FROM kept WHERE state = 'alert')"""


def _spans(spark, d):
    return windows.alert_spans(told(feed(spark, d)), "state", ["ts_s", "message_id"])


@query("w01_alert_spans", sql("SELECT start_s, end_s FROM spans", FEED, SQL_SPANS))
def w01(spark, d):
    return _spans(spark, d)


@query("j07_point_in_interval", sql("""
SELECT e.message_id, EXISTS (SELECT 1 FROM spans s WHERE s.start_s <= e.ts_s AND (s.end_s IS NULL OR e.ts_s < s.end_s)) AS inside
FROM feed e WHERE channel = 'error'""", FEED, SQL_SPANS))
def j07(spark, d):
    e = feed(spark, d).filter("channel = 'error'")
    return joins.on_span(e, _spans(spark, d), ["message_id"]).select("message_id", "inside")


@query("j08_match_edges", sql("""
, edges AS (SELECT start_s AS ts_s, 's' || start_s AS ident FROM spans UNION ALL SELECT end_s, 'e' || end_s FROM spans WHERE end_s IS NOT NULL),
ours AS (SELECT ts_s, 'm' || message_id AS ident FROM feed WHERE channel = 'error' AND n >= 60)
SELECT ident, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE abs(e.ts_s - o.ts_s) <= 120) THEN 'both' ELSE 'only us' END AS kind FROM ours o
UNION ALL SELECT ident, 'only them' FROM edges e WHERE NOT EXISTS (SELECT 1 FROM ours o WHERE abs(e.ts_s - o.ts_s) <= 120)""", FEED, SQL_SPANS))
def j08(spark, d):
    spans = _spans(spark, d)
    edges = spans.select(F.col("start_s").alias("ts_s"), F.concat(F.lit("s"), "start_s").alias("ident")).unionByName(
        spans.filter("end_s IS NOT NULL").select(F.col("end_s").alias("ts_s"), F.concat(F.lit("e"), "end_s").alias("ident")))
    ours = feed(spark, d).filter("channel = 'error' AND n >= 60").select(
        "ts_s", F.concat(F.lit("m"), F.col("message_id").cast("string")).alias("ident"))
    return joins.match_edges(ours, edges)


@query("j16_recipient_changes", sql("""
SELECT c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (c_custkey) WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL
  OR a.c_nationkey IS DISTINCT FROM b.c_nationkey OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""", SQL_SETTINGS))
def j16(spark, d):
    a, b = two_settings(spark, d)
    return joins.snapshot_changes(a, b, "c_custkey", ["c_nationkey", "c_mktsegment", "bal"])


@query("j17_orphans", sql("""
SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM b)
  AND (SELECT count(*) FROM b WHERE c_custkey <> 0) > 0 GROUP BY 1""", SQL_SETTINGS))
def j17(spark, d):
    _, known = two_settings(spark, d)
    state = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return joins.orphans(state, known.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", 0)


@query("j18_ring_touch", sql("""
SELECT message_id FROM feed WHERE (who % 25) IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)
  OR (n % 25) IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""", FEED))
def j18(spark, d):
    f = feed(spark, d).withColumn("places", F.array(F.col("who") % 25, F.col("n") % 25))
    ring = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("place"))
    return joins.ring_touch(f, ring, "places").select("message_id")


# --- windows ----------------------------------------------------------------


@query("w02_last_declaration", sql("""
, t AS (SELECT who, ts_s, message_id, CASE channel WHEN 'signup' THEN 'alert' WHEN 'purchase' THEN 'clear' END AS state,
   channel = 'purchase' AND n % 3 = 0 AS partial, (SELECT max(ts_s) FROM feed) AS at_s FROM feed),
l AS (SELECT who, arg_max(state, (ts_s, message_id)) AS state, max(ts_s) AS ts_s FROM t
  WHERE state IS NOT NULL AND NOT partial AND ts_s >= at_s - 432000 GROUP BY who)
SELECT who, ts_s AS declared_s FROM l WHERE state = 'alert'""", FEED))
def w02(spark, d):
    f = told(feed(spark, d)).withColumn("partial", (F.col("channel") == "purchase") & (F.col("n") % 3 == 0))
    return windows.last_declaration(f, ["who"], f.agg(F.max("ts_s").alias("at_s")), 432000)


def nightly(spark, d):
    return feed(spark, d).withColumn("night", clock.night_id(F.col("ts"), ZONE))


NIGHTLY = f"""nightly AS (SELECT *, CAST(timezone('{ZONE}', timezone('UTC', ts)) - INTERVAL 15 HOUR AS DATE) AS night FROM feed)"""
O = ["ts_s", "message_id"]


@query("w03_link_repeats", sql("""
, g AS (SELECT *, n >= 80 AS rang, channel = 'purchase' AS clr, sum(CASE WHEN channel = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY night ORDER BY ts_s, message_id) AS grp FROM nightly),
r AS (SELECT *, last_value(CASE WHEN rang AND NOT clr THEN {'at': ts_s, 'id': message_id} END IGNORE NULLS)
   OVER (PARTITION BY night, grp ORDER BY ts_s, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM g)
SELECT message_id, CASE WHEN ts_s - p.at <= 3600 THEN p.id END AS repeat_of FROM r WHERE n < 40 AND NOT clr""", FEED, NIGHTLY))
def w03(spark, d):
    clear = F.col("channel") == "purchase"
    return windows.link_repeats(
        nightly(spark, d), ["night"], O, F.col("message_id"), F.col("n") >= 80, (F.col("n") < 40) & ~clear, clear
    ).select("message_id", "repeat_of")


@query("w04_earlier_exists", sql("""
SELECT message_id, coalesce(max(CASE WHEN n >= 95 THEN 1 ELSE 0 END) OVER (PARTITION BY night ORDER BY ts_s, message_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS has_earlier FROM nightly""", FEED, NIGHTLY))
def w04(spark, d):
    return windows.earlier_exists(nightly(spark, d), ["night"], O, F.col("n") >= 95, "has_earlier").select(
        "message_id", "has_earlier")


@query("w05_tone_change", sql("""
, p AS (SELECT *, last_value(CASE WHEN n >= 60 THEN channel END IGNORE NULLS) OVER (PARTITION BY night ORDER BY ts_s, message_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM nightly)
SELECT message_id, channel, previous FROM p WHERE n >= 60 AND value < 5 AND previous <> channel""", FEED, NIGHTLY))
def w05(spark, d):
    return windows.tone_changes(
        nightly(spark, d), ["night"], O, F.col("channel"), F.col("n") >= 60, F.col("value") < 5
    ).select("message_id", "channel", "previous")


@query("w06_seq_in_minute", sql("""
SELECT message_id, row_number() OVER (PARTITION BY ts_s // 900 ORDER BY ts_s, message_id) AS seq FROM feed""", FEED))
def w06(spark, d):
    return windows.seq_in(feed(spark, d).withColumn("slot", F.floor(F.col("ts_s") / 900)), ["slot"], O).select(
        "message_id", "seq")


@query("w07_first_per_key", sql("""
SELECT who, channel, arg_min(message_id, (ts_s, message_id)) AS message_id, min(ts_s) AS ts_s FROM feed GROUP BY 1, 2""", FEED))
def w07(spark, d):
    from ..sources.corpus import first_per_key
    return first_per_key(feed(spark, d).select("who", "channel", "message_id", "ts_s"), ["who", "channel"], O)


@query("w08_last_per_recipient", sql("""
SELECT who, arg_max(message_id, (ts_s, message_id)) AS message_id, max(ts_s) AS ts_s FROM feed WHERE n >= 50 GROUP BY 1""", FEED))
def w08(spark, d):
    from ..sources.corpus import last_per_key
    return last_per_key(feed(spark, d).filter("n >= 50").select("who", "message_id", "ts_s"), ["who"], O)


@query("w09_running_peak", sql("""
, g AS (SELECT *, sum(CASE WHEN n >= 90 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts_s, message_id) AS run FROM feed)
SELECT message_id, max(n) OVER (PARTITION BY channel, run ORDER BY ts_s, message_id) AS peak FROM g""", FEED))
def w09(spark, d):
    return windows.running_peak(feed(spark, d), ["channel"], O, F.col("n"), F.col("n") >= 90).select("message_id", "peak")


@query("w10_gap_stats", sql("""
, g AS (SELECT channel, ts_s - lag(ts_s) OVER (PARTITION BY channel ORDER BY ts_s, message_id) AS gap FROM feed)
SELECT channel, count(gap) AS n, max(gap) AS longest, round(count(*) FILTER (WHERE gap > 600) / count(gap), 6) AS over_share FROM g GROUP BY 1""", FEED))
def w10(spark, d):
    g = windows.gaps(feed(spark, d), ["channel"], O)
    return g.groupBy("channel").agg(
        F.count("gap_s").alias("n"), F.max("gap_s").alias("longest"),
        F.round(F.count_if(F.col("gap_s") > 600) / F.count("gap_s"), 6).alias("over_share"))


@query("w11_raid_start", sql("""
, l AS (SELECT who, ts_s AS at_s, message_id, CASE WHEN n % 4 = 0 THEN CASE WHEN n % 8 = 0 THEN 'alert' ELSE 'quiet' END END AS sky,
  CASE WHEN n % 16 = 0 THEN ts_s - n END AS since, CASE WHEN n % 3 = 0 THEN 'alert' END AS level, CASE WHEN channel = 'purchase' THEN 'clear' ELSE channel END AS alarm FROM feed),
r AS (SELECT who, arg_max({'at_s': at_s, 'sky': sky, 'since': since, 'level': level, 'alarm': alarm}, (at_s, message_id)) AS r FROM l WHERE sky IS NOT NULL OR level IS NOT NULL GROUP BY who)
SELECT who, CASE WHEN CASE WHEN r.sky IS NOT NULL THEN r.sky = 'alert' ELSE r.level = 'alert' AND r.alarm NOT IN ('clear', 'clear-partial') END
  THEN coalesce(r.since, r.at_s) END AS since FROM r""", FEED))
def w11(spark, d):
    n = F.col("n")
    log = feed(spark, d).select(
        "who", F.col("ts_s").alias("at_s"), "message_id",
        F.when(n % 4 == 0, F.when(n % 8 == 0, "alert").otherwise("quiet")).alias("sky"),
        F.when(n % 16 == 0, F.col("ts_s") - n).alias("since"), F.when(n % 3 == 0, "alert").alias("level"),
        F.when(F.col("channel") == "purchase", "clear").otherwise(F.col("channel")).alias("alarm"))
    return windows.raid_since(log, "who", ["at_s", "message_id"])

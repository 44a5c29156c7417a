"""A, K and U operators bound to events, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import joins, paging, reports, windows
from ..session import fresh_path
from .common import EPOCH0, FEED, POSTS, ZONE, feed, posts, sql
from .registry import query, table
from .relate_jobs import HOURS6, NIGHTLY, SQL_PAIRS, SQL_SPANS, nightly, talk, tree_sql, told
from .source_jobs import SQL_LOG, log_rows
from .text_columns import SQ_TOKEN


def dated_posts(spark, d):
    return posts(spark, d).withColumn("ts", clock.from_epoch(F.col("ts_s"))).withColumn(
        "reply_to", F.when(F.col("message_id") % 4 == 0, F.col("message_id") - 1))


DATED = """dated AS (SELECT *, make_timestamp(ts_s * 1000000) AS ts, CASE WHEN message_id % 4 = 0 THEN message_id - 1 END AS reply_to FROM posts)"""


@query("a01_channel_overview", sql("""
SELECT channel, count(*) AS messages, count(reply_to) AS replies, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day,
  list_sort(list(length(text)))[count(*) // 2 + 1] AS median_len, round(count(reply_to) * 100.0 / count(*), 4) AS reply_pct
FROM dated GROUP BY channel""", POSTS, DATED))
def a01(spark, d):
    return reports.channel_overview(dated_posts(spark, d))


@query("a02_channel_coverage", sql("""
SELECT channel, count(*) AS total, count(*) FILTER (WHERE text <> '') AS with_text, count(reply_to) AS replies,
  min(ts) AS first_seen, max(ts) AS last_seen FROM dated GROUP BY ROLLUP (channel)""", POSTS, DATED))
def a02(spark, d):
    return reports.coverage(dated_posts(spark, d))


SLOTS = {"of": "\\bof (\\p{Lu}\\p{L}+)", "the": "\\b[Tt]he (\\p{Lu}\\p{L}+)", "line": "\\n(\\p{Lu}\\p{L}+)"}


@query("a03_slot_fillers", sql("""
, h AS (SELECT 'of' AS slot, unnest(regexp_extract_all(text, '\\bof (\\p{Lu}\\p{L}+)', 1)) AS word FROM posts
  UNION ALL SELECT 'the', unnest(regexp_extract_all(text, '\\b[Tt]he (\\p{Lu}\\p{L}+)', 1)) FROM posts
  UNION ALL SELECT 'line', unnest(regexp_extract_all(text, '\\n(\\p{Lu}\\p{L}+)', 1)) FROM posts)
SELECT word, slot, count(*) AS n FROM h GROUP BY GROUPING SETS ((word, slot), (word))""", POSTS))
def a03(spark, d):
    return reports.slot_fillers(posts(spark, d), SLOTS)


@query("a04_inflection_families", sql(f"""
, w AS (SELECT unnest(regexp_extract_all(text, '{SQ_TOKEN}')) AS word FROM posts),
f AS (SELECT substr(lower(word), 1, 6) AS family, word, count(*) AS n FROM w WHERE regexp_matches(word, '^\\p{{Lu}}') AND length(word) > 3 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, word) AS rk FROM f)
SELECT family, CAST(sum(n) AS BIGINT) AS total, count(*) AS variants, string_agg(word, ' ' ORDER BY rk) FILTER (WHERE rk <= 6) AS forms
FROM r GROUP BY family HAVING sum(n) >= 5 AND count(*) >= 2""", POSTS))
def a04(spark, d):
    return reports.families(posts(spark, d))


TERMS = ["license", "copyright", "reserved", "example", "phone", "the", "qui", "und"]


@query("a05_term_frequency", sql(f"""
, t AS (SELECT message_id, ts_s, term FROM posts, (SELECT unnest({TERMS!r}) AS term) WHERE contains(lower(text), term)),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ts_s, message_id) AS rk FROM t)
SELECT term, count(*) AS n, string_agg(message_id, ',' ORDER BY rk) FILTER (WHERE rk <= 3) AS examples FROM r GROUP BY term""", POSTS))
def a05(spark, d):
    return reports.term_frequency(posts(spark, d), TERMS)


@query("a06_short_texts", sql("""
SELECT text, count(*) AS n FROM posts WHERE length(text) <= 60 AND text <> '' GROUP BY text""", POSTS))
def a06(spark, d):
    return reports.short_texts(posts(spark, d), 60)


def _chains(spark, d):
    return joins.ReplyChains(talk(spark, d))


@query("a07_chain_histogram", tree_sql("""
SELECT CAST(length AS BIGINT) AS length, count(*) AS roots, CAST(sum(messages - 1) AS BIGINT) AS replies FROM chains WHERE messages > 1 GROUP BY 1"""))
def a07(spark, d):
    return reports.chain_histogram(_chains(spark, d).chains())


@query("a08_resolved_endings", tree_sql("""
SELECT count(*) FILTER (WHERE role = 'assistant') AS resolved, count(*) AS ends, round(count(*) FILTER (WHERE role = 'assistant') / count(*), 6) AS share
FROM leaf JOIN talk USING (channel, message_id)"""))
def a08(spark, d):
    ends = _chains(spark, d).leaves().join(talk(spark, d).select("channel", "message_id", "role"), ["channel", "message_id"])
    return reports.resolved_share(ends, F.col("role") == "assistant")


FORMS = {"number": "[0-9]+", "version": "[0-9]+\\.[0-9]+", "mail": "[0-9]+@", "phone": "[0-9]{3}-[0-9]{4}"}


@query("a09_count_grammar", sql("""
, h AS (SELECT *, unnest(['number', 'version', 'mail', 'phone']) AS form, unnest([regexp_matches(text, '[0-9]+'), regexp_matches(text, '[0-9]+\\.[0-9]+'),
   regexp_matches(text, '[0-9]+@'), regexp_matches(text, '[0-9]{3}-[0-9]{4}')]) AS hit FROM posts)
SELECT form, count(*) AS n, arg_min(substr(replace(text, chr(10), ' / '), 1, 40), (ts_s, message_id)) AS example FROM h WHERE hit GROUP BY form""", POSTS))
def a09(spark, d):
    return reports.pattern_counts(posts(spark, d), FORMS)


@query("a10_duplicate_stats", sql("""
SELECT first_channel, second_channel, count(*) AS n, list_sort(list(lag_s))[count(*) // 2 + 1] AS median_s,
  list_sort(list(lag_s))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS p90_s, max(lag_s) AS max_s
FROM pairs GROUP BY GROUPING SETS ((first_channel, second_channel), ())""", POSTS, SQL_PAIRS))
def a10(spark, d):
    return reports.duplicate_stats(joins.near_duplicates(posts(spark, d)))


@query("a11_busiest_minutes", sql("""
SELECT ts_s // 60 AS minute, count(*) AS n FROM feed GROUP BY 1 ORDER BY n DESC, minute LIMIT 20""", FEED))
def a11(spark, d):
    return reports.busiest_minutes(feed(spark, d), 20)


@query("a11_hour_histogram", sql("""
, h AS (SELECT hour(ts) // 2 * 2 AS hour, count(*) AS n FROM feed GROUP BY 1)
SELECT CAST(i AS BIGINT) AS hour, coalesce(n, 0) AS n, CAST(round_even(coalesce(n, 0) * 40 / (SELECT max(n) FROM h), 0) AS BIGINT) AS bar
FROM range(24) t(i) LEFT JOIN h ON h.hour = i""", FEED))
def a11b(spark, d):
    return reports.hour_histogram(feed(spark, d), F.floor(F.hour("ts") / 2) * 2)  # odd hours stay empty


@query("a11_tumbling_minutes", sql("""
SELECT channel, time_bucket(INTERVAL '15 minutes', ts) AS start_ts, count(*) AS n FROM feed GROUP BY 1, 2""", FEED))
def a11c(spark, d):
    w = F.window(F.col("ts"), "15 minutes")
    return feed(spark, d).groupBy("channel", w.alias("w")).agg(F.count("*").alias("n")).select(
        "channel", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "n")


@query("a12_night_summary", sql("""
SELECT night, count(*) AS messages, count(*) FILTER (WHERE channel IN ('error', 'view')) AS relevant, count(*) FILTER (WHERE who < 20) AS near,
  count(*) FILTER (WHERE channel = 'signup') AS sirens, min(ts) AS first_ts, max(ts) AS last_ts FROM nightly GROUP BY night""", FEED, NIGHTLY))
def a12(spark, d):
    return reports.night_summary(feed(spark, d), clock.night_id(F.col("ts"), ZONE), {
        "relevant": F.col("channel").isin("error", "view"), "near": F.col("who") < 20, "sirens": F.col("channel") == "signup"})


@query("a14_lag_stats", sql("""
, l AS (SELECT channel, CAST(floor(value) AS BIGINT) AS lag FROM feed WHERE channel <> 'purchase')
SELECT channel, count(*) AS n, median(lag) AS median, list_sort(list(lag))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1] AS p90, max(lag) AS worst
FROM l GROUP BY channel""", FEED))
def a14(spark, d):
    f = feed(spark, d).filter("channel <> 'purchase'").withColumn("lag", F.floor("value").cast("long"))
    return reports.lag_stats(f, ["channel"], "lag")


@query("a15_log_report", sql("""
SELECT count(*) AS rows, count(*) FILTER (WHERE NOT warm) AS live, count(*) FILTER (WHERE warm) AS warm,
  count(*) FILTER (WHERE NOT warm AND notify AND level = 'alert') AS audible, count(*) FILTER (WHERE NOT warm AND notify AND level = 'info') AS shown,
  count(*) FILTER (WHERE NOT warm AND NOT notify) AS silent FROM log""", FEED, SQL_LOG))
def a15(spark, d):
    return reports.log_report(log_rows(spark, d))


@query("a23_source_scorecard", sql(f"""
, b AS (SELECT greatest(min(ts_s) FILTER (WHERE channel = 'view'), max(lo)) AS lo, least(max(ts_s) FILTER (WHERE channel = 'view'), min(hi)) AS hi
  FROM feed, (SELECT min(ts_s) AS lo, max(ts_s) AS hi FROM feed WHERE channel = 'click')),
mine AS (SELECT f.* FROM feed f, b WHERE channel = 'click' AND ts_s BETWEEN lo AND hi), theirs AS (SELECT f.* FROM feed f, b WHERE channel = 'view' AND ts_s BETWEEN lo AND hi),
l AS (SELECT m.*, (SELECT min(t.ts_s) FROM theirs t WHERE t.who = m.who AND t.ts_s BETWEEN m.ts_s - {HOURS6} AND m.ts_s + {HOURS6}) AS their_ts FROM mine m),
x AS (SELECT *, their_ts - ts_s AS lead FROM l)
SELECT channel, count(*) AS mentions, count(their_ts) AS matched, count(*) FILTER (WHERE lead > 0) AS first, count(*) FILTER (WHERE their_ts IS NULL) AS alone,
  max(lead) AS best_s, count(*) FILTER (WHERE n >= 30) AS class_known, count(*) FILTER (WHERE n < 30) AS unreadable,
  (max(ts_s) - min(ts_s)) // 86400 + 1 AS days,
  list_sort(list(lead) FILTER (WHERE lead IS NOT NULL))[count(lead) // 2 + 1] AS median_s,
  list_sort(list(lead) FILTER (WHERE lead IS NOT NULL))[CAST(floor(count(lead) * 0.9) AS BIGINT) + 1] AS p90_s,
  round(count(*) / ((max(ts_s) - min(ts_s)) // 86400 + 1), 4) AS per_day FROM x GROUP BY channel""", FEED))
def a23(spark, d):
    from ..operators.bands import clip_common
    f = feed(spark, d).select("channel", "message_id", "who", "ts_s", "n")
    mine, theirs = clip_common(f.filter("channel = 'click'"), f.filter("channel = 'view'"), "ts_s")
    return reports.source_scorecard(mine, theirs, HOURS6, F.col("n") >= 30)


@query("a24_freshness", sql("""
SELECT 1706745600 - max(ts_s) AS feed_age_s, 1706745600 - max(CASE WHEN warm THEN NULL ELSE ts_s END) AS log_age_s FROM log""".replace(
    "1706745600", "CAST(1706745600 AS BIGINT)"), FEED, SQL_LOG))
def a24(spark, d):
    log = log_rows(spark, d).filter("NOT warm").select(F.unix_seconds("at").alias("at_s"))
    return reports.freshness(feed(spark, d), log, F.lit(1706745600).cast("long"))


@query("a25_co_mention", sql("""
, p AS (SELECT message_id, who % 25 AS a, n % 25 AS b FROM feed),
o AS (SELECT CASE WHEN a = 7 THEN b ELSE a END AS place FROM p WHERE (a = 7) <> (b = 7))
SELECT 'NATION_' || place AS place, count(*) AS n FROM o GROUP BY 1""", FEED))
def a25(spark, d):
    places = feed(spark, d).select("channel", "message_id", F.explode(F.array(F.col("who") % 25, F.col("n") % 25)).alias("k"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("place"))
    return reports.co_mention(places.join(names, "k"), "NATION_7")


@query("a26_gap_to_live", sql("""
, t AS (SELECT *, last_value(CASE WHEN channel = 'error' THEN ts_s END IGNORE NULLS) OVER (ORDER BY ts_s, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live,
  CASE WHEN channel = 'purchase' THEN CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END END AS term FROM feed)
SELECT term, count(*) AS n, median(ts_s - live) AS median_gap_s, round(count(*) FILTER (WHERE ts_s - live <= 600) / count(*), 6) AS near_share
FROM t WHERE term IS NOT NULL AND live IS NOT NULL GROUP BY term""", FEED))
def a26(spark, d):
    term = F.when(F.col("channel") == "purchase", F.when(F.col("n") % 2 == 0, "even").otherwise("odd"))
    return reports.gap_to_live(feed(spark, d), ["ts_s", "message_id"], F.col("channel") == "error", term)


@query("a27_bells_per_night", sql("""
, b AS (SELECT night, count(*) FILTER (WHERE n >= 95) AS bells FROM nightly GROUP BY night)
SELECT count(*) AS nights, CAST(sum(bells) AS BIGINT) AS total, median(bells) AS median,
  list_sort(list(bells))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1] AS p90 FROM b""", FEED, NIGHTLY))
def a27(spark, d):
    return reports.bells_per_night(nightly(spark, d), "night", F.col("n") >= 95)


@query("s24_report_sink", sql("""
SELECT 'overview' AS section, channel AS name, count(*) AS n FROM posts GROUP BY channel
UNION ALL SELECT 'short', md5(text), count(*) FROM posts WHERE length(text) <= 60 GROUP BY text
UNION ALL SELECT 'hours', CAST(hour(ts) AS VARCHAR), count(*) FROM feed GROUP BY 2""", FEED, POSTS))
def s24(spark, d):
    p, f = posts(spark, d), feed(spark, d)
    sections = [
        ("overview", p.groupBy(F.col("channel").alias("name")).agg(F.count("*").alias("n"))),
        ("short", reports.short_texts(p, 60).select(F.md5("text").alias("name"), "n")),
        ("hours", f.groupBy(F.hour("ts").cast("string").alias("name")).agg(F.count("*").alias("n"))),
    ]
    path = fresh_path(spark, "report")
    for name, rows in sections:
        rows.withColumn("section", F.lit(name)).write.mode("append").partitionBy("section").parquet(path)
    return spark.read.parquet(path).select(F.col("section").cast("string").alias("section"), "name", "n")


@query("k01_total_order", sql("""
SELECT message_id, row_number() OVER (ORDER BY ts_s // 3600, channel = 'signup', channel, message_id) AS seq FROM feed""", FEED))
def k01(spark, d):
    from ..operators.scan import row_index, scan
    f = feed(spark, d).select("message_id", "channel", F.floor(F.col("ts_s") / 3600).alias("slot"), (F.col("channel") == "signup").cast("int").alias("last"))
    return scan(f, [], ["slot", "last", "channel", "message_id"], seq=row_index()).select("message_id", "seq")


# --- paging -------------------------------------------------------------------


@query("k02_newest_n_ascending", sql("""
SELECT message_id, channel, ts_s FROM feed WHERE ts_s >= 1706400000 ORDER BY ts_s DESC, channel DESC, message_id DESC LIMIT 40""", FEED))
def k02(spark, d):
    return paging.feed_back(feed(spark, d), F.lit(1706400000), 40).select("message_id", "channel", "ts_s")


@query("k02_newest_cursor", sql("""
SELECT ts_s || '.' || channel || '.' || message_id AS next FROM feed ORDER BY ts_s DESC, channel DESC, message_id DESC LIMIT 1""", FEED))
def k02b(spark, d):
    return paging.newest_cursor(feed(spark, d))


@query("k03_keyset_page", sql("""
SELECT message_id, channel, ts_s FROM feed WHERE (ts_s, channel, message_id) > (1705000000, 'error', 10) ORDER BY ts_s, channel, message_id LIMIT 100""", FEED))
def k03(spark, d):
    return paging.feed_since(feed(spark, d), (1705000000, "error", 10), 100).select("message_id", "channel", "ts_s")


@query("k04_decision_page", sql("""
SELECT anchor, ts_s AS at_s, text AS line FROM log WHERE who = '7' AND notify AND ts_s > 1704500000 ORDER BY ts_s, anchor LIMIT 10""", FEED, SQL_LOG))
def k04(spark, d):
    log = log_rows(spark, d).select("anchor", F.unix_seconds("at").alias("at_s"), "who", "notify", F.col("text").alias("line"))
    twice = log.unionByName(log)
    return paging.decision_page(twice, "7", F.col("notify"), 10, since=1704500000).select("anchor", "at_s", "line")


@query("k04_decision_tail", sql("""
SELECT anchor, ts_s AS at_s, text AS line FROM log WHERE who = '7' AND notify ORDER BY ts_s DESC, anchor DESC LIMIT 10""", FEED, SQL_LOG))
def k04b(spark, d):
    log = log_rows(spark, d).select("anchor", F.unix_seconds("at").alias("at_s"), "who", "notify", F.col("text").alias("line"))
    return paging.decision_page(log.unionByName(log), "7", F.col("notify"), 10).select("anchor", "at_s", "line")


@query("k05_most_common", sql("""
SELECT who, count(*) AS n FROM feed GROUP BY who ORDER BY n DESC, who LIMIT 10""", FEED))
def k05(spark, d):
    return paging.top_k(feed(spark, d), "who", 10)


RANKS = {"error": 5, "signup": 3, "purchase": 3, "view": 1}


@query("k06_worst_first", sql("""
, c AS (SELECT DISTINCT who, channel FROM feed)
SELECT who, string_agg(channel, ' ' ORDER BY CASE channel WHEN 'error' THEN 5 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 ELSE 0 END DESC, channel) AS worst
FROM c GROUP BY who""", FEED))
def k06(spark, d):
    s = feed(spark, d).groupBy("who").agg(F.collect_set("channel").alias("c"))
    return s.select("who", F.array_join(paging.worst_first(F.col("c"), RANKS), " ").alias("worst"))


@query("k07_last_three_lines", sql("""
, ep AS (SELECT who, max(ts_s) FILTER (WHERE channel = 'signup') AS opened_s, max(n) > 90 AS alert_on FROM feed GROUP BY who HAVING count(*) FILTER (WHERE channel = 'signup') > 0),
m AS (SELECT max(ts_s) AS now FROM feed),
s AS (SELECT f.who, ts_s AS at_s, channel || '/' || message_id AS anchor, CASE WHEN channel = 'purchase' THEN 'clear' ELSE channel END AS alarm FROM feed f),
j AS (SELECT s.* FROM s JOIN ep USING (who), m WHERE at_s >= opened_s OR (alarm = 'clear' AND NOT alert_on AND now - at_s <= 172800)),
r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY at_s DESC, anchor) AS rank FROM j)
SELECT who, at_s, anchor, rank FROM r WHERE rank <= 3""", FEED))
def k07(spark, d):
    f = feed(spark, d)
    ep = f.groupBy("who").agg(
        F.max(F.when(F.col("channel") == "signup", F.col("ts_s"))).alias("opened_s"),
        (F.max("n") > 90).alias("alert_on")).filter("opened_s IS NOT NULL")
    said = f.select("who", F.col("ts_s").alias("at_s"), clock.anchor(F.col("channel"), F.col("message_id")).alias("anchor"),
                    F.when(F.col("channel") == "purchase", "clear").otherwise(F.col("channel")).alias("alarm"))
    now = f.agg(F.max("ts_s").alias("now_s"))
    return paging.screen_lines(said, ep.crossJoin(F.broadcast(now)), "who", F.col("now_s"), clear_ttl_s=172800)


# --- sets ---------------------------------------------------------------------


@query("u01_union_feeds", sql("""
SELECT message_id, ts_s, n, CAST(NULL AS VARCHAR) AS lang FROM feed UNION ALL SELECT message_id, ts_s, NULL, lang FROM posts""", FEED, POSTS))
def u01(spark, d):
    return paging.union_feeds(
        feed(spark, d).select("message_id", "ts_s", "n"), posts(spark, d).select("message_id", "ts_s", "lang"))


SQL_SETS = """st AS (SELECT who, list_sort(list(DISTINCT channel) FILTER (WHERE n >= 90)) AS launched, list_sort(list(DISTINCT channel) FILTER (WHERE n % 10 = 0)) AS cleared,
  list_sort(list(DISTINCT channel) FILTER (WHERE n % 7 = 0)) AS rechecked, list_sort(list(DISTINCT channel) FILTER (WHERE ts_s > 1705500000)) AS fresh, arg_max(channel, (ts_s, message_id)) AS cls
  FROM feed GROUP BY who)"""


def _sets(spark, d):
    c = F.col("channel")
    return feed(spark, d).groupBy("who").agg(
        F.collect_set(F.when(F.col("n") >= 90, c)).alias("launched"), F.collect_set(F.when(F.col("n") % 10 == 0, c)).alias("cleared"),
        F.collect_set(F.when(F.col("n") % 7 == 0, c)).alias("rechecked"),
        F.collect_set(F.when(F.col("ts_s") > 1705500000, c)).alias("fresh"),
        F.max_by("channel", F.struct("ts_s", "message_id")).alias("cls"))


def _csv(c):
    return F.array_join(F.array_sort(c), ",")


def sq_csv(x):
    return f"coalesce(array_to_string(list_sort({x}), ','), '')"


def sq_e(x):
    return f"coalesce({x}, CAST([] AS VARCHAR[]))"


_BOTH = sq_csv(f"list_intersect({sq_e('launched')}, {sq_e('rechecked')})")


@query("u02_name_intersect", sql(f"SELECT who, {_BOTH} AS both FROM st", FEED, SQL_SETS))
def u02(spark, d):
    return _sets(spark, d).select("who", _csv(paging.common(F.col("launched"), F.col("rechecked"))).alias("both"))


_AIR = "list_filter(list_distinct(list_append({l}, cls)), lambda x: NOT list_contains({c}, x))".format(l=sq_e("launched"), c=sq_e("cleared"))


@query("u03_set_difference", sql(f"""
, a AS (SELECT *, {_AIR} AS air FROM st)
SELECT who, {sq_csv('air')} AS airborne, {sq_csv('list_filter(list_intersect(' + sq_e('rechecked') + ', ' + sq_e('fresh') + '), lambda x: NOT list_contains(' + sq_e('cleared') + ', x) AND NOT list_contains(air, x))')} AS recon FROM a""", FEED, SQL_SETS))
def u03(spark, d):
    air = paging.airborne(F.col("cls"), F.col("launched"), F.col("cleared"))
    s = _sets(spark, d).withColumn("air", air)
    return s.select("who", _csv(F.col("air")).alias("airborne"),
                    _csv(paging.recon(F.col("rechecked"), F.col("fresh"), F.col("cleared"), F.col("air"))).alias("recon"))


@query("u04_new_kinds", sql(f"""
SELECT who, len(list_filter({sq_e('rechecked')}, lambda x: NOT list_contains({sq_e('launched')}, x))) > 0 AS has_new FROM st""", FEED, SQL_SETS))
def u04(spark, d):
    return _sets(spark, d).select("who", paging.new_kinds(F.col("rechecked"), F.col("launched")).alias("has_new"))


@query("u05_already_said", sql("""
SELECT message_id FROM feed WHERE channel || '/' || message_id NOT IN (SELECT anchor FROM log WHERE notify AND NOT warm)""", FEED, SQL_LOG))
def u05(spark, d):
    f = feed(spark, d).select("message_id", clock.anchor(F.col("channel"), F.col("message_id")).alias("anchor"))
    return paging.not_yet_said(f, log_rows(spark, d).filter("notify AND NOT warm"), ["anchor"]).select("message_id")

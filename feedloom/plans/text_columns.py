"""P and F operators bound to documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, lookups, text
from ..operators.quality import gram_counts
from ..session import spread
from .common import FEED, POSTS, PROMO, ZONE, feed, posts, sql
from .registry import query, table

# --- SQL twins of the text columns -----------------------------------------


def sq_invisible(c):
    return (f"translate(regexp_replace({c}, '[\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'),"
            f" chr(160) || chr(8199) || chr(8239), '   ')")


def sq_apostrophes(c):
    return f"translate({c}, '’ʼ‘´`', '''''''''''')"


def sq_newlines(c):
    return f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')"


def sq_trim(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def sq_collapse(c):
    tidy = sq_trim("regexp_replace(x, '[ \\t]+', ' ', 'g')")
    return (f"array_to_string(list_filter(list_transform(string_split({sq_newlines(c)}, chr(10)),"
            f" lambda x: {tidy}), lambda x: x <> ''), chr(10))")


SQ_DECOR = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{2190}-\\x{21FF}\\x{FE0F}\\x{20E3}\\x{25AA}-\\x{25FF}]+"
SQ_PROMO = PROMO
SQ_PUNCT = "[\\s|/:,.!()\\[\\]\\\\–—•·-]+"


def sq_decor(c):
    return sq_trim(f"regexp_replace({c}, '{SQ_DECOR}', ' ', 'g')")


def sq_is_footer(x):
    left = f"regexp_replace({sq_decor(x)}, '{SQ_PROMO}', ' ', 'g')"
    return (f"(regexp_matches({x}, '{SQ_PROMO}') AND "
            f"length(regexp_replace({left}, '{SQ_PUNCT}', '', 'g')) <= 12)")


def sq_footer(c):
    split = f"string_split({c}, chr(10))"
    marks = (f"list_transform({split}, lambda x, i: CASE WHEN {sq_trim('x')} <> '' AND NOT {sq_is_footer('x')} THEN i ELSE 0 END)")
    return f"array_to_string({split}[1:list_max({marks})], chr(10))"


def sq_normalize(c):
    body = sq_newlines(sq_apostrophes(sq_invisible(f"coalesce({c}, '')")))
    return sq_collapse(sq_footer(body))


def sq_squeeze(c):
    return sq_trim(f"regexp_replace({c}, '\\s+', ' ', 'g')")


def sq_fingerprint(c):
    low = f"lower({sq_decor(sq_normalize(c))})"
    bare = f"regexp_replace(regexp_replace({low}, 'https?://\\S+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return sq_squeeze(bare)


def sq_flatten(c):
    return sq_squeeze(
        f"regexp_replace(lower(translate({c}, '’ʼ‘´`''', '')), '[^\\p{{L}}\\p{{N}}\\- ]+', ' ', 'g')")


SQ_TOKEN = "[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*"


def _each(name, column, expr):
    """One text column over whole documents, next to its SQL twin."""

    @query(name, f"SELECT doc_id, {expr} AS out FROM documents")
    def run(spark, d):
        return spread(table(spark, d, "documents").select("doc_id", "text")).select(
            "doc_id", column(F.col("text")).alias("out"))

    return run


_each("p01_clean_invisible", text.clean_invisible, sq_invisible("text"))
_each("p02_fold_apostrophes", text.fold_apostrophes, sq_apostrophes("text"))
_each("p03_collapse_lines", text.collapse_lines, sq_collapse("text"))
_each("p04_strip_footer", lambda c: text.strip_footer(c, PROMO), sq_footer("text"))
_each("p05_strip_decor", text.strip_decor, sq_decor("text"))
_each("p06_normalize_text", lambda c: text.normalize_text(c, PROMO), sq_normalize("text"))
_each("p07_fingerprint", lambda c: text.fingerprint(c, PROMO), sq_fingerprint("text"))
_each("p08_flatten", text.flatten, sq_flatten("text"))


@query("p09_tokens", f"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '{SQ_TOKEN}')) AS word FROM documents)
SELECT lang, count(*) AS n_tokens, count(*) FILTER (WHERE regexp_matches(word, '^\\p{{Lu}}')) AS n_capitalised,
       count(DISTINCT word) AS n_distinct FROM w GROUP BY lang""")
def p09(spark, d):
    w = spread(table(spark, d, "documents")).select(
        "lang", F.explode(text.tokens(F.col("text"))).alias("word"))
    per_word = w.groupBy("lang", "word").agg(F.count("*").alias("c"))
    return per_word.groupBy("lang").agg(
        F.sum("c").alias("n_tokens"),
        F.sum(F.when(text.is_capitalised(F.col("word")), F.col("c")).otherwise(0)).alias("n_capitalised"),
        F.count("*").alias("n_distinct"))


@query("p10_stem_key", f"""
WITH w AS (SELECT unnest(regexp_extract_all(text, '{SQ_TOKEN}')) AS word FROM documents)
SELECT substr(lower(word), 1, 6) AS family, count(*) AS n, count(DISTINCT word) AS forms
FROM w GROUP BY 1""")
def p10(spark, d):
    w = spread(table(spark, d, "documents")).select(F.explode(text.tokens(F.col("text"))).alias("word"))
    per_word = w.groupBy("word").agg(F.count("*").alias("c"))
    return per_word.groupBy(text.stem_key(F.col("word")).alias("family")).agg(
        F.sum("c").alias("n"), F.count("*").alias("forms"))


@query("p11_local_time", sql(f"""
SELECT message_id, timezone('{ZONE}', timezone('UTC', ts)) AS local_ts,
       CAST(timezone('{ZONE}', timezone('UTC', ts)) - INTERVAL 15 HOUR AS DATE) AS night,
       hour(timezone('{ZONE}', timezone('UTC', ts))) AS local_hour
FROM feed""", FEED))
def p11(spark, d):
    return feed(spark, d).select(
        "message_id",
        clock.local_time(F.col("ts"), ZONE).alias("local_ts"),
        clock.night_id(F.col("ts"), ZONE).alias("night"),
        clock.local_hour(F.col("ts"), ZONE).cast("long").alias("local_hour"))


@query("p11_night_id_dst", f"""
SELECT CAST(timezone('{ZONE}', timezone('UTC', o_orderdate)) - INTERVAL 15 HOUR AS DATE) AS night, count(*) AS n
FROM (SELECT o_orderdate + INTERVAL 12 HOUR AS o_orderdate FROM orders) GROUP BY 1""")
def p11_dst(spark, d):
    noon = F.timestamp_add("HOUR", F.lit(12), F.col("o_orderdate").cast("timestamp_ntz"))
    return table(spark, d, "orders").groupBy(clock.night_id(noon, ZONE).alias("night")).agg(
        F.count("*").alias("n"))


@query("p12_anchor", sql("""
SELECT message_id, channel || '/' || message_id AS anchor, channel AS back_channel, message_id AS back_id
FROM feed""", FEED))
def p12(spark, d):
    f = feed(spark, d).select("message_id", clock.anchor(F.col("channel"), F.col("message_id")).alias("anchor"))
    channel, mid = clock.split_anchor(F.col("anchor"))
    return f.select("message_id", "anchor", channel.alias("back_channel"), mid.alias("back_id"))


def _raw_cursor(n, ts_s, channel, mid):
    good = clock.cursor(ts_s, channel, mid)
    return F.when(n % 3 == 0, good).when(n % 3 == 1, F.concat(channel, F.lit("."), good)).otherwise(
        F.replace(good, F.lit("."), F.lit(":")))


@query("p13_cursor", sql("""
SELECT message_id,
       CASE WHEN n % 3 = 0 THEN ts_s || '.' || channel || '.' || message_id
            WHEN n % 3 = 1 THEN channel || '.' || ts_s || '.' || channel || '.' || message_id
            ELSE ts_s || ':' || channel || ':' || message_id END AS raw,
       CASE WHEN n % 3 = 0 THEN ts_s ELSE 0 END AS at,
       CASE WHEN n % 3 = 0 THEN channel ELSE '' END AS channel,
       CASE WHEN n % 3 = 0 THEN message_id ELSE 0 END AS id
FROM feed""", FEED))
def p13(spark, d):
    f = feed(spark, d).select(
        "message_id",
        _raw_cursor(F.col("n"), F.col("ts_s"), F.col("channel"), F.col("message_id")).alias("raw"))
    c = clock.parse_cursor(F.col("raw"))
    return f.select("message_id", "raw", c["ts"].alias("at"), c["channel"].alias("channel"), c["id"].alias("id"))


@query("p14_parse_window", sql("""
SELECT message_id, CASE channel WHEN 'view' THEN NULL ELSE
  least(greatest(n * CASE channel WHEN 'click' THEN 60 WHEN 'error' THEN 3600 ELSE 1 END, 60), 86400) END AS secs
FROM feed""", FEED))
def p14(spark, d):
    c, n = F.col("channel"), F.col("n").cast("string")
    raw = (F.when(c == "click", F.concat(n, F.lit("m"))).when(c == "error", F.concat(n, F.lit("H ")))
           .when(c == "signup", F.concat(n, F.lit("s"))).when(c == "view", F.concat(n, F.lit(" days")))
           .otherwise(n))
    return feed(spark, d).select("message_id", clock.parse_window(raw).alias("secs"))


@query("p15_state_version", sql("""
SELECT message_id, substr(sha256(to_json({'channel': channel, 'who': who, 'n': n})), 1, 16) AS version
FROM feed""", FEED))
def p15(spark, d):
    return feed(spark, d).select(
        "message_id", clock.version_of(F.struct("channel", "who", "n")).alias("version"))


LINE_LIMIT = 400


@query("p16_format_line", f"""
WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS sentence, text AS source,
                  doc_id % 3 = 0 AS audible, doc_id % 5 = 0 AS recheck,
                  CASE WHEN doc_id % 7 = 0 THEN '🔴 ' ELSE '' END AS frame FROM documents),
h AS (SELECT *, CASE WHEN audible THEN '🔔 ' || frame WHEN recheck THEN '📡 ' ELSE frame END || sentence AS head,
             '— ' || source AS tail FROM t)
SELECT doc_id, CASE WHEN source = '' OR contains(sentence, source) THEN head
  WHEN length(head || chr(10) || tail) <= {LINE_LIMIT} THEN head || chr(10) || tail
  ELSE head || chr(10) || regexp_replace(substr(tail, 1, greatest({LINE_LIMIT} - length(head) - 3, 0)), '\\s+$', '') || '…' END AS line
FROM h""")
def p16(spark, d):
    t = table(spark, d, "documents")
    sentence = F.element_at(F.split("text", "\n"), 1)
    frame = F.when(F.col("doc_id") % 7 == 0, F.lit("🔴 ")).otherwise(F.lit(""))
    return t.select("doc_id", text.format_line(
        sentence, F.col("text"), F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0, frame, LINE_LIMIT).alias("line"))


@query("p17_spell_duration", """
WITH t AS (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) % 9000 AS s FROM orders)
SELECT o_orderkey, s, CASE WHEN s // 3600 > 0 AND (s % 3600) // 60 > 0 THEN (s // 3600) || ' h ' || ((s % 3600) // 60) || ' min'
  WHEN s // 3600 > 0 THEN (s // 3600) || ' h' WHEN (s % 3600) // 60 > 0 THEN ((s % 3600) // 60) || ' min'
  ELSE s || ' s' END AS spelled FROM t""".replace("CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT)"))
def p17(spark, d):
    s = F.floor("o_totalprice").cast("long") % 9000
    return table(spark, d, "orders").select("o_orderkey", s.alias("s")).withColumn(
        "spelled", text.spell_duration(F.col("s")))


@query("p18_char_ngrams", """
WITH p AS (SELECT doc_id, lang, string_split(' ' || regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') || ' ', '') AS c FROM documents),
u AS (SELECT doc_id, lang, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM p),
l AS (SELECT lang, x, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c, lead(x, 3) OVER w AS d, lead(x, 4) OVER w AS e
      FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT lang, 3 AS size, x || b || c AS gram FROM l WHERE c IS NOT NULL
      UNION ALL SELECT lang, 4, x || b || c || d FROM l WHERE d IS NOT NULL
      UNION ALL SELECT lang, 5, x || b || c || d || e FROM l WHERE e IS NOT NULL),
c AS (SELECT lang, size, gram, count(*) AS n FROM g GROUP BY ALL)
SELECT lang, CAST(size AS BIGINT) AS size, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_grams, max(n) AS top_count
FROM c GROUP BY 1, 2""")
def p18(spark, d):
    c = gram_counts(spread(table(spark, d, "documents")), ["lang"], "text").withColumnRenamed("k", "n")
    return c.groupBy("lang", F.length("gram").cast("long").alias("size")).agg(
        F.count("*").alias("n_distinct"), F.sum("n").alias("n_grams"), F.max("n").alias("top_count"))


@query("p19_squeezed_preview", f"""
SELECT doc_id, length({sq_squeeze('text')}) AS squeezed, substr(replace(text, chr(10), ' / '), 1, 60) AS preview
FROM documents""")
def p19(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", text.squeezed_length(c).cast("long").alias("squeezed"), text.preview(c, 60).alias("preview"))


MASKED = "(?i)(?:released|licensed) under the [a-z ]*license"


@query("p20_mask_keep_offsets", f"""
SELECT doc_id, array_to_string(list_transform(list_zip(string_split_regex(text, '{MASKED}'), regexp_extract_all(text, '{MASKED}')),
   lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' ELSE repeat(' ', length(x[2])) END), '') AS out
FROM documents""")
def p20(spark, d):
    return table(spark, d, "documents").select("doc_id", text.mask(F.col("text"), MASKED).alias("out"))


CLASS_WORDS = {"click": "tap", "view": "look", "error": "fault", "signup": "newcomer"}
CLASS_WORDS_OF = {"click": "of taps", "view": "of looks", "error": "of faults", "signup": "of newcomers"}


@query("p21_class_words", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' WHEN 'error' THEN 'fault' WHEN 'signup' THEN 'newcomer' ELSE 'something' END AS word,
  CASE event_type WHEN 'click' THEN 'of taps' WHEN 'view' THEN 'of looks' WHEN 'error' THEN 'of faults' WHEN 'signup' THEN 'of newcomers' ELSE 'of things' END AS word_of
FROM events""")
def p21(spark, d):
    c = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id", lookups.word_for(c, CLASS_WORDS, "something").alias("word"),
        lookups.word_for(c, CLASS_WORDS_OF, "of things").alias("word_of"))


@query("p22_state_codec", sql("""
SELECT message_id, n AS k, 7 AS peak, channel AS state,
       CAST(to_json({'channel': channel, 'seen': list_sort(['a', channel])}) AS VARCHAR) AS encoded FROM feed""", FEED)
       .replace("7 AS peak", "CAST(7 AS BIGINT) AS peak"))
def p22(spark, d):
    e = table(spark, d, "events")
    got = lookups.decode_state(
        F.col("props"), "k LONG, peak LONG, state STRING",
        {"k": F.lit(0).cast("long"), "peak": F.lit(7).cast("long"), "state": F.col("event_type")})
    enc = lookups.encode_state(F.struct(
        F.col("event_type").alias("channel"),
        F.array_sort(F.array(F.lit("a"), F.col("event_type"))).alias("seen")))
    return e.select(F.col("event_id").alias("message_id"), got["k"].alias("k"), got["peak"].alias("peak"),
                    got["state"].alias("state"), enc.alias("encoded"))


# --- filters ----------------------------------------------------------------


@query("f01_has_content", sql("""
SELECT channel, count(*) AS n FROM posts WHERE coalesce(text, '') <> '' GROUP BY channel""", POSTS))
def f01(spark, d):
    return posts(spark, d).filter(F.coalesce("text", F.lit("")) != "").groupBy("channel").agg(
        F.count("*").alias("n"))


@query("f02_since", sql("""
SELECT message_id, ts FROM feed WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'""", FEED))
def f02(spark, d):
    return feed(spark, d).filter(F.col("ts") >= F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")).select(
        "message_id", "ts")


@query("f04_time_of_day", sql(f"""
SELECT message_id FROM (SELECT message_id, timezone('{ZONE}', timezone('UTC', ts)) AS l FROM feed)
WHERE CAST(l AS DATE) = DATE '2024-01-05' AND strftime(l, '%H:%M') BETWEEN '08:00' AND '19:30'""", FEED))
def f04(spark, d):
    local = clock.local_time(F.col("ts"), ZONE)
    hhmm = F.date_format(local, "HH:mm")
    return feed(spark, d).filter(
        (F.to_date(local) == F.lit("2024-01-05").cast("date")) & hhmm.between("08:00", "19:30")
    ).select("message_id")


@query("f05_quiet_hours", sql("""
SELECT message_id, CASE WHEN (who % 2 = 0) THEN true
  WHEN NOT (CASE WHEN who % 24 <= n % 24 THEN hour(ts) >= who % 24 AND hour(ts) < n % 24
            ELSE hour(ts) >= who % 24 OR hour(ts) < n % 24 END) THEN true
  ELSE channel IN ('error', 'signup') END AS sounds FROM feed""", FEED))
def f05(spark, d):
    return feed(spark, d).select("message_id", clock.sounds_at(
        F.hour("ts"), F.col("channel"), F.col("who") % 2 == 1,
        F.col("who") % 24, F.col("n") % 24, ["error", "signup"]).alias("sounds"))


@query("f06_common_window", sql("""
, b AS (SELECT greatest(min(ts_s) FILTER (channel = 'click'), min(ts_s) FILTER (channel = 'view')) AS lo,
             least(max(ts_s) FILTER (channel = 'click'), max(ts_s) FILTER (channel = 'view')) AS hi FROM feed)
SELECT message_id, channel FROM feed, b WHERE channel IN ('click', 'view') AND ts_s BETWEEN lo AND hi""", FEED))
def f06(spark, d):
    from ..operators.bands import clip_common
    f = feed(spark, d)
    a, b = clip_common(f.filter("channel = 'click'"), f.filter("channel = 'view'"), "ts_s")
    return a.unionByName(b).select("message_id", "channel")


@query("f07_horizon", sql("SELECT message_id, channel FROM feed WHERE ts_s >= (SELECT max(ts_s) FROM feed) - 5 * 86400", FEED))
def f07(spark, d):
    """Only files written lately are read, then only rows of the last days."""
    from ..session import fresh_path
    from ..sources.logs import newer_files, newer_rows
    path = fresh_path(spark, "kept")
    feed(spark, d).select("message_id", "channel", "ts_s").write.parquet(path)
    files = newer_files(spark.read.parquet(path), 2)
    return newer_rows(files, "ts_s", 5).select("message_id", "channel")


@query("f08_said_only_before_limit", sql("""
SELECT message_id, ts_s FROM feed WHERE channel = 'error' AND value > 50 ORDER BY ts_s DESC, message_id DESC LIMIT 50""", FEED))
def f08(spark, d):
    return (feed(spark, d).filter((F.col("channel") == "error") & (F.col("value") > 50))
            .orderBy(F.desc("ts_s"), F.desc("message_id")).limit(50).select("message_id", "ts_s"))


@query("f09_changed_only", """
SELECT doc_id, quality AS old, CASE WHEN n_chars > 300 THEN 1 END AS new FROM labels JOIN documents USING (doc_id)
WHERE quality IS DISTINCT FROM CASE WHEN n_chars > 300 THEN 1 END""")
def f09(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(
        "doc_id", F.col("quality").alias("old"), F.when(F.col("n_chars") > 300, 1).alias("new"))
    return j.filter(~F.col("old").eqNullSafe(F.col("new")))


@query("f10_ttl", sql("""
, s AS (SELECT who, channel, max(ts_s) AS last_at FROM feed GROUP BY ALL),
m AS (SELECT max(ts_s) AS now FROM feed)
SELECT who, count(*) FILTER (WHERE now - last_at <= 86400) AS fresh, count(*) AS held
FROM s, m GROUP BY who""", FEED))
def f10(spark, d):
    from ..streaming.state_views import fresh
    f = feed(spark, d)
    now = f.agg(F.max("ts_s").alias("now"))
    last = f.groupBy("who", "channel").agg(F.max("ts_s").alias("last_at"))
    # One entry per channel, so a state map stays as small as the channel list.
    state = last.groupBy("who").agg(
        F.map_from_entries(F.collect_list(F.struct("channel", "last_at"))).alias("held"))
    return state.crossJoin(F.broadcast(now)).select(
        "who", F.size(fresh(F.col("held"), F.col("now"), 86400)).cast("long").alias("fresh"),
        F.size("held").cast("long").alias("held"))


@query("f12_night_slice", sql(f"""
SELECT message_id, channel FROM feed
WHERE CAST(timezone('{ZONE}', timezone('UTC', ts)) - INTERVAL 15 HOUR AS DATE) = DATE '2024-01-10'""", FEED))
def f12(spark, d):
    return feed(spark, d).filter(
        clock.night_id(F.col("ts"), ZONE) == F.lit("2024-01-10").cast("date")).select("message_id", "channel")

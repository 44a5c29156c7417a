"""ST operators: users of the feed, and regions, as recipients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..session import fresh_path, settle, spread
from ..sources import corpus
from ..sources.logs import latest_state
from ..streaming import announce as an
from ..streaming import episodes as ep
from ..streaming import fold, herald, live, policy
from ..streaming import state_views as views
from .common import FEED, ZONE, feed, sql
from .fold_sql import RANK, STAYED, folded
from .herald_sql import WORDS as CLASS_WORDS
from .herald_sql import announced
from .registry import query, table

O = ["ts_s", "message_id"]
K = ["who"]
IDLE = 43200


def C():
    return F.col("channel")


def N():
    return F.col("n")


def closes():
    return (C() == "purchase") & (N() % 3 != 0)


def official():
    return C().isin("signup", "purchase") & (N() % 2 == 0)


def state():
    return F.when(C() == "signup", "alert").when(C() == "purchase", "clear")


WIN = "PARTITION BY who ORDER BY ts_s, message_id"
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SEG = f"""g0 AS (SELECT *, lag(channel = 'purchase' AND n % 3 <> 0) OVER w AS pc, ts_s - lag(ts_s) OVER w AS gap FROM feed WINDOW w AS ({WIN})),
seg AS (SELECT *, CAST(coalesce(sum(CASE WHEN coalesce(pc, false) THEN 1 ELSE 0 END) OVER ({WIN}), 0) + sum(CASE WHEN coalesce(gap, 0) > {IDLE} THEN 1 ELSE 0 END) OVER ({WIN}) AS BIGINT) AS segment FROM g0)"""


def seg(spark, d):
    return ep.segments(feed(spark, d), K, O, closes(), IDLE)


@query("st01_segments", sql("SELECT message_id, who, segment FROM seg", FEED, SEG))
def st01a(spark, d):
    return seg(spark, d).select("message_id", "who", "segment")


@query("st01_episode_session", sql(f"""
, l AS (SELECT *, channel IN ('error', 'signup') AS opens, channel = 'purchase' AND n % 3 <> 0 AS closes FROM feed WHERE channel IN ('error', 'signup') OR (channel = 'purchase' AND n % 3 <> 0)),
a AS (SELECT *, lag(closes) OVER w AS pc, ts_s - lag(ts_s) OVER w AS gap FROM l WINDOW w AS ({WIN})),
b AS (SELECT *, sum(CASE WHEN coalesce(pc, false) OR coalesce(gap, 0) > {IDLE} THEN 1 ELSE 0 END) OVER ({WIN}) AS s FROM a)
SELECT who, min(ts_s) AS opened_s, max(ts_s) AS last_live_s, count(*) AS rows FROM b WHERE opens GROUP BY who, s""", FEED))
def st01(spark, d):
    return ep.episodes(feed(spark, d), K, O, C().isin("error", "signup"), closes(), IDLE)


@query("st02_order_lateness", sql("""
, a AS (SELECT *, message_id + (n % 9) * 20 AS seq, channel = 'signup' AS official FROM feed),
b AS (SELECT *, greatest(coalesce(max(ts_s) OVER (ORDER BY seq, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ts_s, 0), 0) AS behind_s FROM a)
SELECT message_id, behind_s, CASE WHEN official THEN behind_s > 3600 ELSE behind_s > 0 END AS late FROM b""", FEED))
def st02(spark, d):
    f = feed(spark, d).withColumn("seq", F.col("message_id") + (N() % 9) * 20)
    return ep.lateness(f, [], ["seq", "message_id"], C() == "signup").select("message_id", "behind_s", "late")


SQL_AGE = f"""ag AS (SELECT *, channel IN ('signup', 'purchase') AND n % 2 = 0 AS official, CASE channel WHEN 'signup' THEN 'alert' WHEN 'purchase' THEN 'clear' END AS state,
  ts_s - last_value(CASE WHEN channel IN ('signup', 'purchase') AND n % 2 = 0 THEN ts_s END IGNORE NULLS) OVER ({WIN} {PRIOR}) AS age,
  bool_or(channel IN ('signup', 'purchase') AND n % 2 = 0) OVER (PARTITION BY who) AS has_official FROM feed)"""


def aged(spark, d):
    return ep.official_age(feed(spark, d), K, O, official())


@query("st03_source_precedence", sql("""
SELECT message_id, CASE WHEN state IS NULL THEN NULL WHEN official THEN 'declares' WHEN has_official THEN 'reports' ELSE 'declares' END AS role FROM ag""", FEED, SQL_AGE))
def st03(spark, d):
    return aged(spark, d).select("message_id", ep.precedence(state(), official(), F.col("has_official")).alias("role"))


@query("st04_stale_source_fallback", sql("""
SELECT message_id, coalesce(state = 'clear', false) AND n % 3 <> 0 AND (official OR NOT has_official OR (coalesce(age, 0) > 1800 AND n % 5 = 0 AND n % 7 <> 0)) AS accepted FROM ag""", FEED, SQL_AGE))
def st04(spark, d):
    return aged(spark, d).select("message_id", ep.clear_accepted(
        state(), N() % 3 == 0, official(), F.col("has_official"), F.col("official_age_s"), N() % 5 == 0, N() % 7 == 0).alias("accepted"))


@query("st05_declare_once", sql(f"""
, s AS (SELECT *, message_id % 4 <> 0 AS told, n % 2 = 0 AS expl FROM seg WHERE channel = 'signup'),
p AS (SELECT *, max(CAST(told AS INT)) OVER w AS a, max(CAST(told AND expl AS INT)) OVER w AS k FROM s WINDOW w AS (PARTITION BY who, segment ORDER BY ts_s, message_id {PRIOR}))
SELECT message_id, told AND (coalesce(a, 0) = 0 OR (expl AND coalesce(k, 0) = 0)) AS shown FROM p""", FEED, SEG))
def st05(spark, d):
    rows = seg(spark, d).withColumn("state", F.when(C() == "signup", "alert")).withColumn("is_reply", F.col("message_id") % 4 == 0)
    return ep.declare_once(rows, K, O, N() % 2 == 0).select("message_id", "shown")


@query("st06_clear_once", sql(f"""
, m AS (SELECT *, last_value(CASE channel WHEN 'purchase' THEN true WHEN 'signup' THEN false END IGNORE NULLS) OVER ({WIN} {PRIOR}) AS l FROM feed)
SELECT message_id, NOT coalesce(l, false) AS first FROM m WHERE channel = 'purchase'""", FEED))
def st06(spark, d):
    return ep.once_until(feed(spark, d), K, O, C() == "purchase", C() == "signup").select("message_id", "first")


@query("st07_partial_clear_once", sql(f"""
, c AS (SELECT *, n % 4 AS cls FROM feed),
m AS (SELECT *, last_value(CASE channel WHEN 'purchase' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER (PARTITION BY who, cls ORDER BY ts_s, message_id {PRIOR}) AS l FROM c)
SELECT message_id, cls, NOT coalesce(l, false) AS first FROM m WHERE channel = 'purchase'""", FEED))
def st07(spark, d):
    f = feed(spark, d).withColumn("cls", N() % 4)
    return ep.once_until(f, ["who", "cls"], O, C() == "purchase", C() == "error").select("message_id", "cls", "first")


@query("st08_class_inheritance", sql(f"""
, c AS (SELECT *, CASE WHEN channel = 'error' THEN CAST(n % 4 AS VARCHAR) END AS stated FROM seg),
l AS (SELECT *, last_value(CASE WHEN stated IS NOT NULL AND value > 5 THEN {{'at': ts_s, 'cls': stated}} END IGNORE NULLS) OVER (PARTITION BY who, segment ORDER BY ts_s, message_id {PRIOR}) AS was FROM c)
SELECT message_id, coalesce(stated, CASE WHEN NOT coalesce(channel = 'signup' AND ts_s - was.at > 7200, false) THEN was.cls END) AS effective,
  stated IS NULL AND CASE WHEN NOT coalesce(channel = 'signup' AND ts_s - was.at > 7200, false) THEN was.cls END IS NOT NULL AS inherited FROM l""", FEED, SEG))
def st08(spark, d):
    stated = F.when(C() == "error", (N() % 4).cast("string"))
    return ep.inherit_class(seg(spark, d), K, O, stated, F.col("value") > 5, C() == "signup", 7200).select(
        "message_id", "effective", "inherited")


LADDER = {"a": 1, "b": 2, "c": 3, "d": 5}
_air = ", ".join(
    f"last_value(CASE WHEN channel IN ('error', 'view') AND cls = '{k}' THEN true WHEN channel = 'purchase' AND lifted = '{k}' THEN false END IGNORE NULLS) OVER ({WIN} {PRIOR}) AS air_{k}" for k in LADDER)


@query("st09_escalation_ladder", sql(f"""
, c AS (SELECT *, ['a', 'b', 'c', 'd', 'e'][n % 5 + 1] AS cls, ['a', 'b', 'c', 'd', 'e'][(n + 1) % 5 + 1] AS lifted FROM feed),
r AS (SELECT *, {_air} FROM c),
p AS (SELECT *, greatest(0, CASE WHEN air_a THEN 1 ELSE 0 END, CASE WHEN air_b THEN 2 ELSE 0 END, CASE WHEN air_c THEN 3 ELSE 0 END, CASE WHEN air_d THEN 5 ELSE 0 END) AS peak FROM r)
SELECT message_id, peak, CASE cls WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 WHEN 'd' THEN 5 ELSE 0 END > peak AS climbs FROM p""", FEED))
def st09(spark, d):
    names = F.array(*[F.lit(x) for x in "abcde"])
    f = feed(spark, d).withColumn("cls", F.get(names, (N() % 5).cast("int"))).withColumn("lifted", F.get(names, ((N() + 1) % 5).cast("int")))
    lifted = F.when(C() == "purchase", F.col("lifted"))
    return ep.escalation(f, K, O, F.col("cls"), lifted, C().isin("error", "view"), LADDER).select("message_id", "peak", "climbs")


@query("st10_novelty", "WITH RECURSIVE " + sql(f"""
, rn AS (SELECT *, n // 10 AS cnt, n % 6 = 0 AS says_new, row_number() OVER (PARTITION BY who, segment ORDER BY ts_s, message_id) AS i FROM seg),
r AS (SELECT who, segment, i, message_id, true AS audible, ts_s AS rang, cnt AS peak FROM rn WHERE i = 1
  UNION ALL SELECT x.who, x.segment, x.i, x.message_id, x.cnt > r.peak OR (x.ts_s - r.rang >= 14400 AND x.says_new),
    CASE WHEN x.cnt > r.peak OR (x.ts_s - r.rang >= 14400 AND x.says_new) THEN x.ts_s ELSE r.rang END,
    CASE WHEN x.cnt > r.peak OR (x.ts_s - r.rang >= 14400 AND x.says_new) THEN x.cnt ELSE greatest(r.peak, x.cnt) END
  FROM rn x JOIN r ON x.who = r.who AND x.segment = r.segment AND x.i = r.i + 1)
SELECT message_id, audible FROM r""", FEED, SEG)[5:])
def st10(spark, d):
    rows = seg(spark, d).select("who", "segment", "ts_s", "message_id", F.floor(N() / 10).alias("count"), (N() % 6 == 0).alias("says_new"))
    return fold.novelty(rows, K, O, 14400, ["message_id"])


@query("st11_new_tone", sql("""
SELECT message_id, row_number() OVER (PARTITION BY who, segment, channel ORDER BY ts_s, message_id) = 1 AS is_new_tone FROM seg WHERE n >= 50""", FEED, SEG))
def st11(spark, d):
    return ep.new_tone(seg(spark, d).filter("n >= 50"), K, O, "channel").select("message_id", "is_new_tone")


@query("st12_launch_dedup", sql("""
, e AS (SELECT message_id, ts_s - lag(ts_s) OVER (ORDER BY ts_s, message_id) AS gap FROM feed WHERE n % 3 = 0)
SELECT message_id, gap IS NULL OR gap > 240 AS fresh FROM e""", FEED))
def st12(spark, d):
    return ep.fresh_event(feed(spark, d), [], O, N() % 3 == 0, 240).select("message_id", "fresh")


@query("st13_recheck_cycle", sql(f"""
, m AS (SELECT *, last_value(CASE channel WHEN 'view' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER (PARTITION BY who, n % 3 ORDER BY ts_s, message_id {PRIOR}) AS l FROM feed)
SELECT message_id, NOT coalesce(l, false) AS first FROM m WHERE channel = 'view'""", FEED))
def st13(spark, d):
    f = feed(spark, d).withColumn("kind", N() % 3)
    return ep.once_until(f, ["who", "kind"], O, C() == "view", C() == "error").select("message_id", "first")


@query("st14_wave_reopening", sql(f"""
, m AS (SELECT *, last_value(CASE WHEN channel = 'view' THEN true WHEN channel = 'error' AND n % 2 = 0 THEN false END IGNORE NULLS) OVER ({WIN} {PRIOR}) AS l FROM feed)
SELECT message_id FROM m WHERE channel = 'error' AND n % 2 = 0 AND coalesce(l, false)""", FEED))
def st14(spark, d):
    return ep.first_after(feed(spark, d), K, O, C() == "view", (C() == "error") & (N() % 2 == 0)).select("message_id")


def suppress_sql(keys, w, where="true"):
    on = " AND ".join(f"x.{k} = r.{k}" for k in keys)
    ks = ", ".join(keys)
    return "WITH RECURSIVE " + sql(f"""
, rn AS (SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY ts_s, message_id) AS i FROM feed WHERE {where}),
r AS (SELECT {ks}, i, message_id, true AS kept, ts_s AS last FROM rn WHERE i = 1
  UNION ALL SELECT {', '.join('x.' + k for k in keys)}, x.i, x.message_id, x.ts_s - r.last > {w}, CASE WHEN x.ts_s - r.last > {w} THEN x.ts_s ELSE r.last END FROM rn x JOIN r ON {on} AND x.i = r.i + 1)
SELECT message_id, kept FROM r""", FEED)[5:]


@query("st15_same_line_dedup", suppress_sql(["who", "channel"], 86400))
def st15(spark, d):
    return fold.suppress_within(feed(spark, d), ["who", "channel"], O, 86400, ["message_id"])


@query("st16_echo_dedup", suppress_sql(["who"], 21600, "channel = 'error'"))
def st16(spark, d):
    return fold.suppress_within(feed(spark, d).filter(C() == "error"), K, O, 21600, ["message_id"])


@query("st17_distance_ladder", sql(f"""
, t AS (SELECT *, n % 5 AS step, max(n % 5) OVER (PARTITION BY who, segment ORDER BY ts_s, message_id {PRIOR}) AS top FROM seg)
SELECT message_id, step FROM t WHERE step > coalesce(top, 0)""", FEED, SEG))
def st17(spark, d):
    return ep.distance_ladder(seg(spark, d), K, O, N() % 5).select("message_id", "step")


@query("st18_destination_follow_up", sql(f"""
, m AS (SELECT *, last_value(CASE WHEN channel = 'error' AND n % 3 = 0 THEN true WHEN channel = 'view' AND n > 50 THEN false END IGNORE NULLS) OVER (PARTITION BY who, segment ORDER BY ts_s, message_id {PRIOR}) AS l FROM seg)
SELECT message_id FROM m WHERE channel = 'view' AND n > 50 AND coalesce(l, false)""", FEED, SEG))
def st18(spark, d):
    return ep.first_after(seg(spark, d), ["who", "segment"], O, (C() == "error") & (N() % 3 == 0), (C() == "view") & (N() > 50)).select("message_id")


@query("st19_cause_follow_up", sql(f"""
, m AS (SELECT *, last_value(CASE WHEN channel = 'signup' THEN true WHEN channel IN ('error', 'click') THEN false END IGNORE NULLS) OVER (PARTITION BY who, segment ORDER BY ts_s, message_id {PRIOR}) AS l FROM seg)
SELECT message_id, channel FROM m WHERE channel IN ('error', 'click') AND coalesce(l, false)""", FEED, SEG))
def st19(spark, d):
    return ep.first_after(seg(spark, d), ["who", "segment"], O, C() == "signup", C().isin("error", "click")).select("message_id", "channel")


# --- the whole cascade: regions as recipients -----------------------------------


def scopes(spark, d):
    """How near each nation is to each region: (place, recipient, scope)."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name", "n_regionkey")
    away = F.pmod(F.col("r") - F.col("n_regionkey"), F.lit(5))
    return n.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "k", F.col("n_name").alias("place"), F.concat(F.lit("region"), F.col("r").cast("string")).alias("recipient"), "r",
        F.when(away == 0, F.when(F.col("k") % 3 == 0, policy.HOME).otherwise(policy.NEAR)).when(away == 1, policy.CITY)
        .when(away == 2, policy.OBLAST).otherwise(policy.FAR).alias("scope"))


def observe(f, spark, d):
    """Feed rows as observations of every recipient; works on a stream too."""
    who, n, c = F.col("who"), F.col("n"), F.col("channel")
    said = c.isin("signup", "purchase")
    pick = lambda names, x: F.get(F.array(*[F.lit(v) for v in names]), x.cast("int"))
    placed = f.join(scopes(spark, d), F.col("who") % 25 == F.col("k"))
    lost = who % 7 == 0
    scope = F.when(lost, policy.NOWHERE).otherwise(F.col("scope"))
    flag = lambda m: n % m == 0
    return placed.select(
        "recipient", "ts_s", "channel", "message_id", (said & flag(2)).alias("official"),
        F.when(c == "signup", "alert").when(c == "purchase", "clear").alias("state"),
        ((c == "purchase") & flag(3)).alias("partial"), flag(5).alias("canonical"),
        F.when((c == "purchase") & flag(3), pick(list(policy.CLASSES), who % 5)).alias("cleared"),
        F.when(~said, pick([*policy.CLASSES, None, None], (who + n) % 7)).alias("cls"), scope.alias("scope"),
        F.when(flag(13), "aftermath").when(flag(17), "summary-news").when(flag(19), "non-threat").otherwise("live-threat").alias("modality"),
        F.when(F.col("value") < 3, "probable").when(flag(23), "lost").otherwise("confirmed").alias("certainty"),
        pick(["none", "weak", "strong", "strong"], n % 4).alias("strength"), pick(["toward", "away", "loitering", "position"], who % 4).alias("heading"),
        ((c == "click") & flag(11)).alias("recheck"), flag(29).alias("reappeared"), flag(6).alias("says_new"), flag(9).alias("says_launch"),
        flag(31).alias("falling"), flag(37).alias("impact"), (F.col("message_id") % 4 == 0).alias("is_reply"), flag(43).alias("forecast"),
        (((who + n) % 7 == 4) & flag(3) & ~said).alias("nationwide"), (lost & flag(2)).alias("launch_site"), flag(47).alias("buried"),
        F.floor(n / 10).cast("int").alias("count"),
        F.when(scope <= policy.NEAR, F.array("place")).otherwise(F.array().cast("array<string>")).alias("places"),
        F.when(scope.isin(policy.CITY, policy.OBLAST), F.array("place")).alias("far_places"), F.when(flag(43), F.concat((n % 9 + 1).cast("string"), F.lit(" min"))).alias("eta"),
        (F.col("r") % 2 == 0).alias("quiet_hours"), F.lit(22).alias("quiet_from"), F.lit(7).alias("quiet_to"), F.hour("ts").alias("hour"))


def decisions(spark, d):
    return policy.replay(observe(spread(feed(spark, d)), spark, d))


@query("st20_decision_cascade", folded("SELECT recipient, level, reason, count(*) AS n FROM decided GROUP BY ALL"))
def st20(spark, d):
    return decisions(spark, d).groupBy("recipient", "level", "reason").agg(F.count("*").alias("n"))


DECIDED = ["recipient", "ts_s", "channel", "message_id", "level", "tone", "reason", "sky", "effective"]
EVERY_DECISION = folded(f"SELECT {', '.join(DECIDED)} FROM decided")


@query("st22_replay", EVERY_DECISION)
def st22(spark, d):
    return decisions(spark, d).select(*DECIDED)


@query("st22_replay_by_night", folded("""
SELECT night, recipient, count(*) AS rows, count(*) FILTER (WHERE level = 'alert') AS bells FROM decided GROUP BY night, recipient""", ("recipient", "night")))
def st22b(spark, d):
    f = spread(feed(spark, d))
    night = clock.night_id(clock.from_epoch(F.col("ts_s")), ZONE).cast("string")
    obs = observe(f, spark, d).withColumn("night", night)
    got = policy.replay(obs, ["recipient", "night"])
    return got.groupBy("night", "recipient").agg(F.count("*").alias("rows"), F.count_if("audible").alias("bells"))


@query("st32_sky", folded("SELECT recipient, sky, count(*) AS n FROM decided GROUP BY ALL"))
def st32(spark, d):
    return decisions(spark, d).groupBy("recipient", "sky").agg(F.count("*").alias("n"))


def event_stream(spark, d):
    """The events file as a stream, in the feed's columns."""
    raw = table(spark, d, "events").schema
    e = spark.readStream.schema(raw).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(
        F.col("event_type").alias("channel"), F.col("event_id").alias("message_id"), "ts", clock.epoch_s(F.col("ts")).alias("ts_s"),
        F.col("user_id").alias("who"), F.get_json_object("props", "$.k").cast("long").alias("n"), "value")


@query("st22_stream", EVERY_DECISION)
def st22c(spark, d):
    live.use_rocks(spark)
    out = live.decide_stream(observe(event_stream(spark, d), spark, d), has_official=True)
    return spark.read.parquet(live.run_once(out, "decisions")).select(*DECIDED)


# What each rule of the fold makes of its rows; the same rules as in the cascade, read from it.
RULES_OF = {
    "st07_partial_clears_decided": ("clear:part", "already-notified:lifted"),
    "st10_news_decided": ("near:new", "already-notified:near", "already-notified:home", "echo:home"),
    "st13_rechecks_decided": ("recheck:gone", "recheck:idle", "recheck:back", "already-notified:recheck"),
    "st14_waves_decided": ("launch:confirmed", "launch:home", "wave:here", "wave:site", "already-notified:wave"),
    "st17_steps_decided": ("approach:closer", "level:rose"),
    "st18_destinations_decided": ("launch:destination", "declared:cause"),
}


def _of_rules(name: str, codes: tuple[str, ...]) -> None:
    own = ", ".join(f"'{c}'" for c in codes)

    @query(name, folded(f"SELECT recipient, message_id, level, tone, reason FROM decided WHERE regexp_replace(reason, ':quiet$', '') IN ({own})"))
    def run(spark, d):
        rows = decisions(spark, d).filter(F.regexp_replace("reason", ":quiet$", "").isin(*codes))
        return rows.select("recipient", "message_id", "level", "tone", "reason")


for _name, _codes in RULES_OF.items():
    _of_rules(_name, _codes)


@query("st01_stream_idle_close", folded("""
SELECT recipient, alive_s + 2700 AS ts_s FROM (
  SELECT *, lead(ts_s) OVER (PARTITION BY recipient ORDER BY ts_s, channel IN ('signup', 'purchase') AND message_id IN (SELECT message_id FROM obs WHERE official), channel, message_id) AS next_s FROM decided)
WHERE coalesce(next_s, (SELECT max(ts_s) FROM obs)) - alive_s > 2700"""))
def st01c(spark, d):
    """Episodes that close because nothing is heard any more, by timers, in a stream."""
    live.use_rocks(spark)
    out = live.decide_stream(observe(event_stream(spark, d), spark, d), has_official=True, say_closed=True)
    return live.closed_rows(spark.read.parquet(live.run_once(out, "closed")))


CUT_S = 1705500000  # in the middle of the feed


@query("st25_stream_handover", EVERY_DECISION)
def st25b(spark, d):
    """A stream stopped half-way; its states are read from the state store and start another one."""
    live.use_rocks(spark)
    obs = observe(event_stream(spark, d), spark, d)
    progress = fresh_path(spark, "handover-progress")
    first = live.run_once(live.decide_stream(obs.filter(F.col("ts_s") < CUT_S), True), "before", None, progress)
    states = live.read_states(spark, progress)
    rest = live.run_once(live.decide_stream(obs.filter(F.col("ts_s") >= CUT_S), True, states), "after")
    return spark.read.parquet(first).unionByName(spark.read.parquet(rest)).select(*DECIDED)


CHANGES = [("region0", 0, "add"), ("region1", 0, "add"), ("region2", 0, "add"), ("region1", CUT_S, "drop"), ("region2", CUT_S, "keep"),
           ("region3", CUT_S + 86400, "add"), ("region1", CUT_S + 172800, "add")]
STAYS = [("region0", 1, 0, "NULL"), ("region1", 1, 0, CUT_S), ("region2", 1, 0, "NULL"), ("region3", 1, CUT_S + 86400, "NULL"), ("region1", 2, CUT_S + 172800, "NULL")]
STAYS_SQL = STAYED.format(", ".join(f"('{a}', {b}, {c}, CAST({e} AS BIGINT))" for a, b, c, e in STAYS), live.WARM_WINDOW_S)


@query("st28_stream_recipients", folded(f"""
SELECT {', '.join(DECIDED)} FROM decided JOIN stays USING (recipient, stay) WHERE ts_s >= from_s""", ("recipient", "stay"), STAYS_SQL))
def st28b(spark, d):
    """A recipient dropped and taken on again, one that is new, one whose settings change; two that never are on the list."""
    live.use_rocks(spark)
    path = fresh_path(spark, "recipients")
    spark.createDataFrame(CHANGES, "recipient STRING, ts_s LONG, what STRING").coalesce(1).write.parquet(path)
    changes = spark.readStream.schema("recipient STRING, ts_s LONG, what STRING").parquet(path)
    history = observe(feed(spark, d), spark, d)
    out = live.decide_stream(observe(event_stream(spark, d), spark, d), True, control=changes, history=history)
    return spark.read.parquet(live.run_once(out, "listed")).select(*DECIDED)


@query("s08_stream_first_write", sql("SELECT DISTINCT who, channel FROM feed", FEED))
def s08_stream(spark, d):
    live.use_rocks(spark)
    first = event_stream(spark, d).dropDuplicates(["who", "channel"]).select("who", "channel")
    return spark.read.parquet(live.run_once(first, "first"))


@query("s08_stream_stored", sql("SELECT DISTINCT channel, message_id // 3 AS message_id FROM feed", FEED))
def s08_stored(spark, d):
    """Every message comes three times under one id; the store keeps the first, in two runs over the same feed."""
    live.use_rocks(spark)
    path = fresh_path(spark, "corpus")
    rows = event_stream(spark, d).withColumn("message_id", F.floor(F.col("message_id") / 3)).withColumn("at", F.col("ts").cast("timestamp"))
    for _ in range(2):
        writer = corpus.stream_first_write(rows.select("channel", "message_id", "at", "n"), path, "at", ["channel", "message_id"], ["at", "n"])
        writer.option("checkpointLocation", fresh_path(spark, "corpus-progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("message_id LONG, channel STRING").parquet(path).select("channel", "message_id")


@query("a11_stream_tumbling", sql("""
SELECT channel, time_bucket(INTERVAL '1 hour', ts) AS start_ts, count(*) AS n FROM feed GROUP BY 1, 2""", FEED))
def a11_stream(spark, d):
    live.use_rocks(spark)
    s = event_stream(spark, d).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    agg = s.groupBy("channel", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("channel", "w", "n")
    rows = spark.read.parquet(live.run_updates(agg, "tumbling"))
    last = rows.groupBy("channel", "w").agg(F.max_by("n", "batch").alias("n"))
    return last.select("channel", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "n")


# --- announcer, snapshots, restarts ----------------------------------------------

LEADS = {"signup": "Alert.", "purchase": "All clear.", "error": "Launch.", "view": "Look out."}
WORDS = {"x": "missile", "y": "drone"}


@query("st23_announcer", sql(f"""
, s AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'x' WHEN n % 3 = 1 THEN 'y' END AS cls, CASE WHEN n % 4 = 0 THEN ['here', 'there'] WHEN n % 4 = 1 THEN ['here'] ELSE [] END AS places,
   channel || chr(10) || n AS source FROM seg WHERE n >= 30),
c AS (SELECT *, CASE WHEN cls IS NOT NULL OR len(places) > 0 THEN concat_ws(' ', CASE cls WHEN 'x' THEN 'missile' WHEN 'y' THEN 'drone' END, nullif(array_to_string(places, ', '), '')) END AS cause,
   CASE WHEN channel = 'error' THEN 'launch:' || coalesce(cls, '') WHEN channel = 'signup' THEN 'alert' END AS lk FROM s),
t AS (SELECT *, lag(ts_s) OVER (PARTITION BY who, segment, cause ORDER BY ts_s, message_id) AS told, row_number() OVER (PARTITION BY who, segment, lk ORDER BY ts_s, message_id) AS nth FROM c),
l AS (SELECT *, CASE WHEN lk IS NULL OR nth = 1 THEN CASE channel WHEN 'signup' THEN 'Alert.' WHEN 'purchase' THEN 'All clear.' WHEN 'error' THEN 'Launch.' WHEN 'view' THEN 'Look out.' END END AS lead,
   CASE WHEN cause IS NOT NULL AND (told IS NULL OR ts_s - told > 7200) THEN cause END AS body FROM t)
SELECT message_id, lead, concat_ws(' ', lead, body, CASE WHEN lead IS NULL AND body IS NULL THEN channel END) AS text FROM l""", FEED, SEG))
def st23(spark, d):
    none = F.array().cast("array<string>")
    rows = seg(spark, d).select(
        "who", "segment", "ts_s", "message_id", F.when(N() >= 30, "info").alias("level"),
        F.when(C() == "signup", "alert").otherwise(C()).alias("tone"), C().alias("channel"),
        F.when(N() % 3 == 0, "x").when(N() % 3 == 1, "y").alias("cls"),
        F.when(N() % 4 == 0, F.array(F.lit("here"), F.lit("there"))).when(N() % 4 == 1, F.array(F.lit("here"))).otherwise(none).alias("places"),
        F.concat("channel", F.lit("\n"), N().cast("string")).alias("source"), (C() == "error").alias("is_launch"))
    leads = {("alert" if k == "signup" else k): v for k, v in LEADS.items()}
    return an.announce(rows, K, O, leads, WORDS, 7200).select("message_id", "lead", "text")


EVERY_SENTENCE = announced("SELECT recipient, message_id, level, reason, text FROM told")


@query("st23_announced", EVERY_SENTENCE)
def st23b(spark, d):
    said = herald.announce_decisions(observe(spread(feed(spark, d)), spark, d), CLASS_WORDS)
    return said.select("recipient", "message_id", "level", "reason", "text")


@query("st23_stream_announced", EVERY_SENTENCE)
def st23c(spark, d):
    live.use_rocks(spark)
    out = live.decide_stream(observe(event_stream(spark, d), spark, d), has_official=True, words=CLASS_WORDS)
    return spark.read.parquet(live.run_once(out, "announced")).select("recipient", "message_id", "level", "reason", "text")


def screen_sql(at_s: int) -> str:
    """The screens at ``at_s`` by the SQL of the fold and the announcer; later rows change nothing before it."""
    by_rank = lambda xs: f"list_transform(list_sort(list_transform({xs}, lambda c: {{'r': -{RANK.format('c')}, 'c': c}})), lambda p: p.c)"
    recent = lambda m, ttl: f"list_transform(list_filter(map_entries({m}), lambda q: {at_s} - q.value <= {ttl}), lambda q: q.key)"
    return announced(f"""
, log AS (SELECT * FROM told WHERE ts_s <= {at_s}),
newest AS (SELECT recipient, arg_max({{'e': held, 'alive_s': alive_s}}, (ts_s, official, channel, message_id)) AS z FROM decided JOIN (SELECT recipient, channel, message_id, official FROM obs) USING (recipient, channel, message_id)
  WHERE ts_s <= {at_s} GROUP BY recipient),
open AS (SELECT recipient, CASE WHEN {at_s} - z.alive_s <= 2700 THEN z.e END AS e FROM newest),
ends AS (SELECT recipient, max(ts_s) FILTER (WHERE reason LIKE 'declared:official%') AS began, max(ts_s) FILTER (WHERE tone = 'clear') AS over FROM log GROUP BY recipient),
x AS (SELECT *, coalesce(e.declared, false) AS on_, coalesce(e.gone, []) AS gone, list_filter(list_distinct(list_concat(coalesce(e.launched, []), [e.e_cls])), lambda c: c IS NOT NULL AND NOT list_contains(coalesce(e.gone, []), c)) AS flying,
    NOT coalesce(e.declared, false) AND coalesce(over >= began AND {at_s} - over <= 3600, false) AS ended FROM open JOIN ends USING (recipient)),
lines AS (SELECT l.*, row_number() OVER (PARTITION BY recipient ORDER BY l.ts_s DESC, channel DESC, message_id DESC) AS nth FROM log l JOIN x USING (recipient)
  WHERE text IS NOT NULL AND (coalesce(l.ts_s >= x.e.opened, false) OR coalesce(NOT on_ AND tone = 'clear' AND l.ts_s = over AND {at_s} - l.ts_s <= 3600, false))),
three AS (SELECT recipient, list(text ORDER BY ts_s, channel, message_id) AS said FROM lines WHERE nth <= 3 GROUP BY recipient)
SELECT recipient, CASE WHEN e IS NULL THEN 'quiet' WHEN on_ THEN 'alert' ELSE 'watching' END AS state, e.opened AS since, {by_rank('flying')}[1] AS top, e.e_cls AS threat,
  {by_rank(f"list_filter(list_intersect(coalesce(e.rechecked, []), coalesce({recent('e.recheck_of', 600)}, [])), lambda c: NOT list_contains(gone, c) AND NOT list_contains(flying, c))")} AS recon,
  {by_rank(f"list_intersect(gone, coalesce({recent('e.lifted_of', 1800)}, []))")} AS cleared, {by_rank("coalesce(e.launched, [])")} AS launched,
  CAST(coalesce(list_max(list_transform(e.air, lambda c: {RANK.format('c')})), 0) AS INT) AS peak, CASE WHEN ended THEN over END AS ended_s, CASE WHEN ended THEN over - began END AS lasted_s, coalesce(said, []) AS said
FROM x LEFT JOIN three USING (recipient)""")


# Seconds at which the screens are looked at: a night and a morning of the feed's second week.
SCREENS = [1705000000, 1705050000]


JOINED = {c: f"array_to_string({c}, '; ') AS {c}" for c in ("recon", "cleared", "launched", "said")}


@query("st24_screen", " UNION ALL ".join(f"SELECT CAST({x} AS BIGINT) AS at_s, * REPLACE ({', '.join(JOINED.values())}) FROM ({screen_sql(x)})" for x in SCREENS))
def st24b(spark, d):
    """What every recipient sees, from the fold's own state and the log of sentences, with the published age limits."""
    obs = observe(spread(feed(spark, d)), spark, d)
    rows = policy.prepare(obs, ["recipient"])  # once for the log and the states
    said = settle(herald.announce_decisions(obs, CLASS_WORDS, prepared=rows).select("recipient", "ts_s", "channel", "message_id", "tone", "reason", "text"))
    parts = [views.screen(policy.states_at(obs, x, rows), said, x).select(F.lit(x).cast("long").alias("at_s"), "*") for x in SCREENS]
    return reduce(DataFrame.unionByName, parts).withColumns({c: F.array_join(c, "; ") for c in JOINED})


RANKS = {"error": 5, "signup": 3, "view": 1}


@query("st24_status_snapshot", sql("""
, now AS (SELECT max(ts_s) AS now_s FROM feed),
b AS (SELECT who, max(ts_s) FILTER (WHERE channel = 'signup') AS opened_s, max(ts_s) FILTER (WHERE channel = 'purchase') AS ended_s, max(n) AS peak,
   list(DISTINCT channel) FILTER (WHERE n >= 95) AS air FROM feed GROUP BY who),
r AS (SELECT who, channel, max(ts_s) AS t FROM feed GROUP BY 1, 2),
x AS (SELECT who, list_sort(list(channel) FILTER (WHERE now_s - t <= 28800)) AS recon, list_sort(list(channel) FILTER (WHERE now_s - t <= 86400 AND channel <> 'view')) AS lifted FROM r, now GROUP BY who)
SELECT b.who AS recipient, CASE WHEN NOT coalesce(opened_s > ended_s, false) THEN 'quiet' WHEN peak > 98 THEN 'alert' ELSE 'watching' END AS sky,
  CASE WHEN coalesce(opened_s > ended_s, false) AND len(air) > 0 THEN list_sort(list_transform(air, lambda c: {'r': -CASE c WHEN 'error' THEN 5 WHEN 'signup' THEN 3 WHEN 'view' THEN 1 ELSE 0 END, 'c': c}))[1].c END AS top,
  coalesce(array_to_string(list_filter(recon, lambda c: NOT list_contains(coalesce(air, []), c)), ','), '') AS recon, coalesce(array_to_string(lifted, ','), '') AS lifted, peak,
  CASE WHEN NOT coalesce(opened_s > ended_s, false) AND now_s - ended_s <= 259200 THEN ended_s - opened_s END AS lasted_s
FROM b JOIN x USING (who), now""", FEED))
def st24(spark, d):
    f = feed(spark, d)
    recon = views.last_times(f, "who", C(), "recon_at").withColumn("recon_at", F.transform_values(
        "recon_at", lambda _k, v: v + 28800 - views.RECON_TTL_S))
    lifted = views.last_times(f.filter("channel <> 'view'"), "who", C(), "lifted_at").withColumn("lifted_at", F.transform_values(
        "lifted_at", lambda _k, v: v + 86400 - views.LIFTED_TTL_S))
    # The feed is a month of one row every few minutes; the age limits are stretched by shifting the times.
    now = f.agg(F.max("ts_s").alias("at_s"))
    s = f.groupBy("who").agg(
        F.max(F.when(C() == "signup", F.col("ts_s"))).alias("opened_s"), F.max(F.when(C() == "purchase", F.col("ts_s"))).alias("ended_s"),
        F.max("n").alias("peak"), F.collect_set(F.when(N() >= 95, C())).alias("air"))
    s = s.join(recon, "who").join(lifted, "who", "left").crossJoin(F.broadcast(now)).withColumn(
        "lifted_at", F.coalesce("lifted_at", F.create_map().cast("map<string,bigint>")))
    s = s.withColumn("open", F.coalesce(F.col("opened_s") > F.col("ended_s"), F.lit(False))).withColumn("announced", F.col("peak") > 98)
    shift = 259200 - views.ENDED_TTL_S
    s = s.withColumn("opened_s", F.col("opened_s") + shift).withColumn("ended_s", F.col("ended_s") + shift)
    return views.snapshot(s.withColumnRenamed("who", "recipient"), F.col("at_s"), RANKS)


SQL_LAST = """last AS (SELECT who, max(ts_s) AS live_at_s, arg_max(channel, (ts_s, message_id)) AS channel, arg_max(n, (ts_s, message_id)) AS n FROM feed GROUP BY who)"""


def last_rows(spark, d):
    s = latest_state(feed(spark, d).select("who", F.struct("ts_s", "message_id").alias("at"), "channel", "n"), "who", "at")
    return s.select("who", F.col("at.ts_s").alias("live_at_s"), "channel", "n")


@query("st25_state_carry", sql("""
SELECT who AS recipient, CAST(to_json({'live_at_s': live_at_s, 'channel': channel, 'n': n}) AS VARCHAR) AS json, n AS back_n, CAST(0 AS BIGINT) AS back_peak FROM last
WHERE (SELECT max(ts_s) FROM feed) - live_at_s <= 43200""", FEED, SQL_LAST))
def st25(spark, d):
    from ..functions.lookups import decode_state, encode_state
    s = last_rows(spark, d).join(F.broadcast(feed(spark, d).agg(F.max("ts_s").alias("now_s"))), F.lit(True))
    s = s.withColumn("json", encode_state(F.struct("live_at_s", "channel", "n"))).withColumnRenamed("who", "recipient")
    zero = F.lit(0).cast("long")
    back = decode_state(F.col("json"), "n LONG, peak LONG", {"n": zero, "peak": zero})
    return live.restorable(s, F.col("now_s")).select("recipient", "json", back["n"].alias("back_n"), back["peak"].alias("back_peak"))


@query("st26_warm_replay", sql("""
SELECT message_id, ts_s < 1706000000 - 60 OR (channel = 'view' AND n >= 50) AS warm FROM feed WHERE ts_s >= 1706000000 - 5400 * 24""", FEED))
def st26(spark, d):
    f = feed(spark, d)
    said = f.filter((C() == "view") & (N() >= 50))
    back = f.filter(F.col("ts_s") >= 1706000000 - 5400 * 24)
    return live.mark_warm(back, F.lit(1706000000), said).select("message_id", "warm")


@query("st27_state_correction", sql("""
, st AS (SELECT who, live_at_s AS opened_s, channel = 'signup' AS official FROM last WHERE n >= 20), de AS (SELECT who, max(ts_s) AS declared_s FROM feed WHERE channel = 'signup' AND n >= 60 GROUP BY 1)
SELECT who AS recipient, declared_s IS NOT NULL OR coalesce(official, false) AS official, least(opened_s, declared_s) AS opened_s,
  CASE WHEN opened_s IS NULL THEN 'seeded' WHEN declared_s IS NULL THEN 'kept' ELSE 'corrected' END AS how FROM st FULL JOIN de USING (who)""", FEED, SQL_LAST))
def st27(spark, d):
    states = last_rows(spark, d).filter("n >= 20").select(
        F.col("who").alias("recipient"), F.col("live_at_s").alias("opened_s"), (C() == "signup").alias("official"))
    declared = feed(spark, d).filter((C() == "signup") & (N() >= 60)).groupBy(F.col("who").alias("recipient")).agg(F.max("ts_s").alias("declared_s"))
    return live.correct_state(states, declared)


@query("st28_recipient_change", sql("""
, st AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), re AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT k AS recipient, CASE WHEN re.k IS NULL THEN 'drop' WHEN st.k IS NULL THEN 'warm' ELSE 'keep' END AS action FROM st FULL JOIN re USING (k)""", "dummy AS (SELECT 1)"))
def st28(spark, d):
    states = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("recipient")).distinct()
    people = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("recipient"))
    return live.apply_recipients(states, people)


@query("st29_changed_only_emission", sql(f"""
, v AS (SELECT *, substr(sha256(to_json({{'channel': channel, 'big': n >= 50}})), 1, 16) AS version FROM feed),
p AS (SELECT *, lag(version) OVER ({WIN}) AS prev FROM v)
SELECT message_id, version FROM p WHERE version IS DISTINCT FROM prev""", FEED))
def st29(spark, d):
    v = clock.version_of(F.struct("channel", (N() >= 50).alias("big")))
    return ep.changed_only(feed(spark, d), K, O, v).select("message_id", "version")


SQL_SEEN = """seen AS (SELECT who, min(ts_s) + 864000 AS seen_s FROM feed WHERE channel = 'view' GROUP BY who)"""


def _deliver(spark, d):
    f = feed(spark, d)
    seen = f.filter("channel = 'view'").groupBy("who").agg((F.min("ts_s") + 864000).alias("seen_s"))
    return ep.deliver(f.filter("n >= 70").select("who", "message_id", F.col("ts_s").alias("at_s")), seen, "who")


@query("st30_delta_delivery", sql("""
SELECT f.who, message_id, ts_s AS at_s FROM feed f LEFT JOIN seen USING (who) WHERE n >= 70 AND (seen_s IS NULL OR ts_s > seen_s)""", FEED, SQL_SEEN))
def st30(spark, d):
    return _deliver(spark, d)[0]


@query("st30_advanced_stamps", sql("""
SELECT who, greatest(m, seen_s) AS seen_s FROM (SELECT who, max(ts_s) AS m FROM feed WHERE n >= 70 GROUP BY who) FULL JOIN seen USING (who)""", FEED, SQL_SEEN))
def st30b(spark, d):
    return _deliver(spark, d)[1]


@query("st31_lag_metric", sql("""
SELECT channel, count(*) AS n, median(lag) AS median, max(lag) AS worst FROM (SELECT channel, CAST(floor(value) AS BIGINT) + n AS lag FROM feed WHERE channel <> 'purchase') GROUP BY 1""", FEED))
def st31(spark, d):
    from ..operators.reports import lag_stats
    seen = feed(spark, d).withColumn("seen_s", F.col("ts_s") + F.floor("value").cast("long") + N()).withColumn("warm", C() == "purchase")
    live_rows = seen.filter("NOT warm").withColumn("lag_s", F.col("seen_s") - F.col("ts_s"))
    return lag_stats(live_rows, ["channel"], "lag_s").select("channel", "n", "median", "worst")


@query("st21_state_update", folded("""
SELECT recipient, z.ts_s AS at_s, z.sky, z.effective, z.reason FROM (
  SELECT recipient, arg_max({'ts_s': ts_s, 'sky': sky, 'effective': effective, 'reason': reason}, (ts_s, channel, message_id)) AS z FROM decided GROUP BY recipient)"""))
def st21(spark, d):
    """The last reading of every recipient after the whole feed was folded."""
    rows = decisions(spark, d).select("recipient", F.struct("ts_s", "channel", "message_id").alias("at"), "sky", "effective", "reason")
    s = latest_state(rows, "recipient", "at")
    return s.select("recipient", F.col("at.ts_s").alias("at_s"), "sky", "effective", "reason")

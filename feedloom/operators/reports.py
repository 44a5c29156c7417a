"""Mining and log reports: counts, histograms, order statistics, scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_capitalised, preview, stem_key, tokens
from .joins import lead_table
from .order_stats import LARGEST, LOW_MIDDLE, P90, P90_CLAMPED, UPPER_MEDIAN, picks
from .scan import last_before, row_index, scan


def channel_overview(m: DataFrame) -> DataFrame:
    """Messages, replies, reply share, upper median length, first and last day."""
    counts = m.groupBy("channel").agg(
        F.count("*").alias("messages"), F.count("reply_to").alias("replies"),
        F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))
    mid = picks(m.select("channel", F.length("text").cast("long").alias("len")), ["channel"], "len",
                median_len=UPPER_MEDIAN).drop("n")
    return counts.join(mid, "channel").withColumn(
        "reply_pct", F.round(F.col("replies") * 100.0 / F.col("messages"), 4))


def coverage(m: DataFrame) -> DataFrame:
    """Per channel and in total: rows, rows with text, replies, first and last seen."""
    return m.rollup("channel").agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("with_text"),
        F.count("reply_to").alias("replies"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def slot_fillers(m: DataFrame, slots: dict[str, str]) -> DataFrame:
    """Capitalised words standing after a preposition, per slot and overall (null slot)."""
    def found(name: str, pattern: str) -> Column:
        words = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(1))
        return F.transform(words, lambda w: F.struct(F.lit(name).alias("slot"), w.alias("word")))

    hits = F.concat(*[found(name, p) for name, p in slots.items()])
    got = m.select(F.explode(hits).alias("h")).select("h.*")
    return got.groupBy("slot", "word").agg(F.count("*").alias("n")).rollup("word", "slot").agg(
        F.sum("n").alias("n")).filter("word IS NOT NULL")


def families(m: DataFrame, min_total: int = 5, min_variants: int = 2, top: int = 6) -> DataFrame:
    """Capitalised words clustered by their stem, with the most frequent forms."""
    words = m.select(F.explode(tokens(F.col("text"))).alias("word")).filter(
        is_capitalised(F.col("word")) & (F.length("word") > 3))
    forms = words.groupBy(stem_key(F.col("word")).alias("family"), "word").agg(F.count("*").alias("n"))
    sizes = forms.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("variants"))
    kept = sizes.filter((F.col("total") >= min_total) & (F.col("variants") >= min_variants))
    # The report shows the first few forms; a rank inside the family picks them.
    ranked = scan(forms.withColumn("_neg", -F.col("n")), ["family"], ["_neg", "word"], rank=row_index())
    best = ranked.filter(F.col("rank") <= top).groupBy("family").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_f"))
    return kept.join(best, "family").select(
        "family", "total", "variants", F.array_join(F.transform("_f", lambda x: x["word"]), " ").alias("forms"))


def term_frequency(m: DataFrame, terms: Sequence[str], examples: int = 3) -> DataFrame:
    """Messages containing each term, and the first few of them by time.

    The rank inside a term comes from a scan in pieces: a term standing in a third of
    all messages is not gathered in one task.
    """
    low = F.lower("text")
    hit = m.select("ts_s", "message_id", "text", F.explode(F.filter(
        F.array(*[F.when(low.contains(t), F.lit(t)) for t in terms]), lambda x: x.isNotNull())).alias("term"))
    counts = hit.groupBy("term").agg(F.count("*").alias("n"))
    rows = scan(hit.select("term", "ts_s", "message_id"), ["term"], ["ts_s", "message_id"], rank=row_index())
    first = rows.filter(F.col("rank") <= examples).groupBy("term").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "message_id"))),
                                 lambda x: x["message_id"].cast("string")), ",").alias("examples"))
    return counts.join(first, "term")


def short_texts(m: DataFrame, max_len: int = 25) -> DataFrame:
    return m.filter((F.length("text") <= max_len) & (F.coalesce("text", F.lit("")) != "")).groupBy("text").agg(
        F.count("*").alias("n"))


def pattern_counts(m: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Messages matching each form, with the first example."""
    hit = m.select("ts_s", "message_id", "text", F.explode(F.filter(F.array(*[
        F.when(F.col("text").rlike(p), F.lit(name)) for name, p in patterns.items()]),
        lambda x: x.isNotNull())).alias("form"))
    return hit.groupBy("form").agg(
        F.count("*").alias("n"),
        F.min_by(preview(F.col("text"), 40), F.struct("ts_s", "message_id")).alias("example"))


def chain_histogram(chains: DataFrame) -> DataFrame:
    return chains.groupBy("length").agg(
        F.count("*").alias("roots"), F.sum(F.col("messages") - 1).alias("replies"))


def resolved_share(ends: DataFrame, resolved: Column) -> DataFrame:
    return ends.agg(F.count_if(resolved).alias("resolved"), F.count("*").alias("ends")).withColumn(
        "share", F.when(F.col("ends") > 0, F.round(F.col("resolved") / F.col("ends"), 6)))


def duplicate_stats(pairs: DataFrame) -> DataFrame:
    """Per pair of channels (first, second) and in total: pairs and their lag."""
    by = picks(pairs, ["first_channel", "second_channel"], "lag_s", weight=F.col("pairs"),
               median_s=UPPER_MEDIAN, p90_s=P90, max_s=LARGEST)
    total = picks(pairs, [], "lag_s", weight=F.col("pairs"), median_s=UPPER_MEDIAN, p90_s=P90, max_s=LARGEST)
    return by.unionByName(total, allowMissingColumns=True)


def busiest_minutes(m: DataFrame, k: int) -> DataFrame:
    return m.groupBy(F.floor(F.col("ts_s") / 60).alias("minute")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "minute").limit(k)


def hour_histogram(m: DataFrame, hour: Column, bar: int = 40) -> DataFrame:
    """All 24 hours, empty ones too, with a bar scaled to the fullest (half to even)."""
    got = m.groupBy(hour.cast("long").alias("hour")).agg(F.count("*").alias("n"))
    hours = m.sparkSession.range(24).select(F.col("id").alias("hour"))
    top = got.agg(F.max("n").alias("_top"))
    return hours.join(got, "hour", "left").crossJoin(F.broadcast(top)).select(
        "hour", F.coalesce("n", F.lit(0)).alias("n"),
        F.bround(F.coalesce("n", F.lit(0)) * bar / F.col("_top"), 0).cast("long").alias("bar"))


def night_summary(m: DataFrame, night: Column, flags: dict[str, Column]) -> DataFrame:
    return m.groupBy(night.alias("night")).agg(
        F.count("*").alias("messages"), *[F.count_if(c).alias(k) for k, c in flags.items()],
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def lag_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """True median, clamped p90 and worst."""
    got = picks(rows, keys, value, _lo=LOW_MIDDLE, _hi=UPPER_MEDIAN, p90=P90_CLAMPED, worst=LARGEST)
    return got.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"), "p90", "worst")


def log_report(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("rows"), F.count_if(~F.col("warm")).alias("live"), F.count_if("warm").alias("warm"),
        F.count_if(~F.col("warm") & F.col("notify") & (F.col("level") == "alert")).alias("audible"),
        F.count_if(~F.col("warm") & F.col("notify") & (F.col("level") == "info")).alias("shown"),
        F.count_if(~F.col("warm") & ~F.col("notify")).alias("silent"))


def source_scorecard(mine: DataFrame, theirs: DataFrame, window_s: int, readable: Column) -> DataFrame:
    """Candidate against corpus: how often first, alone, and by how much."""
    leads = lead_table(mine.withColumn("_ok", readable), theirs, ["who"], ["message_id"], window_s)
    counts = leads.groupBy("channel").agg(
        F.count("*").alias("mentions"), F.count("their_ts").alias("matched"),
        F.count_if(F.col("lead_s") > 0).alias("first"), F.count_if(F.col("their_ts").isNull()).alias("alone"),
        F.max("lead_s").alias("best_s"), F.count_if(F.col("_ok")).alias("class_known"),
        F.count_if(~F.col("_ok")).alias("unreadable"),
        (F.floor((F.max("ts_s") - F.min("ts_s")) / 86400) + 1).alias("days"))
    spread = picks(leads, ["channel"], "lead_s", median_s=UPPER_MEDIAN, p90_s=P90).drop("n")
    return counts.join(spread, "channel", "left").withColumn(
        "per_day", F.round(F.col("mentions") / F.col("days"), 4))


def freshness(m: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    newest = m.agg(F.max("ts_s").alias("newest_s"))
    wrote = log.agg(F.max("at_s").alias("log_s"))
    # Two one-row aggregates.
    return newest.crossJoin(wrote).select(
        (now - F.col("newest_s")).alias("feed_age_s"), (now - F.col("log_s")).alias("log_age_s"))


def co_mention(places: DataFrame, name: str) -> DataFrame:
    """Names standing in the same messages as ``name``, by frequency."""
    with_name = places.filter(F.col("place") == name).select("channel", "message_id").distinct()
    return places.filter(F.col("place") != name).select("channel", "message_id", "place").distinct().join(
        with_name, ["channel", "message_id"], "left_semi").groupBy("place").agg(F.count("*").alias("n"))


def gap_to_live(m: DataFrame, order: Sequence[str], live: Column, term: Column, near_s: int = 600) -> DataFrame:
    """Per marker term: gap to the latest live message, its median and the share within ``near_s``."""
    out = scan(m.withColumn("term", term), [], order, _live=last_before(F.when(live, F.col("ts_s"))))
    rows = out.filter("term IS NOT NULL AND _live IS NOT NULL").select(
        "term", (F.col("ts_s") - F.col("_live")).alias("gap_s"))
    near = rows.groupBy("term").agg(F.round(F.count_if(F.col("gap_s") <= near_s) / F.count("*"), 6).alias("near_share"))
    return lag_stats(rows, ["term"], "gap_s").select("term", "n", F.col("median").alias("median_gap_s")).join(near, "term")


def bells_per_night(log: DataFrame, night: str, audible: Column) -> DataFrame:
    """Audible decisions per night: nights, total, median, p90 over all nights seen."""
    per = log.groupBy(night).agg(F.count_if(audible).alias("bells"))
    total = per.agg(F.sum("bells").alias("total"))
    got = lag_stats(per, [], "bells")
    return got.crossJoin(total).select(F.col("n").alias("nights"), "total", "median", "p90")

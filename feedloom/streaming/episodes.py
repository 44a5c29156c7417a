"""Episode rules that look at earlier rows only, as running values.

These are the parts of the decision that do not depend on earlier decisions: they are
computed for all recipients at once, in pieces, before any per-recipient fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Running, last_before, max_so_far, row_index, scan, sum_so_far

IDLE_CLOSE_S = 2700
OUT_OF_ORDER_S = 3600
OFFICIAL_STALE_S = 1800


def segments(rows: DataFrame, keys: Sequence[str], order: Sequence[str], closes: Column,
             idle_s: Column | int = IDLE_CLOSE_S, keep_open: Column | None = None,
             hold: Column | None = None) -> DataFrame:
    """Number the stretches between accepted clears and long silences.

    A stretch starts clean, so each can be folded on its own: this is what spreads one
    busy recipient over many tasks.  ``keep_open`` marks clears that must not cut,
    ``hold`` rows that no silence before them may cut off.
    """
    cut = closes if keep_open is None else closes & ~F.coalesce(keep_open, F.lit(False))
    held = F.lit(False) if hold is None else F.coalesce(hold, F.lit(False))
    first = scan(rows.withColumn("_cut", F.coalesce(cut, F.lit(False))), keys, order, keep_pieces=True, _at=last_before(F.col("ts_s")))
    gap = F.coalesce(F.col("ts_s") - F.col("_at") > idle_s, F.lit(False)) & ~held
    return number(first, keys, order, F.col("_cut"), gap, again=True).drop("_cut", "_at")


def number(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Column, gap: Column,
           again: bool = False) -> DataFrame:
    """``segment``: cuts on earlier rows plus gaps up to this one."""
    out = scan(rows, keys, order, again=again, _cuts=sum_so_far(cut.cast("long"), inclusive=False), _gaps=sum_so_far(gap.cast("long")))
    return out.withColumn("segment", F.coalesce("_cuts", F.lit(0)) + F.col("_gaps")).drop("_cuts", "_gaps")


def episodes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column, closes: Column,
             idle_s: int = IDLE_CLOSE_S) -> DataFrame:
    """Episodes: first opening row of a stretch to its last; only live rows keep one alive."""
    live = rows.filter(opens | closes)
    cut = segments(live.withColumn("_open", opens), keys, order, closes, idle_s)
    return cut.filter("_open").groupBy(*keys, "segment").agg(
        F.min("ts_s").alias("opened_s"), F.max("ts_s").alias("last_live_s"), F.count("*").alias("rows")).drop("segment")


def lateness(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str], official: Column,
             tolerance_s: int = OUT_OF_ORDER_S) -> DataFrame:
    """Rows that arrive behind the newest time seen: how far, and whether too late to use."""
    out = scan(rows.withColumn("_official", official), keys, arrival, _high=max_so_far(F.col("ts_s"), inclusive=False))
    behind = F.greatest(F.col("_high") - F.col("ts_s"), F.lit(0))
    return out.withColumn("behind_s", F.coalesce(behind, F.lit(0))).withColumn(
        "late", F.when(F.col("_official"), F.col("behind_s") > tolerance_s).otherwise(F.col("behind_s") > 0)
    ).drop("_official", "_high")


def official_age(rows: DataFrame, keys: Sequence[str], order: Sequence[str], official: Column,
                 keep_pieces: bool = False) -> DataFrame:
    """Seconds since the authoritative source spoke, and whether it is in the stream at all."""
    seen = F.when(official, 1)
    out = scan(rows.withColumn("_now", F.coalesce(official, F.lit(False))), keys, order,
               keep_pieces=keep_pieces, _said=last_before(F.when(official, F.col("ts_s"))),
               _before=Running("max", seen, False), _after=Running("max", seen, False, True))
    out = out.withColumn("official_age_s", F.col("ts_s") - F.col("_said"))
    if "has_official" not in rows.columns:  # else the feed says so itself
        out = out.withColumn("has_official", F.col("_now") | F.col("_before").isNotNull() | F.col("_after").isNotNull())
    return out.drop("_now", "_said", "_before", "_after")


def precedence(state: Column, official: Column, has_official: Column) -> Column:
    """Who owns the declaration: the authoritative source when it is in the stream."""
    return F.when(state.isNull(), F.lit(None).cast("string")).when(official, "declares").when(
        has_official, "reports").otherwise("declares")


def clear_accepted(state: Column, partial: Column, official: Column, has_official: Column, age: Column,
                   canonical: Column, far: Column, stale_s: int = OFFICIAL_STALE_S) -> Column:
    """A full clear that ends the episode, counting the fallback for a source gone silent."""
    fallback = (F.coalesce(age, F.lit(0)) > stale_s) & canonical & ~far
    return F.coalesce(state == "clear", F.lit(False)) & ~partial & (official | ~has_official | fallback)


def once_until(rows: DataFrame, keys: Sequence[str], order: Sequence[str], event: Column, rearm: Column) -> DataFrame:
    """Event rows with ``first``: no such event since the key was last re-armed."""
    mark = F.when(event, F.lit(True)).when(rearm, F.lit(False))
    out = scan(rows.withColumn("_event", event), keys, order, _last=last_before(mark))
    return out.withColumn("first", ~F.coalesce("_last", F.lit(False))).filter("_event").drop("_event", "_last")


def first_after(rows: DataFrame, keys: Sequence[str], order: Sequence[str], trigger: Column, follow: Column) -> DataFrame:
    """The first following row after each trigger."""
    mark = F.when(trigger, F.lit(True)).when(follow, F.lit(False))
    out = scan(rows.withColumn("_follow", follow & ~trigger), keys, order, _last=last_before(mark))
    return out.filter(F.col("_follow") & F.coalesce("_last", F.lit(False))).drop("_follow", "_last")


def declare_once(rows: DataFrame, keys: Sequence[str], order: Sequence[str], explicit: Column) -> DataFrame:
    """Declarations shown: the first of a stretch, and the first that names a scope;
    replies never declare.  ``rows`` has state, is_reply, segment."""
    said = rows.filter("state = 'alert'")
    told = ~F.col("is_reply")
    out = scan(said.withColumn("_explicit", explicit), [*keys, "segment"], order,
               _any=Running("max", told.cast("int"), False),
               _known=Running("max", (told & F.col("_explicit")).cast("int"), False))
    fresh = F.coalesce("_any", F.lit(0)) == 0
    scoped = F.col("_explicit") & (F.coalesce("_known", F.lit(0)) == 0)
    return out.withColumn("shown", told & (fresh | scoped)).drop("_explicit", "_any", "_known")


def inherit_class(rows: DataFrame, keys: Sequence[str], order: Sequence[str], stated: Column, live: Column,
                  declares: Column, ttl_s: int) -> DataFrame:
    """Untyped rows take the stretch's class; only declarations have an age limit."""
    out = scan(rows.withColumn("_stated", stated), [*keys, "segment"], order, _was=last_before(
        F.when(stated.isNotNull() & live, F.struct(F.col("ts_s").alias("at"), stated.alias("cls")))))
    old = declares & (F.col("ts_s") - F.col("_was.at") > ttl_s)
    took = F.when(F.col("_stated").isNull() & ~F.coalesce(old, F.lit(False)), F.col("_was.cls"))
    return out.withColumn("effective", F.coalesce("_stated", took)).withColumn(
        "inherited", took.isNotNull()).drop("_stated", "_was")


def escalation(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cls: Column, lifted: Column,
               joins_air: Column, ranks: Mapping[str, int]) -> DataFrame:
    """Peak rank of the classes in the air before each row, and whether the row tops it.

    One running value per class of the (short) class table: in the air since its last
    mention unless lifted after it.
    """
    marks = {
        f"_air{i}": last_before(F.when(joins_air & (cls == name), True).when(lifted == name, False))
        for i, name in enumerate(ranks)
    }
    out = scan(rows.withColumn("_rank", F.coalesce(
        *[F.when(cls == name, rank) for name, rank in ranks.items()], F.lit(0))), keys, order, **marks)
    peak = F.greatest(F.lit(0), *[
        F.when(F.coalesce(F.col(f"_air{i}"), F.lit(False)), rank).otherwise(0)
        for i, rank in enumerate(ranks.values())])
    return out.withColumn("peak", peak).withColumn("climbs", F.col("_rank") > F.col("peak")).drop("_rank", *marks)


def new_tone(rows: DataFrame, keys: Sequence[str], order: Sequence[str], tone: str) -> DataFrame:
    out = scan(rows, [*keys, "segment", tone], order, _i=row_index())
    return out.withColumn("is_new_tone", F.col("_i") == 1).drop("_i")


def fresh_event(rows: DataFrame, keys: Sequence[str], order: Sequence[str], event: Column, gap_s: int) -> DataFrame:
    """Event rows more than ``gap_s`` after the previous one; every event restamps."""
    out = scan(rows.filter(event), keys, order, _prev=last_before(F.col("ts_s")))
    return out.withColumn("fresh", F.col("_prev").isNull() | (F.col("ts_s") - F.col("_prev") > gap_s)).drop("_prev")


def distance_ladder(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column) -> DataFrame:
    """Rows that come closer than anything before in the stretch."""
    out = scan(rows.withColumn("_step", step), [*keys, "segment"], order,
               _top=max_so_far(F.col("_step"), inclusive=False))
    return out.filter(F.col("_step") > F.coalesce("_top", F.lit(0))).drop("_top").withColumnRenamed("_step", "step")


def changed_only(rows: DataFrame, keys: Sequence[str], order: Sequence[str], version: Column) -> DataFrame:
    """Snapshots whose version differs from the one before."""
    out = scan(rows.withColumn("version", version), keys, order, _prev=last_before(F.col("version")))
    return out.filter(~F.col("version").eqNullSafe(F.col("_prev"))).drop("_prev")


def deliver(lines: DataFrame, seen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(lines newer than each device's stamp, the advanced stamps)."""
    j = lines.join(seen, key, "left")
    fresh = j.filter(F.col("seen_s").isNull() | (F.col("at_s") > F.col("seen_s"))).drop("seen_s")
    stamps = lines.groupBy(key).agg(F.max("at_s").alias("_m")).join(seen, key, "full_outer").select(
        key, F.greatest("_m", "seen_s").alias("seen_s"))
    return fresh, stamps

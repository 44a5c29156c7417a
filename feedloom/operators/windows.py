"""Ordered-feed operators: spans, gaps, runs, links to earlier rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Running, last_before, max_so_far, next_after, row_index, scan, sum_so_far


def alert_spans(m: DataFrame, state: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """[start, end) spans of ``alert`` between clears; the last may stay open."""
    told = m.filter(F.col(state).isNotNull())
    turn = scan(told, keys, order, _before=last_before(F.col(state)))
    turn = turn.filter(F.coalesce(F.col("_before"), F.lit("clear")) != F.col(state)).drop("_before")
    ends = scan(turn, keys, order, end_s=next_after(F.col("ts_s")))
    return ends.filter(F.col(state) == "alert").select(*keys, F.col("ts_s").alias("start_s"), "end_s")


def last_declaration(m: DataFrame, keys: Sequence[str], at: DataFrame, within_s: int) -> DataFrame:
    """Per key the declaration still unanswered at time ``at``; partial clears do not answer."""
    live = m.join(F.broadcast(at), F.lit(True)).filter(
        F.col("state").isNotNull() & ~F.col("partial")
        & (F.col("ts_s") <= F.col("at_s")) & (F.col("ts_s") >= F.col("at_s") - within_s))
    last = live.groupBy(*keys).agg(
        F.max_by(F.struct("state", "ts_s"), F.struct("ts_s", "message_id")).alias("_l"))
    return last.filter(F.col("_l.state") == "alert").select(*keys, F.col("_l.ts_s").alias("declared_s"))


def link_repeats(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ident: Column, rang: Column,
                 repeat: Column, clear: Column, max_gap_s: int = 3600) -> DataFrame:
    """Silent repeats linked to the last ring of the night; a clear resets, a long gap declines."""
    mark = F.when(rang | clear, F.struct(
        F.col("ts_s").alias("at"), F.when(rang & ~clear, ident).alias("id")))
    out = scan(rows.withColumn("_repeat", repeat), keys, order, _ring=last_before(mark))
    gap = F.col("ts_s") - F.col("_ring.at")
    return out.filter("_repeat").withColumn(
        "repeat_of", F.when(gap <= max_gap_s, F.col("_ring.id"))).drop("_repeat", "_ring")


def earlier_exists(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cond: Column, out: str) -> DataFrame:
    got = scan(rows, keys, order, **{out: Running("max", cond.cast("int"), False)})
    return got.withColumn(out, F.coalesce(F.col(out), F.lit(0)) == 1)


def tone_changes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], tone: Column, audible: Column,
                 check: Column) -> DataFrame:
    """Audible rows whose tone differs from the previous audible one of the night."""
    out = scan(rows.withColumn("_check", check & audible), keys, order,
               previous=last_before(F.when(audible, tone)))
    return out.filter(F.col("_check") & F.col("previous").isNotNull() & (F.col("previous") != tone)).drop("_check")


def seq_in(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "seq") -> DataFrame:
    return scan(rows, keys, order, **{out: row_index()})


def running_peak(rows: DataFrame, keys: Sequence[str], order: Sequence[str], count: Column,
                 audible: Column) -> DataFrame:
    """Largest stated count since the last audible row (that row starts a new run)."""
    grouped = scan(rows, keys, order, run=sum_so_far(audible.cast("long"), inclusive=True))
    return scan(grouped, [*keys, "run"], order, peak=max_so_far(count))


def gaps(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    out = scan(rows, keys, order, _prev=last_before(F.col("ts_s")))
    return out.withColumn("gap_s", F.col("ts_s") - F.col("_prev")).drop("_prev")


def raid_since(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Start of the running alert per recipient from its newest telling row.

    A row that carries ``sky`` answers itself; an older one counts as an alert if it
    rang with a tone other than the all-clear's.
    """
    told = log.filter(F.col("sky").isNotNull() | F.col("level").isNotNull())
    last = told.groupBy(key).agg(F.max_by(
        F.struct("at_s", "sky", "since", "level", "alarm"), F.struct(*order)).alias("r"))
    on = F.when(F.col("r.sky").isNotNull(), F.col("r.sky") == "alert").otherwise(
        (F.col("r.level") == "alert") & ~F.col("r.alarm").isin("clear", "clear-partial"))
    return last.select(key, F.when(on, F.coalesce("r.since", "r.at_s")).alias("since"))

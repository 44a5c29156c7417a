"""Pages, tops and last lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import first_per_key
from .scan import row_index, scan

FEED_KEY = ("ts_s", "channel", "message_id")


def feed_back(m: DataFrame, floor_s: Column, n: int) -> DataFrame:
    """Newest ``n`` rows since ``floor_s``, oldest first."""
    newest = m.filter(F.col("ts_s") >= floor_s).orderBy(*[F.desc(c) for c in FEED_KEY]).limit(n)
    return newest.orderBy(*FEED_KEY)


def newest_cursor(m: DataFrame) -> DataFrame:
    """Where to poll from, also when the window is empty."""
    last = m.agg(F.max(F.struct(*FEED_KEY)).alias("k"))
    return last.select(F.concat_ws(".", *[F.col(f"k.{c}").cast("string") for c in FEED_KEY]).alias("next"))


def feed_since(m: DataFrame, cursor: tuple[int, str, int], n: int) -> DataFrame:
    """The page after a cursor; keyset order, so no row repeats or is skipped.

    The plain bound on the time column repeats what the struct comparison says, so
    that it reaches the scan as a pushed filter.
    """
    at = F.struct(F.lit(cursor[0]).cast("long").alias("ts_s"), F.lit(cursor[1]).alias("channel"),
                  F.lit(cursor[2]).cast("long").alias("message_id"))
    return m.filter((F.col("ts_s") >= cursor[0]) & (F.struct(*FEED_KEY) > at)).orderBy(*FEED_KEY).limit(n)


def decision_page(log: DataFrame, who: str, said: Column, n: int, since: int | None = None) -> DataFrame:
    """One recipient's lines, once each; a head after a cursor, else the tail."""
    mine = log.filter((F.col("who") == who) & said)
    once = first_per_key(mine, ["anchor", "at_s"], ["line"])
    if since is not None:
        return once.filter(F.col("at_s") > since).orderBy("at_s", "anchor").limit(n)
    return once.orderBy(F.desc("at_s"), F.desc("anchor")).limit(n).orderBy("at_s", "anchor")


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def worst_first(classes: Column, ranks: dict[str, int]) -> Column:
    """Classes by severity, then by name."""
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    keyed = F.transform(classes, lambda c: F.struct(
        (-F.coalesce(F.try_element_at(table, c), F.lit(0))).alias("r"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def screen_lines(said: DataFrame, episode: DataFrame, key: str, at: Column, keep: int = 3,
                 clear_ttl_s: int = 3600) -> DataFrame:
    """Last lines of the running episode, with a recent all-clear unless an alert is on.

    The rank comes from a scan in pieces, so a recipient with very many lines is not
    sorted in one task.
    """
    j = said.join(episode, key)
    mine = F.col("at_s") >= F.col("opened_s")
    ended = (F.col("alarm") == "clear") & ~F.col("alert_on") & (at - F.col("at_s") <= clear_ttl_s)
    lines = j.filter(mine | ended).withColumn("line", F.struct("at_s", "anchor"))
    ranked = scan(
        lines.withColumn("_neg", -F.col("at_s")), [key], ["_neg", "anchor"], rank=row_index())
    return ranked.filter(F.col("rank") <= keep).select(key, "at_s", "anchor", "rank")


def union_feeds(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def finding_sort(df: DataFrame, first: str, count: str, token: str) -> DataFrame:
    return df.orderBy(F.desc(first), F.desc(count), token)


def common(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def airborne(cls: Column, launched: Column, cleared: Column) -> Column:
    return F.array_except(F.array_union(F.filter(F.array(cls), lambda x: x.isNotNull()), launched), cleared)


def recon(rechecked: Column, fresh: Column, cleared: Column, air: Column) -> Column:
    return F.array_except(F.array_except(F.array_intersect(rechecked, fresh), cleared), air)


def new_kinds(kinds: Column, seen: Column) -> Column:
    return F.size(F.array_except(kinds, seen)) > 0


def not_yet_said(df: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(log.select(*keys), list(keys), "left_anti")

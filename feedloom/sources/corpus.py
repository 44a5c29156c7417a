"""The stored feed: merging, high-water marks, id ranges, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.scan import row_index, scan
from ..session import small_side

BROADCAST_CHANNELS = 100_000


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def new_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet, one per key."""
    fresh = first_per_key(batch, keys, order)
    return fresh.join(target.select(*keys), list(keys), "left_anti")


def merge_first_write(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                      order: Sequence[str]) -> DataFrame:
    """Target plus the new rows: what is stored is never overwritten."""
    return target.unionByName(new_rows(target, batch, keys, order).select(*target.columns))


def resume_ids(messages: DataFrame) -> DataFrame:
    return messages.groupBy("channel").agg(F.max("message_id").alias("resume_id"))


def newer_than(df: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows above their channel's mark; an unknown channel starts at 0.

    Channels are few, so the marks normally travel and the feed stays where it is.
    """
    return (
        df.join(small_side(marks, BROADCAST_CHANNELS), "channel", "left")
        .filter(F.col("message_id") > F.coalesce("resume_id", F.lit(0)))
        .drop("resume_id")
    )


def plan_ranges(ledger: DataFrame, bounds: DataFrame, size: int) -> DataFrame:
    """Grid-snapped id ranges covering [lo, hi] per channel, laid over the ledger.

    New ranges are added, a range that grew is extended and reopened, others stay.
    """
    first = F.floor(F.col("lo") / size) * size
    grid = bounds.select(
        "channel", "hi",
        F.explode(F.sequence(first, F.col("hi"), F.lit(size).cast("long"))).alias("start"),
    ).select(
        "channel",
        F.col("start").alias("lo"),
        F.least(F.col("start") + size - 1, F.col("hi")).alias("want_hi"),
    )
    both = grid.join(ledger, ["channel", "lo"], "full_outer")
    added = F.col("hi").isNull()
    grown = F.col("hi") < F.col("want_hi")
    moved = F.col("want_hi").isNotNull() & (added | grown)
    return both.select(
        "channel", "lo",
        F.when(moved, F.col("want_hi")).otherwise(F.col("hi")).alias("hi"),
        F.when(moved, F.col("want_hi") + 1).otherwise(F.col("cursor")).alias("cursor"),
        F.when(moved, F.lit(False)).otherwise(F.col("done")).alias("done"),
        F.when(added, "added").when(moved, "extended").otherwise("kept").alias("action"),
    )


def pending(ledger: DataFrame) -> DataFrame:
    return ledger.filter(~F.col("done")).orderBy("channel", F.desc("lo"))


def progress(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("channel").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("done")).alias("done"))


def id_at_date(messages: DataFrame, cutoff: Column) -> DataFrame:
    return messages.filter(F.col("ts") >= cutoff).groupBy("channel").agg(
        F.min("message_id").alias("first_id"))


def channel_table(messages: DataFrame, old: DataFrame, titles: DataFrame) -> DataFrame:
    """Per-channel summary; a null title keeps the stored one."""
    now = messages.groupBy("channel").agg(
        F.max("message_id").alias("max_id"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return (
        now.join(titles.select("channel", F.col("title").alias("_new")), "channel", "left")
        .join(old.select("channel", F.col("title").alias("_old")), "channel", "left")
        .select("channel", F.coalesce("_new", "_old").alias("title"), "max_id", "first_ts", "last_ts")
    )


def renormalise(messages: DataFrame, col: str, rule: Column) -> DataFrame:
    """Rows a changed normaliser would rewrite, with old and new text."""
    return (
        messages.withColumn("_new", rule)
        .filter(F.col("_new") != F.col(col))
        .select(*[c for c in messages.columns if c != col], F.col(col).alias("old"), F.col("_new").alias("new"))
    )


def merge_feed(frames: Sequence[DataFrame], official: Column) -> DataFrame:
    """All channels as one feed in total order: time, then the official source last."""
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    ranked = both.withColumn("official_last", official.cast("int"))
    return scan(ranked, [], ["ts_s", "official_last", "channel", "message_id"], seq=row_index())


def negative_set(rules: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Messages that must stay silent, each with the rule that says so."""
    out = None
    for name, rows in rules:
        tagged = rows.withColumn("rule", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


SPAN = 10_000  # ids of a channel in one folder of a stored corpus
TOUCHED = 100_000  # folders of a batch that are sent to every task


def spanned(rows: DataFrame, id_: str = "message_id", span: int = SPAN) -> DataFrame:
    """``rows`` with ``_span``, the part of a channel's ids that its folder holds."""
    return rows.withColumn("_span", F.floor(F.col(id_) / span).cast("long"))


def store_first_write(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], span: int = SPAN) -> None:
    """Append the rows of ``batch`` whose key (channel, id) is not stored under ``path`` yet, one per key.

    The store lies in folders by channel and id range; only folders the batch hits are read.
    A batch that is written again after a failure adds nothing.
    """
    spark = batch.sparkSession
    fresh = spanned(first_per_key(batch, keys, order), keys[-1], span).persist()
    try:
        try:
            stored = spark.read.parquet(path)
        except AnalysisException:  # nothing is stored yet
            stored = None
        if stored is not None:
            hit = small_side(fresh.select("channel", "_span").distinct(), TOUCHED)
            near = stored.join(hit, ["channel", "_span"], "left_semi").select(*keys)
            fresh = fresh.join(near, list(keys), "left_anti")
        # A folder's rows are at most ``span`` times what a key has; one task writes them, so that there is a file a folder, not one for each task.
        fresh.repartition("channel", "_span").write.mode("append").partitionBy("channel", "_span").parquet(path)
    finally:
        fresh.unpersist()


def stream_first_write(stream: DataFrame, path: str, at: str, keys: Sequence[str], order: Sequence[str],
                       delay: str = "1 hour", span: int = SPAN) -> DataStreamWriter:
    """A writer that keeps the first row of every key for good, with bounded state.

    The stream itself remembers keys only for ``delay`` behind the newest ``at``; a key that comes
    again later is found in the store.
    """
    once = stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))
    return once.writeStream.foreachBatch(lambda batch, _: store_first_write(batch, path, keys, order, span)).outputMode("append")

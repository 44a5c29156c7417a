"""The ordered fold: one state per key, rows in order, in batch and in streams.

Spark partitions and sorts; a task then walks its sorted rows and keeps one state at a
time, so memory does not grow with the length of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import next_after, row_index, scan
from ..session import settle, width

Step = Callable[[dict, dict], dict]


def walk(batches: Iterator[pd.DataFrame], keys: Sequence[str], step: Step, keep: Sequence[str],
         start: Callable[[dict], dict]) -> Iterator[pd.DataFrame]:
    """Apply ``step(state, row) -> outputs`` along sorted rows, a fresh state per key."""
    held, state = None, {}
    for pdf in batches:
        outs, names = [], list(pdf.columns)
        for values in zip(*[pdf[c].tolist() for c in names]):  # plain values, a column at a time
            row = dict(zip(names, values))
            key = tuple(row[k] for k in keys)
            if key != held:
                held, state = key, start(row)
            outs.append(step(state, row))
        got = pd.DataFrame(outs, index=pdf.index)
        yield pd.concat([pdf[list(keep)], got], axis=1)


def fold_sorted(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, keep: Sequence[str],
                out_schema: str, start: Callable[[dict], dict] = lambda row: {}) -> DataFrame:
    """``keep`` columns plus what ``step`` says about every row."""
    placed = rows.repartition(width(rows.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    keys, keep = list(keys), list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return walk(batches, keys, step, keep, start)

    return placed.mapInPandas(run, f"{kept}, {out_schema}")


SHORT = 256  # rows of a stretch that are settled in one row of the JVM


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(and_, [a[c].eqNullSafe(b[c]) for c in cols])


def _kept_short(rows: DataFrame, keys: Sequence[str], order: Sequence[str], window_s: int, keep: Sequence[str]) -> DataFrame:
    """Stretches of at most SHORT rows: an array fold each."""
    held = list(dict.fromkeys([*order, *keep]))
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("_rows"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<boolean>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        hit = acc["last"].isNull() | (x["ts_s"] - acc["last"] > window_s)
        return F.struct(F.when(hit, x["ts_s"]).otherwise(acc["last"]).alias("last"), F.array_append(acc["out"], hit).alias("out"))

    flags = F.aggregate("_rows", start, add, lambda acc: acc["out"])
    each = per.select(F.explode(F.arrays_zip("_rows", flags.alias("_kept"))).alias("x"))
    return each.select(*[F.col(f"x._rows.{c}").alias(c) for c in keep], F.col("x._kept").alias("kept"))


def _kept_long(rows: DataFrame, keys: Sequence[str], order: Sequence[str], window_s: int, keep: Sequence[str]) -> DataFrame:
    """Stretches of any length, over all tasks.

    Every row points at the first one more than ``window_s`` later; the rows kept are those
    on the way from the first row.  They are marked by doubling: each round reaches twice as
    far and doubles the pointers, so the rounds grow with the logarithm of the way.
    """
    held = settle(scan(rows, keys, order, _i=row_index()))
    later = held.select(*keys, F.col("ts_s").alias("_at"), F.lit(0).alias("_probe"), "_i")
    probes = held.select(*keys, (F.col("ts_s") + window_s).alias("_at"), F.lit(1).alias("_probe"), "_i")
    to = F.when(F.col("_probe") == 0, F.col("_i"))
    linked = scan(later.unionByName(probes), keys, ["_at", "_probe", "_i"], _to=next_after(to))
    jump = settle(linked.filter("_probe = 1 AND _to IS NOT NULL").select(*keys, "_i", "_to"))
    reached = held.filter("_i = 1").select(*keys, "_i")
    while not jump.isEmpty():
        new = jump.join(reached, _same(jump, reached, [*keys, "_i"]), "left_semi").select(*keys, F.col("_to").alias("_i"))
        reached = settle(reached.unionByName(new))
        ahead = jump.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_i").alias("_from"), F.col("_to").alias("_then"))
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)], F.col("_to") == F.col("_from"))
        jump = settle(jump.join(ahead, on).select(*keys, "_i", F.col("_then").alias("_to")))
    mark = reached.withColumn("kept", F.lit(True))
    both = held.join(mark, _same(held, mark, [*keys, "_i"]), "left")
    return both.select(*[held[c] for c in keep], F.coalesce(mark["kept"], F.lit(False)).alias("kept"))


def suppress_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str], window_s: int,
                    keep: Sequence[str], short: int = SHORT) -> DataFrame:
    """``keep`` columns and ``kept``: false for a row within ``window_s`` of the last row that was kept.

    Rows farther apart than the window cannot touch each other, so a key is first cut at
    such gaps.  Short stretches are settled a stretch a row, longer ones by doubling; ``order``
    begins with ``ts_s`` and tells the rows of a key apart.
    """
    from .episodes import segments

    own = [*keys, "segment"]
    cut = settle(segments(rows.select(*dict.fromkeys([*keys, *order, *keep])), keys, order, F.lit(False), window_s))
    long = settle(cut.groupBy(*own).count().filter(F.col("count") > short).drop("count"))
    if long.isEmpty():
        return _kept_short(cut, own, order, window_s, keep)
    same = _same(cut, long, own)
    few = _kept_short(cut.join(long, same, "left_anti"), own, order, window_s, keep)
    return few.unionByName(_kept_long(cut.join(long, same, "left_semi"), own, order, window_s, keep))


def novelty(rows: DataFrame, keys: Sequence[str], order: Sequence[str], refractory_s: int,
            keep: Sequence[str]) -> DataFrame:
    """Which rows are news: nothing rang yet, more objects than since the last ring, or a
    new event once the refractory time is over.  ``rows`` has segment, count, says_new."""

    def step(state: dict, row: dict) -> dict:
        last, peak = state.get("rang"), state.get("peak", 0)
        news = last is None or row["count"] > peak or (
            row["ts_s"] - last >= refractory_s and bool(row["says_new"]))
        state["peak"] = row["count"] if news else max(peak, row["count"])
        if news:
            state["rang"] = row["ts_s"]
        return {"audible": news}

    return fold_sorted(rows, [*keys, "segment"], order, step, keep, "audible BOOLEAN")

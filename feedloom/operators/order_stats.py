"""Exact order statistics from a histogram instead of a sorted list per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Running, scan


def picks(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None,
          **ranks: str) -> DataFrame:
    """One row per key: count ``n`` and the values standing at the given ranks.

    A rank is a 0-based index, written in SQL over the count ``n``.  Rows are first counted per value (map-side), so the
    ordered part sees distinct values only, and those are scanned in pieces.
    """
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("_w"))
    )
    cum = scan(hist, keys, [value], _cum=Running("sum", F.col("_w"), True))
    totals = hist.groupBy(*keys).agg(F.sum("_w").alias("n"))
    if keys:
        wide = cum.join(totals, list(keys))
    else:
        wide = cum.crossJoin(totals)  # one total row
    lo = F.col("_cum") - F.col("_w")
    return wide.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[
            F.max(F.when((lo <= F.expr(rank)) & (F.expr(rank) < F.col("_cum")), F.col(value))).alias(name)
            for name, rank in ranks.items()
        ],
    )


# Ranks as SQL over the count ``n``, 0-based.
UPPER_MEDIAN = "floor(n / 2)"
LOW_MIDDLE = "floor((n - 1) / 2)"
P90 = "floor(n * 0.9D)"
P90_CLAMPED = "least(floor(n * 0.9D), n - 1)"
LARGEST = "n - 1"

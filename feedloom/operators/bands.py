"""Windows shared by two feeds, and leads inside a time band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clip_common(a: DataFrame, b: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Both feeds cut to the interval both cover."""
    ends = [x.agg(F.min(at).alias(f"lo{i}"), F.max(at).alias(f"hi{i}")) for i, x in enumerate((a, b))]
    # Two one-row aggregates: the product is one row.
    span = ends[0].crossJoin(ends[1]).select(
        F.greatest("lo0", "lo1").alias("_lo"), F.least("hi0", "hi1").alias("_hi"))

    def cut(x: DataFrame) -> DataFrame:
        return x.join(F.broadcast(span), (F.col(at) >= F.col("_lo")) & (F.col(at) <= F.col("_hi"))).drop("_lo", "_hi")

    return cut(a), cut(b)

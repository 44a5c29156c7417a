"""Nearest-row joins without pairs.

Both sides are stacked into one ordered feed and the wanted right-hand value is
carried to each left-hand row with :func:`scan`, so the work is one sort of
both sides and never the number of pairs inside a time band.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Running, scan


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: Column,
    right_at: Column,
    payload: Sequence[str],
    ident: Sequence[str],
    out: str,
    forward: bool = False,
    strict: bool = False,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Each left row plus ``out``: a struct of ``payload`` of the nearest right row.

    backward: last right row with right_at <= at; forward: first with
    right_at >= at; ``strict`` excludes equality.  ``ident`` are the columns that
    identify a left row, ``tie`` orders right rows of one instant.
    """
    # Position of the two sides at one instant.
    right_first = forward == strict
    r_side, l_side = (0, 1) if right_first else (1, 0)
    lcols = left.columns
    l = left.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        at.alias("_at"),
        F.lit(l_side).alias("_side"),
        *[F.col(c).cast("string").alias(f"_o{i}") for i, c in enumerate(ident)],
        F.struct(*lcols).alias("_left"),
    )
    ties = list(tie) + [None] * (len(ident) - len(tie))
    r = right.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        right_at.alias("_at"),
        F.lit(r_side).alias("_side"),
        *[
            (F.lpad(F.col(c).cast("string"), 24, "0") if c else F.lit(None).cast("string")).alias(f"_o{i}")
            for i, c in enumerate(ties[: len(ident)])
        ],
        F.struct(right_at.alias("_rt"), *payload).alias("_right"),
    )
    both = l.unionByName(r, allowMissingColumns=True)
    kcols = [f"_k{i}" for i in range(len(keys))]
    ocols = ["_at", "_side", *[f"_o{i}" for i in range(len(ident))]]
    done = scan(both, kcols, ocols, _hit=Running("last", F.col("_right"), False, forward))
    return done.filter(F.col("_left").isNotNull()).select("_left.*", F.col("_hit").alias(out))


def within(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: Column,
    right_at: Column,
    before: int,
    after: int,
    ident: Sequence[str],
    out: str,
) -> DataFrame:
    """Left rows plus ``out``: the earliest right time in [at-before, at+after], or null."""
    hit = asof(
        left, right, keys, at - before, right_at, [], ident, "_first_in", forward=True
    )
    near = F.col("_first_in._rt")
    return hit.withColumn(out, F.when(near <= at + after, near)).drop("_first_in")

"""Running values over an ordered feed, whatever the size of one key.

A plain window puts a whole key into one task.  Here the frame is range
partitioned on (keys, order), so a hot key is spread over many pieces; windows
run inside the pieces, one small row per piece carries the result forward, and
the carry is added back.  The carry table has at most one row per piece, which
is why it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, width

PIECE = "_piece"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is last, sum, max or min."""

    kind: str
    value: Column
    inclusive: bool = False
    reverse: bool = False


def last_before(value: Column, inclusive: bool = False) -> Running:
    """Last non-null value on an earlier row (or this one)."""
    return Running("last", value, inclusive)


def next_after(value: Column, inclusive: bool = False) -> Running:
    """First non-null value on a later row (or this one)."""
    return Running("last", value, inclusive, True)


def sum_so_far(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def max_so_far(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def row_index() -> Running:
    """1-based position of the row inside its key."""
    return Running("sum", F.lit(1).cast("long"), True)


def _local(spec: Running, col: str, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
    fn = {
        "last": lambda c: F.last(c, ignorenulls=True),
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
    }[spec.kind]
    return fn(F.col(col)).over(frame)


def _total(spec: Running, col: str, order: Sequence[str]) -> Column:
    if spec.kind == "last":
        at = F.when(F.col(col).isNotNull(), F.struct(*order))
        return (F.min_by if spec.reverse else F.max_by)(F.col(col), at)
    return {"sum": F.sum, "max": F.max, "min": F.min}[spec.kind](F.col(col))


def _carried(spec: Running, col: str, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1)
    if spec.kind == "last":
        return F.last(F.col(col), ignorenulls=True).over(frame)
    return {"sum": F.sum, "max": F.max, "min": F.min}[spec.kind](F.col(col)).over(frame)


def _joined(spec: Running, local: Column, carry: Column) -> Column:
    if spec.kind == "last":
        return F.coalesce(local, carry)
    if spec.kind == "sum":
        return F.when(
            local.isNull() & carry.isNull(), F.lit(None)
        ).otherwise(F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    return (F.greatest if spec.kind == "max" else F.least)(local, carry)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    pieces: int | None = None,
    again: bool = False,
    keep_pieces: bool = False,
    **outs: Running,
) -> DataFrame:
    """``df`` with one column per entry of ``outs``.

    ``order`` must make rows of one key distinct, so that the result does not
    depend on how ties fall.  ``keep_pieces`` leaves the piece number in the result, so
    that the next scan over the same keys and order (``again``) need not cut anew.
    """
    names = list(outs)
    cols = {n: f"_in_{n}" for n in names}
    width_ = pieces or width(df.sparkSession)
    fed = df.select("*", *[outs[n].value.alias(cols[n]) for n in names])
    if not again:
        fed = fed.repartitionByRange(width_, *keys, *order).withColumn(PIECE, F.spark_partition_id())
    cut = settle(fed)

    totals = cut.groupBy(*keys, PIECE).agg(
        *[_total(outs[n], cols[n], order).alias(f"_t_{n}") for n in names]
    )
    ahead = Window.partitionBy(*keys).orderBy(F.col(PIECE).asc())
    back = Window.partitionBy(*keys).orderBy(F.col(PIECE).desc())
    spread = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    carry = (
        totals.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col(PIECE).alias("_k_piece"),
            spread.alias("_spread"),
            *[
                _carried(outs[n], f"_t_{n}", back if outs[n].reverse else ahead).alias(f"_c_{n}")
                for n in names
            ],
        )
        .filter(F.col("_spread") > 1)
        .drop("_spread")
    )

    fwd = Window.partitionBy(*keys, PIECE).orderBy(*[F.col(o).asc() for o in order])
    rev = Window.partitionBy(*keys, PIECE).orderBy(*[F.col(o).desc() for o in order])
    local = cut.select(
        "*",
        *[
            _local(outs[n], cols[n], rev if outs[n].reverse else fwd).alias(f"_l_{n}")
            for n in names
        ],
    )
    on = F.col(PIECE) == F.col("_k_piece")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # At most two rows per piece survive the filter on _spread: safe to broadcast.
    both = local.join(F.broadcast(carry), on, "left")
    return both.select(
        *[c for c in df.columns if c != PIECE],
        *([PIECE] if keep_pieces else []),
        *[
            _joined(outs[n], F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n)
            for n in names
        ],
    )

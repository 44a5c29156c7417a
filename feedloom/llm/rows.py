"""Arrow helpers: a Python function over the texts of a frame, a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE = 256


def map_texts(
    df: DataFrame,
    text: str,
    fn: Callable[[list[str | None]], Iterable[Sequence]],
    out: T.StructType,
    keep: Sequence[str],
    rows: int = SLICE,
) -> DataFrame:
    """``keep`` columns of ``df`` plus what ``fn`` makes of each text, one tuple a row.

    ``fn`` gets the whole texts of at most ``rows`` rows at once; nulls stay None.  No row is
    added or lost and nothing is shuffled.
    """
    narrow = df.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([narrow.schema[k] for k in keep] + out.fields)
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = list(zip(*fn(part.column(len(names) - len(kinds)).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + [pa.array(c, k) for c, k in zip(made, kinds)],
                    names=names,
                )

    return narrow.mapInArrow(run, schema)


def boxed(df: DataFrame, *more) -> DataFrame:
    """Every column of ``df`` held in one struct, so that added names cannot clash."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), *more)


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


_STEPS = 16  # buckets of weights for each doubling


def most(df: DataFrame, weight: str, at_most: int) -> tuple[DataFrame, bool]:
    """Rows of the largest positive weights, at most ``at_most``, and whether those are all.

    The cut lies between buckets of weights, which are counted (some hundred rows reach the
    driver), so nothing is sorted and no task sees more than its own rows.
    """
    bucket = F.floor(F.log2(weight) * _STEPS)
    sizes = sorted(((r["b"], r["count"]) for r in df.groupBy(bucket.alias("b")).count().collect()), reverse=True)
    taken, low = 0, None
    for b, n in sizes:
        if taken + n > at_most:
            break
        taken, low = taken + n, b
    return df.filter(bucket >= low if low is not None else F.lit(False)), taken == sum(n for _, n in sizes)

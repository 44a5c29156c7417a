"""Posts of headed sections with members under them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space


def _heading(line: Column, headings: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(headings):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def sections_of(c: Column, target: str, headings: Sequence[tuple[str, str]],
                bullet: str = "^• *") -> Column:
    """The sections the target stands under, in one pass over the lines."""
    lines = F.filter(
        F.transform(F.split(c, "\n"), trim_space), lambda x: x != "")
    named = F.transform(lines, lambda x: F.struct(
        _heading(x, headings).alias("head"),
        F.regexp_replace(x, bullet, "").rlike(target).alias("hit")))
    start = F.struct(
        F.lit(None).cast("string").alias("section"), F.array().cast("array<string>").alias("said"))

    def step(acc: Column, x: Column) -> Column:
        under = x["head"].isNull() & x["hit"] & acc["section"].isNotNull()
        return F.struct(
            F.coalesce(x["head"], acc["section"]).alias("section"),
            F.when(under, F.array_union(acc["said"], F.array(acc["section"])))
            .otherwise(acc["said"]).alias("said"),
        )

    return F.aggregate(named, start, step, lambda acc: acc["said"])


def section_pick(df: DataFrame, target: str, headings: Sequence[tuple[str, str]],
                 rank: Sequence[str], forms: dict[str, str], channel: str,
                 channel_col: str = "channel", text_col: str = "text") -> DataFrame:
    """The sectioned channel reduced to the target's best section in its canonical
    words; posts that say nothing are dropped, other channels pass unchanged."""
    said = sections_of(F.col(text_col), target, headings)
    best = F.lit(None).cast("string")
    for name in reversed(rank):
        best = F.when(F.array_contains(said, name), forms[name]).otherwise(best)
    mine = F.col(channel_col) == channel
    return (
        df.withColumn("_form", F.when(mine, best))
        .filter(~mine | F.col("_form").isNotNull())
        .withColumn(text_col, F.when(mine, F.col("_form")).otherwise(F.col(text_col)))
        .drop("_form")
    )

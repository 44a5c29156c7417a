"""Sentences for decisions, and what each recipient has already been told."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import last_before, row_index, scan

CAUSE_TTL_S = 600


def announce(rows: DataFrame, keys: Sequence[str], order: Sequence[str], leads: Mapping[str, str],
             words: Mapping[str, str], ttl_s: int = CAUSE_TTL_S) -> DataFrame:
    """``lead`` and ``text`` of every spoken row.

    The lead comes from the tone.  The cause (class and places) follows unless the same
    cause was spoken in this stretch within ``ttl_s``; a launch is led once per class and
    a declaration once per stretch.  Rows without a cause say the first line of their
    source.  ``rows`` has segment, level, tone, cls, places (sorted), source, is_launch.
    """
    spoken = rows.filter("level IS NOT NULL")
    table = lambda m, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c)
    cause = F.when(
        F.col("cls").isNotNull() | (F.size("places") > 0),
        F.concat_ws(" ", table(words, F.col("cls")), F.nullif(F.array_join("places", ", "), F.lit(""))))
    spoken = spoken.withColumn("cause", cause)
    keep = [*keys, "segment"]
    told = scan(spoken, [*keep, "cause"], order, _told=last_before(F.col("ts_s")))
    lead_key = F.when(F.col("is_launch"), F.concat(F.lit("launch:"), F.coalesce("cls", F.lit("")))).when(
        F.col("tone") == "alert", "alert")
    told = scan(told.withColumn("_lk", lead_key), [*keep, "_lk"], order, _nth=row_index())
    lead = F.when(F.col("_lk").isNull() | (F.col("_nth") == 1), table(leads, F.col("tone")))
    fresh = F.col("_told").isNull() | (F.col("ts_s") - F.col("_told") > ttl_s)
    body = F.when(F.col("cause").isNotNull() & fresh, F.col("cause"))
    fallback = F.when(lead.isNull() & body.isNull(), F.element_at(F.split("source", "\n"), 1))
    return told.withColumn("lead", lead).withColumn(
        "text", F.concat_ws(" ", "lead", body, fallback)).drop("_told", "_lk", "_nth", "cause")

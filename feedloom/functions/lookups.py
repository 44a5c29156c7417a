"""Small fixed lookups as columns, and the JSON codec of state structs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_for(key: Column, words: Mapping[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def encode_state(state: Column) -> Column:
    """State struct to JSON; sets are expected sorted by the caller."""
    return F.to_json(state)


def decode_state(text: Column, schema: str, defaults: Mapping[str, Column]) -> Column:
    """JSON to struct: unknown keys ignored, missing ones take their default."""
    got = F.from_json(text, schema)
    return F.struct(
        *[
            F.coalesce(got[name], default).alias(name)
            for name, default in defaults.items()
        ]
    )


def delivery_route(level: Column, tone: Column) -> Column:
    """Which sound channel a line goes to; an all-clear is told first."""
    return (
        F.when(tone.isin("clear", "clear-partial"), "clear")
        .when(F.coalesce(level, F.lit("")) != "alert", "quiet")
        .when(tone == "ballistic", "shelter")
        .when(tone == "alert", "siren")
        .otherwise("near")
    )

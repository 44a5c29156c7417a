"""Time, key and cursor columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NIGHT_START_HOUR = 15
WINDOW_MIN_S = 60
WINDOW_MAX_S = 86400


def epoch_s(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less UTC timestamp, in any session zone."""
    us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)
    return F.floor(us / 1000000).cast("long")


def from_epoch(s: Column) -> Column:
    """Zone-less UTC timestamp of epoch seconds."""
    return F.timestamp_add("SECOND", s, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def local_time(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def night_id(ts: Column, zone: str, start_hour: int = NIGHT_START_HOUR) -> Column:
    """Date of the evening a row belongs to: the day turns at ``start_hour``."""
    return F.to_date(F.timestamp_add("HOUR", F.lit(-start_hour), local_time(ts, zone)))


def local_hour(ts: Column, zone: str) -> Column:
    return F.hour(local_time(ts, zone))


def anchor(channel: Column, message_id: Column) -> Column:
    return F.concat_ws("/", channel, message_id.cast("string"))


def split_anchor(a: Column) -> tuple[Column, Column]:
    return F.split_part(a, F.lit("/"), F.lit(1)), F.split_part(a, F.lit("/"), F.lit(2)).try_cast("long")


def cursor(ts_s: Column, channel: Column, message_id: Column) -> Column:
    return F.concat_ws(".", ts_s.cast("string"), channel, message_id.cast("string"))


def parse_cursor(c: Column) -> Column:
    """struct(ts, channel, id); anything malformed is the beginning of the feed."""
    parts = F.split(c, "\\.", 3)
    ts = F.try_element_at(parts, F.lit(1)).try_cast("long")
    mid = F.try_element_at(parts, F.lit(3)).try_cast("long")
    good = (F.size(parts) == 3) & ts.isNotNull() & mid.isNotNull()
    return F.struct(
        F.when(good, ts).otherwise(F.lit(0).cast("long")).alias("ts"),
        F.when(good, F.try_element_at(parts, F.lit(2))).otherwise(F.lit("")).alias("channel"),
        F.when(good, mid).otherwise(F.lit(0).cast("long")).alias("id"),
    )


def parse_window(c: Column) -> Column:
    """Seconds of ``30m``, ``2h``, ``45s`` or a bare number, clamped; null if bad."""
    raw = F.lower(F.trim(c))
    number = F.regexp_extract(raw, "^(-?[0-9]+(?:\\.[0-9]+)?)[mhs]?$", 1)
    unit = F.when(raw.endswith("m"), 60).when(raw.endswith("h"), 3600).otherwise(1)
    whole = F.nullif(number, F.lit("")).try_cast("double").cast("long")
    secs = whole * unit
    return F.when(
        secs.isNotNull(), F.least(F.greatest(secs, F.lit(WINDOW_MIN_S)), F.lit(WINDOW_MAX_S))
    ).cast("long")


def in_hours(hour: Column, start: Column, end: Column) -> Column:
    """Whether ``hour`` lies in [start, end), which may wrap midnight."""
    return F.when(start <= end, (start <= hour) & (hour < end)).otherwise(
        (hour >= start) | (hour < end)
    )


def sounds_at(hour: Column, cls: Column, quiet: Column, start: Column, end: Column,
              allowed: list[str]) -> Column:
    """Whether a class may sound at this hour under quiet hours."""
    return ~quiet | ~in_hours(hour, start, end) | F.coalesce(cls.isin(*allowed), F.lit(False))


def version_of(state: Column) -> Column:
    """Short digest of a state struct (pass it without its timestamp)."""
    return F.substring(F.sha2(F.to_json(state), 256), 1, 16)

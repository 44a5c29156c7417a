"""Recipients: settings over shared defaults, cleaned and compared."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds outside which a setting stops being a preference.
BOUNDS = {
    "ring_memory_s": (60, 3600),
    "refractory_near_s": (30, 1800),
    "refractory_s": (60, 3600),
    "inherit_class_s": (60, 3600),
    "silent_dedup_s": (5, 600),
    "home_dedup_s": (0, 600),
    "launch_dedup_s": (30, 1800),
    "idle_close_s": (300, 21600),
    "radius_km": (0, 50),
    "same_target_sector_deg": (0, 360),
    "quiet_from_hour": (0, 23),
    "quiet_to_hour": (0, 23),
}
# Most names of a list, most letters of a name.
MAX_RING = 128
MAX_NAME = 64


def over_defaults(rows: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Each setting of a row, or the shared default where it has none."""
    keep = [c for c in rows.columns if c not in defaults]
    return rows.select(
        *keep,
        *[F.coalesce(F.col(c), v).alias(c) if c in rows.columns else v.alias(c)
          for c, v in defaults.items()],
    )


def recipients(rows: DataFrame, shipped: DataFrame, name: str, order: str) -> DataFrame:
    """The shipped recipient first, then the index, one row per name."""
    reserved = shipped.select(name)
    rest = [c for c in rows.columns if c != name]
    first = rows.groupBy(name).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(
        name, *[F.col(f"_r.{c}").alias(c) for c in rest])
    others = first.join(reserved, name, "left_anti")
    return shipped.withColumn("place", F.lit(0)).unionByName(
        others.withColumn("place", F.lit(1)), allowMissingColumns=True)


def clean_number(raw: Column, name: str, default: int) -> tuple[Column, Column]:
    """(value, note): a JSON scalar made a clamped number, and what was done."""
    lo, hi = BOUNDS[name]
    number = F.when(raw.rlike("^-?[0-9]+(\\.[0-9]+)?$"), raw).try_cast("double")
    fixed = F.least(F.greatest(number, F.lit(float(lo))), F.lit(float(hi)))
    value = F.when(number.isNull(), F.lit(default)).otherwise(fixed.cast("int"))
    note = (
        F.when(raw.isNull(), F.lit(None))
        .when(number.isNull(), "type")
        .when(fixed != number, "clamped")
    )
    return value.cast("long"), note.cast("string")


def clean_flag(raw: Column, default: bool) -> tuple[Column, Column]:
    value = F.when(raw == "true", True).when(raw == "false", False).otherwise(F.lit(default))
    note = F.when(raw.isNotNull() & ~raw.isin("true", "false"), "type")
    return value, note.cast("string")


def clean_names(raw: Column, default: Column, max_len: int = MAX_RING, max_name: int = MAX_NAME) -> tuple[Column, Column]:
    """A JSON list of names with its length and each name capped, as the settings contract says."""
    names = F.from_json(raw, "array<string>")
    value = F.transform(F.slice(F.coalesce(names, default), 1, max_len), lambda x: F.left(x, F.lit(max_name)))
    note = (
        F.when(raw.isNull(), F.lit(None))
        .when(names.isNull(), "type")
        .when((F.size(names) > max_len) | F.exists(names, lambda x: F.length(x) > max_name), "clipped")
    )
    return value, note.cast("string")


def unknown_keys(raw: Column, known: Sequence[str]) -> Column:
    """Keys that are neither settings nor comments (a leading underscore)."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.filter(keys, lambda k: ~k.startswith("_") & ~k.isin(*known))


def unpivot_fields(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    return df.select(key, *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(
        [key], list(fields), "field", "value")


def config_diff(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per field that differs between two sets of settings."""
    left = unpivot_fields(a, key, fields).withColumnRenamed("value", "old")
    right = unpivot_fields(b, key, fields).withColumnRenamed("value", "new")
    return left.join(right, [key, "field"], "full_outer").filter(
        ~F.col("old").eqNullSafe(F.col("new")))


def differs_from(df: DataFrame, key: str, defaults: Mapping[str, Column]) -> DataFrame:
    """Only the fields that differ from their default."""
    shipped = df.select(key, *[v.alias(c) for c, v in defaults.items()])
    return config_diff(shipped, df, key, list(defaults))

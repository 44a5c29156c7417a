"""Place extracts: one best row per name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENT = (
    "struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,"
    "tags:map<string,string>>"
)


def poi_places(raw: DataFrame, col: str, local_name: str, kinds: Sequence[str]) -> DataFrame:
    """Named places with a point; ``kinds`` runs from most to least important."""
    el = raw.select(F.explode(F.from_json(F.col(col), f"array<{ELEMENT}>")).alias("e"))
    tags = F.col("e.tags")
    rows = el.select(
        F.coalesce(
            F.nullif(F.try_element_at(tags, F.lit(local_name)), F.lit("")),
            F.nullif(F.try_element_at(tags, F.lit("name")), F.lit(""))).alias("name"),
        F.coalesce(F.try_element_at(tags, F.lit("place")), F.lit("")).alias("kind"),
        F.round(F.coalesce("e.lat", "e.center.lat"), 5).alias("lat"),
        F.round(F.coalesce("e.lon", "e.center.lon"), 5).alias("lon"),
        F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("osm"),
    ).filter("name IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    order = F.array(*[F.lit(k) for k in kinds])
    place = F.array_position(order, F.col("kind"))
    rank = F.when(place > 0, place).otherwise(len(kinds) + 1)
    return rows.groupBy("name").agg(
        F.min_by(F.struct("kind", "lat", "lon", "osm"), F.struct(rank, "osm")).alias("p")
    ).select("name", "p.*")

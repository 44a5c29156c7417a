"""Rings, sectors and points over tables of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import AT_HOME_KM, bearing, circular_spread, haversine_km
from ..session import settle
from .scan import next_after, scan

CELL_DEG = 1.0
SPREAD_LIMIT_KM = 8.0


def _cell(c):
    return F.floor(c / CELL_DEG).cast("int")


def _around(x):
    """Cells of longitude, numbered once round the globe."""
    return F.pmod(x, F.lit(round(360 / CELL_DEG)))


def within_radius(recipients: DataFrame, points: DataFrame) -> DataFrame:
    """(recipient, place) pairs not farther than the recipient's radius.

    Recipients meet only the points of the grid cells their circle can reach, so the
    join is on the cell.  The longitude reach widens with latitude.
    """
    dlat = F.col("radius_km") / 110.0
    dlon = F.least(F.lit(180.0), F.col("radius_km") / (111.0 * F.greatest(F.cos(F.radians(F.abs("home_lat") + dlat)), F.lit(0.01))))
    cells = recipients.withColumn("_y", F.explode(F.sequence(_cell(F.col("home_lat") - dlat), _cell(F.col("home_lat") + dlat))))
    cells = cells.withColumn("_x", F.explode(F.array_distinct(F.transform(
        F.sequence(_cell(F.col("home_lon") - dlon), _cell(F.col("home_lon") + dlon)), _around))))
    spots = points.withColumn("_y", _cell(F.col("lat"))).withColumn("_x", _around(_cell(F.col("lon"))))
    km = haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon"))
    return cells.join(spots, ["_y", "_x"]).withColumn("km", km).filter(
        F.col("km") <= F.col("radius_km")).drop("_y", "_x")


CIRCLE = ["radius_km", "home_lat", "home_lon"]
SETTING = ["home", "ring", "ring_drop", *CIRCLE]


def ring_names(recipients: DataFrame, points: DataFrame) -> DataFrame:
    """Home and the hand list, with every name inside the radius, less the dropped ones.

    A row a recipient; several rows of one add up.  Recipients with equal settings have equal
    rings: points are measured once a circle and rings are made once a setting.
    """
    own = settle(recipients.groupBy("recipient").agg(F.sort_array(F.collect_set(F.struct(*SETTING))).alias("_set")))
    sets = own.select("_set").distinct().select("_set", F.explode("_set").alias("_s")).select("_set", "_s.*")
    circles = sets.filter("radius_km > 0 AND home_lat IS NOT NULL").select(*CIRCLE).distinct()
    near = within_radius(circles, points).groupBy(*CIRCLE).agg(F.collect_set("name").alias("_near"))
    none = F.array().cast("array<string>")
    home = F.when(F.col("home").isNotNull(), F.array("home")).otherwise(none)
    every = F.array_union(F.array_union(home, F.coalesce("ring", none)), F.coalesce("_near", none))
    each = sets.join(near, CIRCLE, "left").select("_set", F.array_except(every, F.coalesce("ring_drop", none)).alias("ring"))
    rings = each.groupBy("_set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ring")))).alias("ring"))
    return own.join(rings, "_set").select("recipient", "ring")


def worth_saying(named: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Of several names: those inside one sector are one thing, say the nearest.

    ``named`` has key, names (array), home_lat, home_lon, sector.
    """
    each = named.select(key, "home_lat", "home_lon", "sector", F.posexplode("names").alias("pos", "name"))
    at = each.join(points, "name", "left").withColumn(
        "km", haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon"))).withColumn(
        "deg", bearing(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon")))
    # One row per name of a message: as many as a message has names.
    got = at.groupBy(key).agg(
        F.count("*").alias("n"), F.count("km").alias("placed"), F.min("km").alias("best"),
        F.min_by("name", F.struct("km", "name")).alias("nearest"),
        F.collect_list(F.when(F.col("km") > AT_HOME_KM, F.col("deg"))).alias("degs"))
    j = named.join(got, key, "left")
    one = F.array("nearest")
    unchanged = (F.col("home_lat").isNull() | (F.col("sector") <= 0) | (F.size("names") < 2)
                 | (F.col("placed") < F.col("n")))
    return j.select(
        key, F.when(unchanged, F.col("names")).when(F.col("best") <= AT_HOME_KM, one)
        .when(circular_spread(F.col("degs")) > F.col("sector"), F.col("names")).otherwise(one).alias("said"))


def match_points(place: DataFrame, poi: DataFrame, home: tuple[float, float], hand: DataFrame,
                 too_big: DataFrame) -> DataFrame:
    """A coordinate per dictionary entry and how it was found.

    Candidates carry one of the entry's stems in their name and lie within its tier's
    limit; they are looked up by every part of the name that has a stem's length, so
    the join is on that part.  ``place`` has name, stems, limit_km.
    """
    far = haversine_km(F.lit(home[0]), F.lit(home[1]), F.col("lat"), F.col("lon"))
    stems = place.select("name", "limit_km", F.explode("stems").alias("stem"))
    sizes = stems.select(F.length("stem").alias("size")).distinct()
    spots = poi.select(F.lower("name").alias("low"), "lat", "lon", "osm", far.alias("far"))
    # Parts of a short name, for each stem length that occurs.
    parts = spots.withColumn("size", F.explode(F.sequence(F.lit(1), F.length("low")))).join(sizes, "size")
    parts = parts.withColumn("stem", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("low") - F.col("size") + 1),
        lambda i: F.substring(F.col("low"), i, F.col("size")))))
    cand = parts.join(stems, "stem").filter(F.col("far") <= F.col("limit_km")).select(
        "name", "low", "lat", "lon", "osm", "far").distinct()
    cand = cand.withColumn("exact", F.col("low") == F.lower("name"))
    best = cand.groupBy("name").agg(
        F.min_by(F.struct("lat", "lon"), F.when(F.col("exact"), F.struct("far", "osm"))).alias("e"),
        F.count("*").alias("n"), F.avg("lat").alias("alat"), F.avg("lon").alias("alon"))
    got = best.select(
        "name", F.col("e").isNotNull().alias("by_name"), F.coalesce("e.lat", "alat").alias("clat"),
        F.coalesce("e.lon", "alon").alias("clon"), F.when(F.col("e").isNotNull(), 1).otherwise(F.col("n")).alias("n"))
    reach = got.join(cand.select("name", "lat", "lon"), "name").groupBy("name").agg(
        F.max(haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))).alias("r"))
    got = got.join(reach, "name").withColumn("spread_km", F.when(F.col("by_name"), 0.0).otherwise(F.col("r")))
    out = place.join(too_big, "name", "left_anti").join(got, "name", "left").join(
        hand.select("name", F.col("lat").alias("hlat"), F.col("lon").alias("hlon")), "name", "left")
    by_hand = F.col("hlat").isNotNull()
    return out.select(
        "name",
        F.when(by_hand, F.col("hlat")).otherwise(F.round("clat", 5)).alias("lat"),
        F.when(by_hand, F.col("hlon")).otherwise(F.round("clon", 5)).alias("lon"),
        F.when(by_hand, "hand").when(F.col("clat").isNull(), "missing").when(F.col("by_name"), "name")
        .when(F.col("spread_km") > SPREAD_LIMIT_KM, "flagged").otherwise("centroid").alias("how"),
        F.when(by_hand, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"),
        F.when(by_hand, 0.0).otherwise(F.round("spread_km", 3)).alias("spread_km"))


def arcs(rows: DataFrame, key: str, degrees: str) -> DataFrame:
    """(key, n, spread): the smallest arc that holds all bearings of a key, exactly, in bounded memory.

    A summary has the least and the greatest bearing of each whole degree, at most 360 pairs a
    key, and merges pair by pair.  Between degrees it knows every gap; a gap inside one is
    under a degree and can be the widest only where all others are too: there the bearings
    themselves are put in order, over all tasks.
    """
    seen = rows.select(key, F.pmod(F.col(degrees), F.lit(360.0)).alias("_deg")).filter("_deg IS NOT NULL")
    cells = seen.groupBy(key, F.floor("_deg").alias("_cell")).agg(F.min("_deg").alias("low"), F.max("_deg").alias("high"), F.count("*").alias("c"))
    per = cells.groupBy(key).agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ring"))
    lows = F.transform("ring", lambda x: x["low"])
    after = F.concat(F.slice(lows, F.lit(2), F.size(lows) - 1), F.array(F.element_at(lows, 1) + F.lit(360.0)))
    widest = F.array_max(F.zip_with(after, F.transform("ring", lambda x: x["high"]), lambda b, a: b - a))
    per = settle(per.select(key, "n", widest.alias("widest")))
    full = per.filter((F.col("widest") < 1) & (F.col("n") > 1))
    if not full.isEmpty():
        near = seen.join(full.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi").distinct()
        gaps = scan(near, [key], ["_deg"], _next=next_after(F.col("_deg")))
        inside = gaps.groupBy(F.col(key).alias("_key")).agg(F.max(F.col("_next") - F.col("_deg")).alias("inside"))
        per = per.join(inside, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("widest", F.greatest("widest", "inside")).drop("_key", "inside")
    return per.select(key, "n", F.when(F.col("n") > 1, F.lit(360.0) - F.col("widest")).otherwise(0.0).alias("spread"))

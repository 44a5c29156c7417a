"""Distances, bearings and sectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
AT_HOME_KM = 0.4


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), 2
    )
    # Rounding may lift h over 1; a missing coordinate must stay missing.
    return F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h))) * (2 * EARTH_KM)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 north, clockwise."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def circular_spread(bearings: Column) -> Column:
    """Smallest arc holding all bearings: 360 less the widest gap, 0 for under two."""
    ring = F.array_sort(bearings)
    n = F.size(ring)
    nxt = F.concat(
        F.slice(ring, F.lit(2), n - 1),
        F.array(F.element_at(ring, 1) + F.lit(360.0)),
    )
    gaps = F.zip_with(nxt, ring, lambda b, a: b - a)
    return F.when(n >= 2, F.lit(360.0) - F.array_max(gaps)).otherwise(F.lit(0.0))

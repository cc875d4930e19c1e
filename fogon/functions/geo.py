"""Great-circle distance and travel time as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius (km), central kitchen, average courier speed (km/h).
EARTH_RADIUS_KM = 6371.0
KITCHEN_LAT, KITCHEN_LNG = 9.9333, -84.0833
AVG_SPEED_KMH = 28.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlng = F.radians(lng2 - lng1) / 2
    h = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_dlng) * F.sin(half_dlng)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def km_from_kitchen(lat: Column, lng: Column) -> Column:
    return haversine_km(F.lit(KITCHEN_LAT), F.lit(KITCHEN_LNG), lat, lng)


def tenths_half_even(value: Column) -> Column:
    """Non-negative double rounded to tenths by its exact binary value, as BIGINT.

    SQL ROUND works on the printed decimal, so 0.15 (stored slightly below) goes up
    to 0.2; rounding the stored value gives 0.1. 20*value is compared with the odd
    midpoint 2j+1 as (16*value - (2j+1)) + 4*value, where every step is exact.
    """
    j = F.floor(value * 10).cast("bigint")
    midpoint = (2 * j + 1).cast("double")
    side = (value * 16 - midpoint) + value * 4
    up = (side > 0) | ((side == 0) & (F.pmod(j, F.lit(2)) == 1))
    return j + F.when(up, 1).otherwise(0)


def travel_minutes_tenths(km: Column, speed_kmh: float = AVG_SPEED_KMH) -> Column:
    """Travel time for ``km`` in tenths of a minute."""
    return tenths_half_even(km / F.lit(float(speed_kmh)) * 60)

"""Great-circle distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.numbers import round_half_up

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(EARTH_RADIUS_KM * 2) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def approximate_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance rounded to 0.1 km; null when a coordinate is out of range."""
    inside = valid_coordinates(lat1, lon1) & valid_coordinates(lat2, lon2)
    return F.when(inside, round_half_up(haversine_km(lat1, lon1, lat2, lon2), 1))


def distance_label(km: Column) -> Column:
    return F.concat(F.lit("≈ "), F.format_string("%.1f", km), F.lit(" km straight-line"))

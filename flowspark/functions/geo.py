"""Great-circle distance and grid cells for proximity joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
METRES_PER_DEGREE = 111000.0  # below the true value, so that a cell is never narrower than the radius


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def cell(coord, radius_km: float, scale: float = 1.0) -> Column:
    """Grid cell at least ``radius_km`` wide along one axis (``scale`` shrinks longitude degrees)."""
    coord = F.col(coord) if isinstance(coord, str) else coord
    return F.floor(coord * F.lit(METRES_PER_DEGREE * scale / (radius_km * 1000.0))).cast("long")

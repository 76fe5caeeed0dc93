"""Geospatial expressions (G1, G3) — plain double arithmetic, kept inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius (km) of the serving queries; the ETL distance uses the mean radius.
SERVING_RADIUS_KM = 6371.0
ETL_RADIUS_KM = 6371.0088
MERCATOR_MAX_LAT = 85.05113
TILE_SIZE = 512


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def haversine_km(lat1, lon1, lat2, lon2, radius_km: float = SERVING_RADIUS_KM) -> Column:
    """G1: great-circle distance, ``2 R asin(least(1, sqrt(hav)))``.

    ``least`` skips NULLs, so a NULL coordinate yields R*pi rather than NULL; callers filter NULL coordinates
    first, as the reference does.
    """
    la1, lo1, la2, lo2 = _c(lat1), _c(lon1), _c(lat2), _c(lon2)
    hav = (F.pow(F.sin(F.radians((la1 - la2) / 2)), 2)
           + F.cos(F.radians(la2)) * F.cos(F.radians(la1)) * F.pow(F.sin(F.radians((lo1 - lo2) / 2)), 2))
    return F.lit(2.0) * F.lit(radius_km) * F.asin(F.least(F.lit(1.0), F.sqrt(hav)))


def haversine_py(lat1: float, lon1: float, lat2: float, lon2: float, radius_km: float = SERVING_RADIUS_KM) -> float:
    """Same formula in Python, for tests and size bounds."""
    hav = (math.sin(math.radians((lat1 - lat2) / 2)) ** 2
           + math.cos(math.radians(lat2)) * math.cos(math.radians(lat1))
           * math.sin(math.radians((lon1 - lon2) / 2)) ** 2)
    return 2 * radius_km * math.asin(min(1.0, math.sqrt(hav)))


def mercator_pixels(lon, lat, zoom: float) -> tuple[Column, Column]:
    """Web-Mercator pixel coordinates in a ``512 * 2^zoom`` world, latitude clamped to +-85.05113."""
    world = TILE_SIZE * (2.0 ** zoom)
    la = F.greatest(F.lit(-MERCATOR_MAX_LAT), F.least(F.lit(MERCATOR_MAX_LAT), _c(lat)))
    x = (_c(lon) + 180.0) / 360.0 * world
    s = F.sin(F.radians(la))
    y = (F.lit(0.5) - F.log((F.lit(1.0) + s) / (F.lit(1.0) - s)) / (4 * math.pi)) * world
    return x, y

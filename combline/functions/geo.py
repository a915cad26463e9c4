"""Great-circle distance as a column expression and for numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the earth's radius in miles.
EARTH_RADIUS_MILES = 3958.7613


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_MILES) -> Column:
    """Miles between two positions in degrees; null if any coordinate is null."""
    half_lat = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
    half_lon = F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    h = half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def haversine_miles_np(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_MILES) -> np.ndarray:
    a1, a2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(1.0, h)))

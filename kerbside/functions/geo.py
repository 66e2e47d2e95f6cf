"""Grid cells, bounding box and short-range distances as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted coordinates, both ends inclusive.
LON_RANGE = (-80.0, -70.0)
LAT_RANGE = (40.0, 50.0)

DISTRICT_DECIMALS = 2
HEATMAP_DECIMALS = 3

# WGS-84 ellipsoid.
EQUATOR_RADIUS_M = 6378137.0
FLATTENING = 1 / 298.257223563


def in_bounds(lat: Column, lon: Column) -> Column:
    """Null and NaN coordinates are out (NaN sorts above every number)."""
    return lon.between(*LON_RANGE) & lat.between(*LAT_RANGE)


def cell_of(degrees: Column, decimals: int = DISTRICT_DECIMALS) -> Column:
    """Integer grid key of a coordinate rounded to ``decimals`` (halves away from zero).

    Spark rounds doubles through decimal text, which is exact for inputs like -73.985 but
    slow. Only coordinates that close to a half take that path; all others get the same
    cell from plain arithmetic.
    """
    scaled = degrees * float(10 ** decimals)
    near_half = F.abs(scaled - F.floor(scaled) - 0.5) < 1e-6
    exact = F.round(F.round(degrees, decimals) * 10 ** decimals)
    return F.when(near_half, exact).otherwise(F.floor(scaled + 0.5)).cast("int")


def degrees_of(cell: Column, decimals: int = DISTRICT_DECIMALS) -> Column:
    """The rounded coordinate a cell stands for."""
    return cell / F.lit(float(10 ** decimals))


def metres_between(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Distance on the ellipsoid's tangent plane at the mid latitude.

    Meant for neighbours some hundred metres apart, where it agrees with an
    ellipsoidal geodesic far below a millimetre.
    """
    e2 = FLATTENING * (2 - FLATTENING)
    mid = F.radians((lat_a + lat_b) / 2)
    w2 = 1 - e2 * F.pow(F.sin(mid), 2)
    meridional = EQUATOR_RADIUS_M * (1 - e2) / F.pow(w2, 1.5)
    normal = EQUATOR_RADIUS_M / F.sqrt(w2)
    north = F.radians(lat_b - lat_a) * meridional
    east = F.radians(lon_b - lon_a) * normal * F.cos(mid)
    return F.sqrt(north * north + east * east)


def reach_in_degrees(metres: float, max_abs_lat: float) -> float:
    """Degrees on either axis that ``metres`` can span up to the given latitude."""
    metres_per_degree = math.radians(1) * EQUATOR_RADIUS_M * (1 - FLATTENING) ** 2
    return metres / (metres_per_degree * math.cos(math.radians(max_abs_lat)))

"""Distances and projections as column maths."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0088
KM_PER_DEG = 111.32
COS_FLOOR = 0.1


def local_km(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float,
             km_per_deg: float = KM_PER_DEG) -> tuple[Column, Column]:
    """Equirectangular (x east, y north) in km about a reference point."""
    lat0 = lat0 if isinstance(lat0, Column) else F.lit(float(lat0))
    lon0 = lon0 if isinstance(lon0, Column) else F.lit(float(lon0))
    scale = F.greatest(F.cos(F.radians(lat0)), F.lit(COS_FLOOR))
    return (lon - lon0) * F.lit(km_per_deg) * scale, (lat - lat0) * F.lit(km_per_deg)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = (F.sin(dlat / 2) * F.sin(dlat / 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def sphere_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the earth sphere in km. Chord length grows with great-circle distance, so a
    nearest neighbour by chord is the nearest by haversine."""
    r = F.lit(EARTH_RADIUS_KM)
    la, lo = F.radians(lat), F.radians(lon)
    return r * F.cos(la) * F.cos(lo), r * F.cos(la) * F.sin(lo), r * F.sin(la)


def chord_to_arc_km(chord: Column) -> Column:
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(chord / (2 * EARTH_RADIUS_KM), F.lit(1.0)))


def arc_to_chord_km(arc_km: float) -> float:
    return 2 * EARTH_RADIUS_KM * math.sin(arc_km / (2 * EARTH_RADIUS_KM))


# GRS80 ellipsoid and the central meridian of UTM zone 54N.
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
UTM54_LON0 = 141.0
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0


def utm54(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in metres, zone 54 north (Krueger series to third order in n).

    Within 3.5 deg of the central meridian the series error is below 0.1 mm.
    """
    n = GRS80_F / (2 - GRS80_F)
    a0 = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(s) - e * atanh(e * s))
    dl = F.radians(lon - F.lit(UTM54_LON0))
    xi = F.atan2(t, F.cos(dl))
    eta = atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = UTM_SCALE * a0
    return F.lit(UTM_FALSE_EASTING) + k * east, k * north


def point_segment_km(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment in the plane."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / len2).otherwise(F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)

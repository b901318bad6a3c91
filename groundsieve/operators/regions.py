"""Region labels from boxes, centres and lookups."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

Box = tuple[float, float, float, float]

# Held-out regions (lat_min, lat_max, lon_min, lon_max); they overlap.
REGION_BOXES: dict[str, Box] = {
    "hokkaido": (41.0, 46.0, 139.0, 146.0),
    "tohoku": (37.0, 41.5, 139.0, 142.5),
    "kanto": (35.0, 37.5, 138.5, 141.0),
    "chubu": (34.5, 37.5, 136.0, 139.0),
    "kansai": (33.5, 35.5, 134.0, 137.0),
    "chugoku": (33.5, 35.6, 130.0, 134.0),
    "shikoku": (32.5, 34.5, 132.0, 135.0),
    "kyushu_okinawa": (24.0, 33.5, 122.0, 132.0),
}
# Approximate prefecture extents (lat_min, lat_max, lon_min, lon_max).
PREFECTURE_BOXES: dict[str, Box] = {
    "tokyo": (35.50, 35.92, 139.30, 139.95),
    "kanagawa": (35.13, 35.65, 138.93, 139.83),
    "saitama": (35.75, 36.30, 138.70, 139.92),
    "chiba": (34.90, 36.10, 139.70, 140.95),
    "ibaraki": (35.75, 36.95, 139.65, 140.85),
    "tochigi": (36.20, 37.15, 139.30, 140.30),
    "gunma": (36.05, 36.95, 138.40, 139.70),
}
CENTRE_LATITUDE = 36.0
OTHER = "other"


def inside(box: Box, closed: bool = True, lat: str = "latitude_deg", lon: str = "longitude_deg") -> Column:
    la0, la1, lo0, lo1 = box
    if closed:
        return F.col(lat).between(la0, la1) & F.col(lon).between(lo0, lo1)
    return (F.col(lat) >= la0) & (F.col(lat) < la1) & (F.col(lon) >= lo0) & (F.col(lon) < lo1)


def regions_of(boxes: Mapping[str, Box] = REGION_BOXES) -> Column:
    """Array of every region whose closed box holds the row; empty if none."""
    if not boxes:
        raise ValueError("no regions given")
    return F.array_compact(F.array(*[F.when(inside(b), F.lit(n)) for n, b in boxes.items()]))


def first_box(boxes: Mapping[str, Box] = PREFECTURE_BOXES, other: str = "Other") -> Column:
    """First half-open box in the given order, else ``other``."""
    out = None
    for name, b in boxes.items():
        label = F.lit(name.capitalize())
        out = F.when(inside(b, closed=False), label) if out is None else out.when(inside(b, closed=False), label)
    return out.otherwise(F.lit(other))


def nearest_centre(boxes: Mapping[str, Box] = PREFECTURE_BOXES, lat: str = "latitude_deg", lon: str = "longitude_deg") -> Column:
    """Name of the nearest box centre, longitude scaled at 36 N; the first wins a tie."""
    k = math.cos(math.radians(CENTRE_LATITUDE))
    scored = []
    for i, (name, (la0, la1, lo0, lo1)) in enumerate(boxes.items()):
        dy = F.col(lat) - F.lit(0.5 * (la0 + la1))
        dx = F.col(lon) * F.lit(k) - F.lit(0.5 * (lo0 + lo1) * k)
        scored.append(F.struct((dy * dy + dx * dx).alias("d2"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    return F.array_min(F.array(*scored))["name"]


def with_prefecture(df: DataFrame, lookup: DataFrame | None) -> DataFrame:
    """Prefecture of the containing polygon from a location lookup, else 'other'; without a
    lookup the nearest centre (G10)."""
    if lookup is None:
        return df.withColumn("pref", nearest_centre())
    return (df.join(lookup.select("latitude_deg", "longitude_deg", "pref"), ["latitude_deg", "longitude_deg"], "left")
            .withColumn("pref", F.coalesce("pref", F.lit(OTHER))))


def region_folds(df: DataFrame, boxes: Mapping[str, Box] = REGION_BOXES) -> DataFrame:
    """Rows once per region that has any test row, with role test or train (K5, K7).

    A row can be a test row of two overlapping regions. Regions without test rows have no fold.
    """
    tagged = df.withColumn("_in", regions_of(boxes))
    present = tagged.select(F.explode("_in").alias("r")).agg(F.sort_array(F.collect_set("r")))  # at most one per box
    return (tagged.withColumn("fold", F.explode(present.scalar()))
            .withColumn("role", F.when(F.array_contains("_in", F.col("fold")), "test").otherwise("train")).drop("_in"))


def prefecture_folds(df: DataFrame, prefectures: list[str] | None = None) -> DataFrame:
    """Leave-prefecture-out roles from a ``pref`` column; 'other' rows only train (K6)."""
    wanted = prefectures or list(PREFECTURE_BOXES)
    unknown = sorted(set(wanted) - set(PREFECTURE_BOXES))
    if unknown:
        raise ValueError(f"unknown prefectures: {unknown}")
    present = df.where(F.col("pref").isin(wanted)).agg(F.sort_array(F.collect_set("pref")))
    return (df.withColumn("fold", F.explode(present.scalar()))
            .withColumn("role", F.when(F.col("pref") == F.col("fold"), "test").otherwise("train")))


def density_grid(df: DataFrame, bins: int = 60) -> DataFrame:
    """Distinct locations per cell of a bins x bins grid over their extent; last bins closed."""
    ext = df.agg(F.struct(F.min("latitude_deg").alias("y0"), F.max("latitude_deg").alias("y1"),
                          F.min("longitude_deg").alias("x0"), F.max("longitude_deg").alias("x1"))).scalar()
    loc = df.select("latitude_deg", "longitude_deg").distinct().withColumn("_e", ext)

    def index(v: str, lo: str, hi: str) -> Column:
        span = F.col(f"_e.{hi}") - F.col(f"_e.{lo}")
        return F.least(F.floor((F.col(v) - F.col(f"_e.{lo}")) / span * bins), F.lit(bins - 1)).cast("int")

    return loc.groupBy(index("latitude_deg", "y0", "y1").alias("lat_bin"),
                       index("longitude_deg", "x0", "x1").alias("lon_bin")).agg(F.count(F.lit(1)).alias("n_locations"))

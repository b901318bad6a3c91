"""Joins of points with polygon and raster layers, and covariate registries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.operators.nearest import knn_join
from groundsieve.functions.geo import utm54

CELL_DEG = 0.25
BAND_DEG = 0.02


def distinct_then_join(df: DataFrame, keys: Sequence[str], enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``enrich`` once per distinct key and join its columns back."""
    return df.join(enrich(df.select(*keys).distinct()), list(keys), "left")


def polygon_code(points: DataFrame, edges: DataFrame, key: str, fill: int | None, x: str = "longitude_deg",
                 y: str = "latitude_deg", cell: float = CELL_DEG, band: float = BAND_DEG) -> DataFrame:
    """Code of the containing polygon; the lowest poly_id wins overlaps, ``fill`` if none.

    Candidates come from an equi-join on the cells a polygon's box covers. Containment is the
    parity of edges crossed by a ray to the right; only edges in the point's own thin latitude
    band can be crossed, so a second equi-join on (polygon, band) finds them. Parities are
    partial sums: point-edge pairs are never stored. Input: key, code via points/edges columns.
    """
    box = edges.groupBy("poly_id").agg(F.min("code").alias("code"), F.min(F.least("x1", "x2")).alias("_x0"), F.max(F.greatest("x1", "x2")).alias("_x1"),
                                       F.min(F.least("y1", "y2")).alias("_y0"), F.max(F.greatest("y1", "y2")).alias("_y1"))
    cx, cy = lambda c: F.floor(c / F.lit(cell)), lambda c: F.floor(c / F.lit(cell))
    cover = box.select("*", F.explode(F.sequence(cx(F.col("_x0")), cx(F.col("_x1")))).alias("_cx")).select(
        "*", F.explode(F.sequence(cy(F.col("_y0")), cy(F.col("_y1")))).alias("_cy"))
    pts = points.select(key, F.col(x).alias("_px"), F.col(y).alias("_py"))
    cand = (pts.withColumns({"_cx": cx(F.col("_px")), "_cy": cy(F.col("_py"))}).join(cover, ["_cx", "_cy"])
            .where(F.col("_px").between(F.col("_x0"), F.col("_x1")) & F.col("_py").between(F.col("_y0"), F.col("_y1")))
            .select(key, "_px", "_py", "poly_id", "code", F.floor(F.col("_py") / F.lit(band)).alias("_band")))
    slanted = edges.where("y1 <> y2").select("poly_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(
        F.floor(F.least("y1", "y2") / F.lit(band)), F.floor(F.greatest("y1", "y2") / F.lit(band)))).alias("_band"))
    up = (F.col("y1") <= F.col("_py")) != (F.col("y2") <= F.col("_py"))
    at = F.col("x1") + (F.col("_py") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    hits = (cand.join(slanted, ["poly_id", "_band"]).where(up & (at > F.col("_px"))).groupBy(key, "poly_id")
            .agg(F.count(F.lit(1)).alias("_n"), F.min("code").alias("code")).where("_n % 2 = 1")
            .groupBy(key).agg(F.min_by("code", "poly_id").alias("code")))
    out = points.join(hits, key, "left")
    return out.withColumn("code", F.coalesce("code", F.lit(fill))) if fill is not None else out


class Grid(NamedTuple):
    """Regular raster axes: first cell centre and step, rows and columns."""

    lat0: float
    lon0: float
    dlat: float
    dlon: float
    rows: int
    cols: int


def _outside(g: Grid, lat: Column, lon: Column) -> Column:
    return ((lat < g.lat0) | (lat > g.lat0 + (g.rows - 1) * g.dlat) | (lon < g.lon0) | (lon > g.lon0 + (g.cols - 1) * g.dlon))


def sample_bilinear(points: DataFrame, cells: DataFrame, g: Grid, name: str, fill: float,
                    lat: str = "latitude_deg", lon: str = "longitude_deg") -> DataFrame:
    """Bilinear sample (J5). Each cell hands its value to the four patches it is a corner of, so
    points meet one patch row by equi-join; a missing corner or a point outside gets ``fill``."""
    def corner(dr: int, dc: int, slot: str) -> Column:
        return F.struct((F.col("row") - dr).alias("_i"), (F.col("col") - dc).alias("_j"), *[
            (F.col("value") if s == slot else F.lit(None).cast("double")).alias(s) for s in ("v00", "v01", "v10", "v11")])

    patches = (cells.where("value is not null").select(F.inline(F.array(
        corner(0, 0, "v00"), corner(0, 1, "v01"), corner(1, 0, "v10"), corner(1, 1, "v11"))))
        .groupBy("_i", "_j").agg(*[F.max(s).alias(s) for s in ("v00", "v01", "v10", "v11")]))
    y, x = (F.col(lat) - g.lat0) / g.dlat, (F.col(lon) - g.lon0) / g.dlon
    i = (F.least(F.greatest(F.ceil(y), F.lit(1)), F.lit(g.rows - 1)) - 1).cast("int")
    j = (F.least(F.greatest(F.ceil(x), F.lit(1)), F.lit(g.cols - 1)) - 1).cast("int")
    p = points.withColumns({"_i": i, "_j": j, "_out": _outside(g, F.col(lat), F.col(lon))})
    p = p.withColumns({"_fy": y - F.col("_i"), "_fx": x - F.col("_j")}).join(patches, ["_i", "_j"], "left")
    top = F.col("v00") * (1 - F.col("_fx")) + F.col("v01") * F.col("_fx")
    bot = F.col("v10") * (1 - F.col("_fx")) + F.col("v11") * F.col("_fx")
    v = F.coalesce(F.when(~F.col("_out"), top * (1 - F.col("_fy")) + bot * F.col("_fy")), F.lit(fill))
    return p.select(*points.columns, v.alias(name))


def sample_nearest(points: DataFrame, cells: DataFrame, g: Grid, name: str, fill: float,
                   lat: str = "latitude_deg", lon: str = "longitude_deg") -> DataFrame:
    """Nearest cell each way, the first on a tie."""
    y, x = (F.col(lat) - g.lat0) / g.dlat, (F.col(lon) - g.lon0) / g.dlon
    near = lambda v, n: F.least(F.greatest(F.ceil(v - 0.5), F.lit(0)), F.lit(n - 1)).cast("int")
    p = points.withColumns({"_i": near(y, g.rows), "_j": near(x, g.cols), "_out": _outside(g, F.col(lat), F.col(lon))})
    c = cells.select(F.col("row").alias("_i"), F.col("col").alias("_j"), F.col("value").alias("_v"))
    v = F.coalesce(F.when(~F.col("_out"), F.col("_v")), F.lit(fill))
    return p.join(c, ["_i", "_j"], "left").select(*points.columns, v.alias(name))


def line_distance(points: DataFrame, segments: DataFrame, key: str, name: str) -> DataFrame:
    """Distance in km (float) to the nearest segment, in UTM zone 54 north."""
    if segments.isEmpty():
        raise ValueError("line layer is empty")
    px, py = utm54(F.col("latitude_deg"), F.col("longitude_deg"))
    a, b = utm54(F.col("lat1"), F.col("lon1")), utm54(F.col("lat2"), F.col("lon2"))
    pts = points.select(key, (px / 1000).alias("_x"), (py / 1000).alias("_y"))
    seg = segments.select((a[0] / 1000).alias("x1"), (a[1] / 1000).alias("y1"), (b[0] / 1000).alias("x2"), (b[1] / 1000).alias("y2"))
    seg = seg.withColumn("_sid", F.xxhash64("x1", "y1", "x2", "y2"))
    near = knn_join(pts, seg, 1, query_key=key, point_key="_sid", coords=["_x", "_y"], segments=["x1", "y1", "x2", "y2"])
    return points.join(near.select(key, F.col("distances")[0].cast("float").alias(name)), key, "left")


class Covariate(NamedTuple):
    """A named covariate and the loader that adds its column to a frame of points."""

    name: str
    load: Callable[[DataFrame, str], DataFrame]
    continuous: bool = True


def apply_registry(points: DataFrame, registry: Sequence[Covariate]) -> DataFrame:
    """Each covariate adds one column; continuous ones are also stacked, in order."""
    names = [c.name for c in registry]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"covariates registered twice: {repeated}")
    for c in registry:
        points = c.load(points, c.name)
    return points.withColumn("covariates", F.array(*[F.col(c.name).cast("double") for c in registry if c.continuous]))

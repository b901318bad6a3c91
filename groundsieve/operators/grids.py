"""Tiles, prediction grids and maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from groundsieve.functions import geo, mesh, numeric
from groundsieve.operators.nearest import knn_join

TILE_EPS = 1e-9
# Maps of threshold probabilities.
MAP_DEPTHS = (5.0, 10.0, 20.0)
MAP_THRESHOLDS = ((5.0, "below"), (10.0, "below"), (15.0, "below"), (30.0, "above"))
MAP_RADIUS_DEG = 0.15
TRUST_RADIUS_KM = 5.0

Predictor = Callable[[DataFrame], DataFrame]


def pick_level(tile_km: float) -> int:
    """Mesh level for a wanted tile size."""
    return 4 if tile_km <= 5.0 else 2 if tile_km <= 30.0 else 1


def tiles(boxes: DataFrame, level: int) -> DataFrame:
    """Mesh tiles met by stepping one cell at a time from each box's south-west corner.

    ``boxes`` has lat_min, lon_min, lat_max, lon_max; columns are kept as tile bounds.
    """
    r, c = mesh.ROWS_PER_DEG[level], mesh.COLS_PER_DEG[level]
    steps = lambda lo, hi, n: F.sequence(F.lit(0), F.floor((F.col(hi) - F.col(lo) + TILE_EPS) * n).cast("int"))
    keep = [x for x in boxes.columns if x not in ("lat_min", "lon_min", "lat_max", "lon_max")]
    t = boxes.select(*keep, "lat_min", "lon_min", F.explode(steps("lat_min", "lat_max", r)).alias("_a"), "lon_max")
    t = t.select(*keep, "lat_min", "lon_min", "_a", F.explode(steps("lon_min", "lon_max", c)).alias("_b"))
    t = t.select(*keep, mesh.mesh_row(F.col("lat_min") + F.col("_a") / r, level).alias("mesh_row"),
                 mesh.mesh_col(F.col("lon_min") + F.col("_b") / c, level).alias("mesh_col")).distinct()
    t = t.withColumn("tile_id", mesh.pack(F.col("mesh_row"), F.col("mesh_col"), level))
    return mesh.with_bounds(t, level).drop("lat_mid", "lon_mid")


def halo(t: DataFrame, halo_km: float) -> DataFrame:
    """Tile bounds widened by ``halo_km``."""
    mid = F.radians(0.5 * (F.col("lat_min") + F.col("lat_max")))
    dlat = F.lit(halo_km / geo.KM_PER_DEG)
    dlon = F.lit(halo_km) / (geo.KM_PER_DEG * F.greatest(F.cos(mid), F.lit(geo.COS_FLOOR)))
    return t.withColumns({"lat_min": F.col("lat_min") - dlat, "lat_max": F.col("lat_max") + dlat,
                          "lon_min": F.col("lon_min") - dlon, "lon_max": F.col("lon_max") + dlon})


def halo_rows(df: DataFrame, widened: DataFrame, level: int = 2) -> DataFrame:
    """Rows inside each widened tile (P2): a tile is listed under every cell that its widened
    bounds touch, however wide, rows look up their own cell by equi-join, then the bounds decide."""
    row, col = (lambda v: mesh.mesh_row(F.col(v), level)), (lambda v: mesh.mesh_col(F.col(v), level))
    r, c = row("latitude_deg"), col("longitude_deg")
    span = lambda f, lo, hi: F.explode(F.sequence(f(lo), f(hi)))
    near = widened.select("tile_id", "lon_min", "lon_max", span(row, "lat_min", "lat_max").alias("mesh_row")).select(
        "tile_id", "mesh_row", span(col, "lon_min", "lon_max").alias("mesh_col"))
    looked = df.withColumns({"mesh_row": r, "mesh_col": c}).join(near, ["mesh_row", "mesh_col"])
    b = widened.select("tile_id", "lat_min", "lat_max", "lon_min", "lon_max")
    return (looked.join(b, "tile_id").where(F.col("latitude_deg").between(F.col("lat_min"), F.col("lat_max"))
                                           & F.col("longitude_deg").between(F.col("lon_min"), F.col("lon_max")))
            .drop("lat_min", "lat_max", "lon_min", "lon_max"))


def tile_grid(t: DataFrame, resolution_m: float, depths: Sequence[float]) -> DataFrame:
    """Grid nodes of each tile at a metric resolution, times depths."""
    dlat = resolution_m / 111_320.0
    mid = F.radians(0.5 * (F.col("lat_min") + F.col("lat_max")))
    dlon = F.lit(dlat) / F.greatest(F.abs(F.cos(mid)), F.lit(geo.COS_FLOOR))
    # arange(lo, hi + d / 2, d) has ceil((hi - lo) / d + 1 / 2) nodes
    count = lambda lo, hi, d: F.ceil((F.col(hi) - F.col(lo)) / d + 0.5).cast("int")
    g = t.withColumns({"_dlon": dlon})
    g = g.select("*", F.explode(F.sequence(F.lit(0), count("lat_min", "lat_max", F.lit(dlat)) - 1)).alias("lat_i"))
    g = g.select("*", F.explode(F.sequence(F.lit(0), count("lon_min", "lon_max", F.col("_dlon")) - 1)).alias("lon_i"))
    return g.select("tile_id", "lat_i", "lon_i", (F.col("lat_min") + F.col("lat_i") * dlat).alias("latitude_deg"),
                    (F.col("lon_min") + F.col("lon_i") * F.col("_dlon")).alias("longitude_deg"),
                    F.explode(F.array(*[F.lit(float(d)) for d in depths])).alias("depth_from_surface"))


def with_bounds_90(df: DataFrame, mean: str = "mean", std: str = "std") -> DataFrame:
    """5 % and 95 % bounds of a Gaussian prediction (P5)."""
    z = numeric.normal_quantile(0.95)
    return df.withColumns({"q05": F.col(mean) - z * F.col(std), "q95": F.col(mean) + z * F.col(std)})


def polygon_request(vertices: DataFrame, key: str, resolution_m: float, depths: Sequence[float], level: int) -> DataFrame:
    """Grid over the bounding box of each requested polygon."""
    box = vertices.groupBy(key).agg(F.min("y").alias("lat_min"), F.min("x").alias("lon_min"), F.max("y").alias("lat_max"), F.max("x").alias("lon_max"))
    return tile_grid(tiles(box.drop(key), level), resolution_m, depths)


def write_cube(grid: DataFrame, predict: Predictor, path: str, fan: int = 1) -> None:
    """Predict every node and write one folder per tile (P7). Mesh tiles hold equal node counts;
    ``fan`` spreads each over several tasks when a tile is too large for one file."""
    out = predict(grid).select("tile_id", "depth_from_surface", "latitude_deg", "longitude_deg", "mean", "std")
    spread = F.pmod(F.xxhash64("latitude_deg", "longitude_deg"), F.lit(fan))
    out.repartition("tile_id", spread).write.mode("overwrite").partitionBy("tile_id").parquet(path)


def depth_slice(cube: DataFrame, depth: float, keys: Sequence[str] = ("tile_id", "latitude_deg", "longitude_deg")) -> DataFrame:
    """Values at the cube depth nearest to ``depth``, the shallower on a tie."""
    values = [c for c in cube.columns if c not in keys]
    order = F.struct(F.abs(F.col("depth_from_surface") - depth), F.col("depth_from_surface"))
    return cube.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def box_grid(df: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """n_lat x n_lon nodes over the extent of the data, edges included."""
    e = df.agg(F.min("latitude_deg").alias("y0"), F.max("latitude_deg").alias("y1"), F.min("longitude_deg").alias("x0"), F.max("longitude_deg").alias("x1"))
    g = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_lat - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_lon - 1))).alias("j"))
    return g.select((F.col("i") * n_lon + F.col("j")).cast("long").alias("node"),
                    (F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("i") / (n_lat - 1)).alias("latitude_deg"),
                    (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("j") / (n_lon - 1)).alias("longitude_deg"))


def with_nearest_borehole(nodes: DataFrame, holes: DataFrame, values: Sequence[str], key: str = "hole_id") -> DataFrame:
    """Values of the nearest borehole in degrees, and its distance ``dist_deg``."""
    near = knn_join(nodes, holes, 1, query_key="node", point_key=key, coords=["latitude_deg", "longitude_deg"], payload=values)
    return nodes.join(near.select("node", F.col("distances")[0].alias("dist_deg"), *[F.col(v)[0].alias(v) for v in values]), "node")


def exceedance_map(nodes: DataFrame, predict: Predictor) -> DataFrame:
    """Threshold probabilities per node and depth; NULL beyond 0.15 degrees of data."""
    at = nodes.select("*", F.explode(F.array(*[F.lit(d) for d in MAP_DEPTHS])).alias("depth_from_surface"))
    p = predict(at)
    maps = F.inline(F.array(*[F.struct(F.lit(("P(N<" if s == "below" else "P(N>") + f"{int(c)})").alias("map"), F.lit(c).alias("_c"), F.lit(s).alias("_s"))
                              for c, s in MAP_THRESHOLDS]))
    q = p.select("node", "depth_from_surface", "dist_deg", "mean", F.greatest("std", F.lit(1e-3)).alias("_sd"), maps)
    z = F.when(F.col("_s") == "below", (F.col("_c") - F.col("mean")) / F.col("_sd")).otherwise((F.col("mean") - F.col("_c")) / F.col("_sd"))
    q = q.withColumn("_z", z)
    return q.select("node", "depth_from_surface", "map", F.when(F.col("dist_deg") < MAP_RADIUS_DEG, numeric.normal_cdf(F.col("_z"))).alias("probability"))


def trust_mask(nodes: DataFrame, holes: DataFrame, key: str = "hole_id", radius_km: float = TRUST_RADIUS_KM) -> DataFrame:
    """Great-circle km to the nearest borehole and whether it is within reach (P10)."""
    x, y, z = geo.sphere_xyz(F.col("latitude_deg"), F.col("longitude_deg"))
    near = knn_join(nodes.withColumns({"x": x, "y": y, "z": z}), holes.withColumns({"x": x, "y": y, "z": z}), 1,
                    query_key="node", point_key=key, coords=["x", "y", "z"])
    km = geo.chord_to_arc_km(F.col("distances")[0])
    return near.select("node", km.alias("km"), (km > radius_km).alias("do_not_trust"))


def site_profile(sites: DataFrame, predict: Predictor, max_depth: int = 50) -> DataFrame:
    """Prediction with a 95 % band each metre down."""
    z = numeric.normal_quantile(0.975)
    depths = F.transform(F.sequence(F.lit(0), F.lit(max_depth)), lambda d: d.cast("double"))
    p = predict(sites.select("*", F.explode(depths).alias("depth_from_surface")))
    return p.select("site", "depth_from_surface", "mean", (F.col("mean") - z * F.col("std")).alias("lo"), (F.col("mean") + z * F.col("std")).alias("hi"))


def site_observations(df: DataFrame, sites: Sequence[tuple[str, float, float]], reach_deg: float = 0.01) -> DataFrame:
    """Observed rows within ``reach_deg`` of a site each way."""
    hit = F.array_compact(F.array(*[F.when((F.abs(F.col("latitude_deg") - la) <= reach_deg) & (F.abs(F.col("longitude_deg") - lo) <= reach_deg), F.lit(n))
                                    for n, la, lo in sites]))
    return df.withColumn("site", F.explode(hit))

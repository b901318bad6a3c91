"""Queries: spatial joins and spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsieve.functions import geo
from groundsieve.operators import layers as lay, nearest, pairs
from groundsieve.operators.errors import residual
from groundsieve.operators.profiles import LOC
from groundsieve.plans import inputs
from groundsieve.plans.ingest import POLYGON_CTE, SEGMENTS_CTE, line_features, region_polygons
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.keys import LOC_CTE, locations
from groundsieve.plans.legends import SAMPLES_CTE, legend_cache, CACHE_CTE
from groundsieve.plans.registry import query, r6, rounded
from groundsieve.sources import layers as src, legends
from groundsieve.functions import legend

# Boreholes with mean residual and mean N, projected to km about (36 N, 139.7 E).
HOLES_CTE = """
fx_holes as (select boring_key, latitude_deg, longitude_deg, fold, (longitude_deg - 139.7e0) * 111.32e0 * cos(radians(36e0)) as x,
  (latitude_deg - 36e0) * 111.32e0 as y, avg(n_value) as v, avg(y_true - y_pred) as err from fx_pred group by boring_key, latitude_deg, longitude_deg, fold)"""


def holes(spark, sf):
    p = inputs.predictions(spark, sf)
    x, y = geo.local_km(F.col("latitude_deg"), F.col("longitude_deg"), 36.0, 139.7)
    return p.groupBy("boring_key", "latitude_deg", "longitude_deg", "fold").agg(
        F.avg("n_value").alias("v"), F.avg(residual()).alias("err")).withColumns({"x": x, "y": y})


def _knn_sql(q: str, p: str, k: int, extra: str = "true") -> str:
    return f"""
nn as (select *, row_number() over (partition by qk order by d2, pk) as rn from (
  select q.boring_key as qk, p.boring_key as pk, p.v as pv, p.err as perr, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) as d2
  from {q} q cross join {p} p where {extra}) qualify rn <= {k})"""


@query("j1_distinct_join_back", check_sql("""
select regime, count(*) as n_rows, round(sum(n_value), 6) as n_sum from (
  select n_value, case when c.symbol is null then 7 else c.regime end as regime from fx_raw r left join (
    select lat, lon, symbol, case when symbol in ('H') then 0 when symbol = '' then 7 else 3 end as regime from fx_cache) c
  on c.lat = round_even(r.latitude_deg * 1e4, 0) / 1e4 and c.lon = round_even(r.longitude_deg * 1e4, 0) / 1e4) group by regime""", LOC_CTE, SAMPLES_CTE, CACHE_CTE))
def j1_distinct_join_back(spark, sf):
    cache = legend_cache(spark, sf)
    regime = F.when(F.col("symbol").isNull(), 7).when(F.col("symbol") == "H", 0).when(F.col("symbol") == "", 7).otherwise(3)
    m = inputs.measurements(spark, sf).select(*LOC, "n_value")
    out = lay.distinct_then_join(m, LOC, lambda d: legends.with_legend(d, cache).select(*LOC, regime.alias("regime")))
    return out.groupBy("regime").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("n_value")).alias("n_sum"))


# Nearest segment in the plane of the check: local km for both engines.
@query("j3_nearest_line", check_sql("""
select boring_key, round(min(sqrt((px - (x1 + t * (x2 - x1))) * (px - (x1 + t * (x2 - x1))) + (py - (y1 + t * (y2 - y1))) * (py - (y1 + t * (y2 - y1))))), 6) as km from (
  select *, least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0e0), 1e0) as t from (
    select boring_key, (longitude_deg - 139.7e0) * 90e0 as px, (latitude_deg - 36e0) * 111.32e0 as py, (lon1 - 139.7e0) * 90e0 as x1, (lat1 - 36e0) * 111.32e0 as y1,
      (lon2 - 139.7e0) * 90e0 as x2, (lat2 - 36e0) * 111.32e0 as y2 from fx_loc cross join fx_segments)) group by boring_key""", LOC_CTE, SEGMENTS_CTE))
def j3_nearest_line(spark, sf):
    px = lambda c: (F.col(c) - 139.7) * 90.0
    py = lambda c: (F.col(c) - 36.0) * 111.32
    pts = locations(spark, sf).select("boring_key", px("longitude_deg").alias("x"), py("latitude_deg").alias("y"))
    seg = src.segments_from_lines(line_features(spark, sf)).select(
        (F.col("line_id") * 10 + F.col("seq")).alias("sid"), px("lon1").alias("x1"), py("lat1").alias("y1"), px("lon2").alias("x2"), py("lat2").alias("y2"))
    near = nearest.knn_join(pts, seg, 1, query_key="boring_key", point_key="sid", coords=["x", "y"], segments=["x1", "y1", "x2", "y2"], rows_per_tile=500)
    return near.select("boring_key", r6(F.col("distances")[0]).alias("km"))


@query("j3_line_distance_utm")
def j3_line_distance_utm(spark, sf):
    seg = src.segments_from_lines(line_features(spark, sf))
    return lay.line_distance(locations(spark, sf), seg, "boring_key", "river_distance_km").select("boring_key", "river_distance_km")


@query("j4_point_in_polygon", check_sql("""
select l.boring_key, coalesce(m.code, -1) as code from fx_loc l left join (
  select boring_key, min_by(poly_id * 10, poly_id) as code from (
    select l.boring_key, e.poly_id, count(*) filter ((y1 <= latitude_deg) <> (y2 <= latitude_deg)
      and x1 + (latitude_deg - y1) / nullif(y2 - y1, 0) * (x2 - x1) > longitude_deg) as n
    from fx_loc l cross join fx_edges e group by l.boring_key, e.poly_id) where n % 2 = 1 group by boring_key) m using (boring_key)""", LOC_CTE, POLYGON_CTE))
def j4_point_in_polygon(spark, sf):
    edges = src.edges_from_vertices(src.polygon_vertices(region_polygons(spark, sf), "geometry", "poly_id"), "poly_id")
    edges = edges.withColumn("code", F.col("poly_id") * 10)
    return lay.polygon_code(locations(spark, sf), edges, "boring_key", -1).select("boring_key", "code")


# 26 x 26 cells at 0.1 degrees with gaps: mean elevation near each node, every 17th cell missing.
RASTER = lay.Grid(35.0, 138.5, 0.1, 0.1, 26, 26)
GRID_CTE = """
fx_grid as (select cast(i as int) as row, cast(j as int) as col, case when (i * 26 + j) % 17 = 0 then null else v + i * 3e0 - j end as value
  from range(26) a(i) cross join range(26) b(j) cross join (select round(avg(mouth_elevation), 3) as v from fx_raw))"""


def raster_grid(spark, sf):
    m = inputs.measurements(spark, sf).agg(F.round(F.avg("mouth_elevation"), 3).alias("v"))
    rows = m.select("v", F.explode(F.sequence(F.lit(0), F.lit(25))).alias("row")).select("v", "row", F.explode(F.sequence(F.lit(0), F.lit(25))).alias("col"))
    value = F.when((F.col("row") * 26 + F.col("col")) % 17 != 0, F.col("v") + F.col("row") * 3.0 - F.col("col"))
    return rows.select("row", "col", value.alias("value"))


@query("j5_raster_bilinear", check_sql("""
select boring_key, round(coalesce((a.value * (1 - fx) + b.value * fx) * (1 - fy) + (c.value * (1 - fx) + d.value * fx) * fy, -9999e0), 6) as elevation from (
  select boring_key, i, j, (latitude_deg - 35e0) / 0.1e0 - i as fy, (longitude_deg - 138.5e0) / 0.1e0 - j as fx, latitude_deg, longitude_deg from (
    select *, cast(least(greatest(ceil((latitude_deg - 35e0) / 0.1e0), 1), 25) as int) - 1 as i, cast(least(greatest(ceil((longitude_deg - 138.5e0) / 0.1e0), 1), 25) as int) - 1 as j from fx_loc)) p
left join fx_grid a on a.row = i and a.col = j left join fx_grid b on b.row = i and b.col = j + 1
left join fx_grid c on c.row = i + 1 and c.col = j left join fx_grid d on d.row = i + 1 and d.col = j + 1""", LOC_CTE, GRID_CTE))
def j5_raster_bilinear(spark, sf):
    out = lay.sample_bilinear(locations(spark, sf), raster_grid(spark, sf), RASTER, "elevation", -9999.0)
    return rounded(out.select("boring_key", "elevation"), "elevation")


@query("j6_raster_nearest", check_sql("""
select boring_key, round(coalesce(g.value, -9999e0), 6) as elevation from (
  select *, cast(least(greatest(ceil((latitude_deg - 35e0) / 0.1e0 - 0.5e0), 0), 25) as int) as i, cast(least(greatest(ceil((longitude_deg - 138.5e0) / 0.1e0 - 0.5e0), 0), 25) as int) as j from fx_loc) p
left join fx_grid g on g.row = i and g.col = j""", LOC_CTE, GRID_CTE))
def j6_raster_nearest(spark, sf):
    out = lay.sample_nearest(locations(spark, sf), raster_grid(spark, sf), RASTER, "elevation", -9999.0)
    return rounded(out.select("boring_key", "elevation"), "elevation")


@query("j7_knn_join", check_sql("select qk as boring_key, cast(rn as int) as rank, pk as neighbour, round(sqrt(d2), 6) as km from nn", HOLES_CTE,
                                _knn_sql("fx_holes", "fx_holes", 6, "q.boring_key <> p.boring_key")))
def j7_knn_join(spark, sf):
    h = holes(spark, sf).select("boring_key", "x", "y")
    near = nearest.knn_join(h, h, 7, query_key="boring_key", point_key="boring_key", coords=["x", "y"], rows_per_tile=300)
    z = near.select("boring_key", F.posexplode(F.slice(F.filter(F.arrays_zip("distances", "neighbours"), lambda n: n["neighbours"] != F.col("boring_key")), 1, 6)).alias("rank", "n"))
    return z.select("boring_key", (F.col("rank") + 1).alias("rank"), F.col("n.neighbours").alias("neighbour"), r6(F.col("n.distances")).alias("km"))


@query("j8_radius_join", check_sql("""
select boring_key, round(latitude_deg, 6) as latitude_deg from fx_loc p where exists (select 1 from fx_loc q where q.regime_code = 6 and
  2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(p.latitude_deg - q.latitude_deg) / 2), 2) + cos(radians(q.latitude_deg)) * cos(radians(p.latitude_deg)) * pow(sin(radians(p.longitude_deg - q.longitude_deg) / 2), 2))) <= 8)""", LOC_CTE))
def j8_radius_join(spark, sf):
    """All boreholes within 8 km of a limestone borehole."""
    x, y, z = geo.sphere_xyz(F.col("latitude_deg"), F.col("longitude_deg"))
    p = locations(spark, sf).withColumns({"x": x, "y": y, "z": z})
    near = nearest.within_radius(p, p.where("regime_code = 6"), geo.arc_to_chord_km(8.0), point_key="boring_key", coords=["x", "y", "z"])
    return rounded(near.select("boring_key", "latitude_deg"), "latitude_deg")


LAG_CTE = HOLES_CTE + """,
lags as (select cast(floor(d / 5) as int) as lag, count(*) as n_pairs, avg(e * e) / 2 as gamma from (
  select sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d, a.err - b.err as e from fx_holes a join fx_holes b on a.boring_key < b.boring_key) where d < 100 group by 1)"""


@query("j12_e13_variogram", check_sql("select lag, n_pairs, round(gamma, 6) as gamma from lags", LAG_CTE))
def j12_e13_variogram(spark, sf):
    return rounded(pairs.lag_pairs(holes(spark, sf), "boring_key", "x", "y", "err"), "gamma")


@query("e13_sill", check_sql("select round(avg(gamma) filter ((lag + 0.5e0) * 5 > 50), 6) as sill from lags", LAG_CTE))
def e13_sill(spark, sf):
    return rounded(pairs.sill(pairs.lag_pairs(holes(spark, sf), "boring_key", "x", "y", "err")), "sill")


@query("e14_morans_i", check_sql("""
select (select count(*) from fx_holes) as n, round(((select count(*) from fx_holes) / count(*)) * sum((q.err - m) * (perr - m)) / (select sum((err - m) * (err - m)) from fx_holes, mu), 6) as morans_i
from nn join fx_holes q on q.boring_key = qk cross join mu""", HOLES_CTE, "mu as (select avg(err) as m from fx_holes)",
                                 _knn_sql("fx_holes", "fx_holes", 6, "q.boring_key <> p.boring_key")))
def e14_morans_i(spark, sf):
    h = holes(spark, sf).select("boring_key", "x", "y", "err")
    near = nearest.knn_join(h, h, 7, query_key="boring_key", point_key="boring_key", coords=["x", "y"], payload=["err"])
    z = F.filter(F.arrays_zip("neighbours", "errs"), lambda n: n["neighbours"] != F.col("boring_key"))
    near = near.withColumnRenamed("err", "errs").withColumn("errs", F.transform(F.slice(z, 1, 6), lambda n: n["errs"]))
    joined = near.select("boring_key", "errs").join(h.select("boring_key", "err"), "boring_key")
    return rounded(pairs.morans_i(joined, "err", "errs"), "morans_i")


def across_folds(df, k: int, key: str, coords, payload=()):
    """The k nearest rows of the other folds, for the rows of every fold: one tiling for all."""
    return nearest.knn_join(df, df, k, query_key=key, point_key=key, coords=coords, payload=payload, exclude="fold")


@query("e10_distance_cohorts", check_sql("""
select cohort, count(*) as n_rows, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) as rmse from fx_pred join (
  select qk as boring_key, case when d2 < 1 then 0 when d2 < 4 then 1 when d2 < 25 then 2 when d2 < 100 then 3 else 4 end as cohort from nn) using (boring_key) group by cohort""",
    HOLES_CTE, _knn_sql("fx_holes", "fx_holes", 1, "q.fold <> p.fold")))
def e10_distance_cohorts(spark, sf):
    h = holes(spark, sf)
    near = across_folds(h, 1, "boring_key", ["x", "y"])
    d = F.col("distances")[0]
    c = near.select("boring_key", F.when(d < 1, 0).when(d < 2, 1).when(d < 5, 2).when(d < 10, 3).otherwise(4).alias("cohort"))
    r = residual()
    out = inputs.predictions(spark, sf).join(c, "boring_key").groupBy("cohort").agg(F.count(F.lit(1)).alias("n_rows"), F.sqrt(F.avg(r * r)).alias("rmse"))
    return rounded(out, "rmse")


@query("m1_idw_boreholes", check_sql("""
select qk as boring_key, round(sum(pv / pow(greatest(sqrt(d2), 1e-12), 2)) / sum(1 / pow(greatest(sqrt(d2), 1e-12), 2)), 5) as idw from nn group by qk""",
    HOLES_CTE, _knn_sql("fx_holes", "fx_holes", 16, "q.fold <> p.fold")))
def m1_idw_boreholes(spark, sf):
    h = holes(spark, sf)
    near = across_folds(h, 16, "boring_key", ["x", "y"], ["v"])
    return near.select("boring_key", F.round(nearest.weighted_mean("v"), 5).alias("idw"))


def idw_rows(spark, sf, z_scale: float = 0.001, k: int = 16):
    """IDW of every row from all rows of the other folds in (x, y, depth)."""
    p = inputs.predictions(spark, sf)
    x, y = geo.local_km(F.col("latitude_deg"), F.col("longitude_deg"), 36.0, 139.7)
    p = p.select("row_key", "fold", "n_value", x.alias("x"), y.alias("y"), (F.col("depth_from_surface") * z_scale).alias("z"))
    near = across_folds(p, k, "row_key", ["x", "y", "z"], ["n_value"])
    return near.select("row_key", nearest.weighted_mean("n_value").alias("y_pred"))


@query("m1_idw_rows")
def m1_idw_rows(spark, sf):
    return rounded(idw_rows(spark, sf), "y_pred")


@query("j15_covariate_registry", check_sql("""
select boring_key, round(a, 4) as elevation, b as group_code, round(a + 2 * case when c.lithology_ja like '%石灰岩%' then 8 else 0 end, 4) as stacked from (
  select l.boring_key, l.latitude_deg, l.longitude_deg, coalesce(g.value, 0e0) as a, cast(l.boring_key % 3 as int) as b from (
    select *, cast(least(greatest(ceil((latitude_deg - 35e0) / 0.1e0 - 0.5e0), 0), 25) as int) as i, cast(least(greatest(ceil((longitude_deg - 138.5e0) / 0.1e0 - 0.5e0), 0), 25) as int) as j from fx_loc) l
  left join fx_grid g on g.row = i and g.col = j)
left join fx_cache c on c.lat = round_even(latitude_deg * 1e4, 0) / 1e4 and c.lon = round_even(longitude_deg * 1e4, 0) / 1e4""", LOC_CTE, GRID_CTE, SAMPLES_CTE, CACHE_CTE))
def j15_covariate_registry(spark, sf):
    grid, cache = raster_grid(spark, sf), legend_cache(spark, sf)

    def limestone(df, name):
        out = legends.with_legend(df, cache).withColumn(name, F.when(legend.litho_macro_code(F.col("lithology_ja")) == 8, 8.0).otherwise(0.0))
        return out.select(*df.columns, name)

    registry = [lay.Covariate("elevation", lambda df, n: lay.sample_nearest(df, grid, RASTER, n, 0.0)),
                lay.Covariate("group_code", lambda df, n: df.withColumn(n, (F.col("boring_key") % 3).cast("int")), continuous=False),
                lay.Covariate("limestone", limestone)]
    out = lay.apply_registry(locations(spark, sf), registry)
    return out.select("boring_key", F.round("elevation", 4).alias("elevation"), "group_code",
                      F.round(F.col("covariates")[0] + 2 * F.col("covariates")[1], 4).alias("stacked"))

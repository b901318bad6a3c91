"""Queries: tiles, grids and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsieve.operators import grids as gr, layers as lay
from groundsieve.operators.profiles import location_summary
from groundsieve.plans import inputs
from groundsieve.plans.ingest import POLYGON_CTE, line_features, region_polygons, scratch
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.keys import cdf_sql
from groundsieve.plans.nearby import GRID_CTE, RASTER, raster_grid
from groundsieve.plans.registry import query, r6, rounded
from groundsieve.sources import layers as src

BOX_CTE = "bx as (select min(latitude_deg) as y0, max(latitude_deg) as y1, min(longitude_deg) as x0, max(longitude_deg) as x1 from fx_raw)"
TILES_CTE = BOX_CTE + """,
fx_tiles as (select *, ((mesh_row // 8) * 100 + mesh_col // 8) * 100 + (mesh_row % 8) * 10 + mesh_col % 8 as tile_id, mesh_row / 12e0 as lat_min, (mesh_row + 1) / 12e0 as lat_max,
    mesh_col / 8e0 + 100 as lon_min, (mesh_col + 1) / 8e0 + 100 as lon_max from (
  select distinct cast(floor((y0 + a / 12e0) * 12e0) as bigint) as mesh_row, cast(floor((x0 + b / 8e0 - 100) * 8e0) as bigint) as mesh_col
  from bx cross join range(40) r(a) cross join range(40) s(b) where a <= floor((y1 - y0 + 1e-9) * 12e0) and b <= floor((x1 - x0 + 1e-9) * 8e0)))"""
HALO_CTE = """
fx_halo as (select tile_id, mesh_row, mesh_col, lat_min - 2 / 111.32e0 as lat_min, lat_max + 2 / 111.32e0 as lat_max,
  lon_min - 2 / (111.32e0 * greatest(cos(radians((lat_min + lat_max) / 2)), 0.1e0)) as lon_min, lon_max + 2 / (111.32e0 * greatest(cos(radians((lat_min + lat_max) / 2)), 0.1e0)) as lon_max from fx_tiles)"""


def study_box(spark, sf):
    return inputs.measurements(spark, sf).agg(F.min("latitude_deg").alias("lat_min"), F.min("longitude_deg").alias("lon_min"),
                                              F.max("latitude_deg").alias("lat_max"), F.max("longitude_deg").alias("lon_max"))


def study_tiles(spark, sf):
    return gr.tiles(study_box(spark, sf), 2)


BOUNDS = ["lat_min", "lat_max", "lon_min", "lon_max"]


@query("p1_tile_enumeration", check_sql("select tile_id, round(lat_min, 6) as lat_min, round(lat_max, 6) as lat_max, round(lon_min, 6) as lon_min, round(lon_max, 6) as lon_max from fx_tiles order by lat_min, lon_min", TILES_CTE))
def p1_tile_enumeration(spark, sf):
    return rounded(study_tiles(spark, sf).select("tile_id", *BOUNDS), *BOUNDS).orderBy("lat_min", "lon_min")


@query("p2_halo_bounds", check_sql("select tile_id, round(lat_min, 6) as lat_min, round(lat_max, 6) as lat_max, round(lon_min, 6) as lon_min, round(lon_max, 6) as lon_max from fx_halo", TILES_CTE, HALO_CTE))
def p2_halo_bounds(spark, sf):
    return rounded(gr.halo(study_tiles(spark, sf), 2.0).select("tile_id", *BOUNDS), *BOUNDS)


@query("p2_halo_rows", check_sql("""
select tile_id, count(*) as n_rows, round(sum(n_value), 6) as n_sum from fx_halo join fx_raw on latitude_deg between lat_min and lat_max and longitude_deg between lon_min and lon_max group by tile_id""", TILES_CTE, HALO_CTE))
def p2_halo_rows(spark, sf):
    rows = gr.halo_rows(inputs.measurements(spark, sf).drop("mesh_row", "mesh_col"), gr.halo(study_tiles(spark, sf), 2.0))
    return rows.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("n_value")).alias("n_sum"))


NODES_CTE = """
fx_nodes as (select tile_id, lat_i, lon_i, lat_min + lat_i * dlat as latitude_deg, lon_min + lon_i * dlon as longitude_deg from (
  select *, 2500e0 / 111320e0 as dlat, 2500e0 / 111320e0 / greatest(abs(cos(radians((lat_min + lat_max) / 2))), 0.1e0) as dlon from fx_tiles)
  cross join range(20) a(lat_i) cross join range(20) b(lon_i) where lat_i < ceil((lat_max - lat_min) / dlat + 0.5e0) and lon_i < ceil((lon_max - lon_min) / dlon + 0.5e0))"""


@query("p3_tile_grid", check_sql("""
select tile_id, cast(lat_i as int) as lat_i, cast(lon_i as int) as lon_i, round(latitude_deg, 6) as latitude_deg, round(longitude_deg, 6) as longitude_deg, depth_from_surface
from fx_nodes cross join (values (5e0), (15e0)) d(depth_from_surface)""", TILES_CTE, NODES_CTE))
def p3_tile_grid(spark, sf):
    return rounded(gr.tile_grid(study_tiles(spark, sf), 2500.0, [5.0, 15.0]), "latitude_deg", "longitude_deg")


@query("p4_grid_covariates", check_sql("""
select tile_id, count(*) as n_nodes, round(avg(coalesce(g.value, -1e0)), 6) as elevation, round(avg(cast(coalesce(poly, 0) as double)), 6) as polygon from (
  select n.*, cast(least(greatest(ceil((latitude_deg - 35e0) / 0.1e0 - 0.5e0), 0), 25) as int) as i, cast(least(greatest(ceil((longitude_deg - 138.5e0) / 0.1e0 - 0.5e0), 0), 25) as int) as j,
    (latitude_deg < 35e0 or latitude_deg > 37.5e0 or longitude_deg < 138.5e0 or longitude_deg > 141e0) as oob,
    (select min(poly_id) + 1 from fx_rect where longitude_deg >= x0 and longitude_deg < x1 and latitude_deg >= y0 and latitude_deg < y1) as poly from fx_nodes n)
left join fx_grid g on g.row = i and g.col = j and not oob group by tile_id""", TILES_CTE, NODES_CTE, GRID_CTE, POLYGON_CTE))
def p4_grid_covariates(spark, sf):
    nodes = gr.tile_grid(study_tiles(spark, sf), 2500.0, [5.0]).withColumn("node", F.xxhash64("tile_id", "lat_i", "lon_i"))
    edges = src.edges_from_vertices(src.polygon_vertices(region_polygons(spark, sf), "geometry", "poly_id"), "poly_id").withColumn("code", F.col("poly_id") + 1)
    out = lay.polygon_code(lay.sample_nearest(nodes, raster_grid(spark, sf), RASTER, "elevation", -1.0), edges, "node", 0)
    out = out.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("elevation").alias("elevation"), F.avg(F.col("code").cast("double")).alias("polygon"))
    return rounded(out, "elevation", "polygon")


@query("p5_point_prediction_bounds", check_sql("""
select row_key, round(y_pred - 1.6448536269514715e0 * y_std, 6) as q05, round(y_pred + 1.6448536269514715e0 * y_std, 6) as q95 from fx_pred"""))
def p5_point_prediction_bounds(spark, sf):
    out = gr.with_bounds_90(inputs.predictions(spark, sf), "y_pred", "y_std")
    return rounded(out.select("row_key", "q05", "q95"), "q05", "q95")


@query("p6_polygon_request", check_sql("""
select tile_id, count(*) as n_nodes, round(min(latitude_deg), 6) as lat0, round(max(longitude_deg), 6) as lon1 from (
  select tile_id, lat_min + lat_i * dlat as latitude_deg, lon_min + lon_i * dlon as longitude_deg from (
    select *, 2000e0 / 111320e0 as dlat, 2000e0 / 111320e0 / greatest(abs(cos(radians((lat_min + lat_max) / 2))), 0.1e0) as dlon from (
      select *, ((mesh_row // 8) * 100 + mesh_col // 8) * 100 + (mesh_row % 8) * 10 + mesh_col % 8 as tile_id, mesh_row / 12e0 as lat_min, (mesh_row + 1) / 12e0 as lat_max,
        mesh_col / 8e0 + 100 as lon_min, (mesh_col + 1) / 8e0 + 100 as lon_max from (
        select distinct cast(floor((y0 + a / 12e0) * 12e0) as bigint) as mesh_row, cast(floor((x0 + b / 8e0 - 100) * 8e0) as bigint) as mesh_col from fx_rect
        cross join range(40) r(a) cross join range(40) s(b) where poly_id = 2 and a <= floor((y1 - y0 + 1e-9) * 12e0) and b <= floor((x1 - x0 + 1e-9) * 8e0))))
  cross join range(20) a(lat_i) cross join range(20) b(lon_i) where lat_i < ceil((lat_max - lat_min) / dlat + 0.5e0) and lon_i < ceil((lon_max - lon_min) / dlon + 0.5e0)) group by tile_id""", POLYGON_CTE))
def p6_polygon_request(spark, sf):
    v = src.polygon_vertices(region_polygons(spark, sf).where("poly_id = 2"), "geometry", "poly_id")
    g = gr.polygon_request(v, "poly_id", 2000.0, [10.0], level=gr.pick_level(10.0))
    return rounded(g.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("latitude_deg").alias("lat0"), F.max("longitude_deg").alias("lon1")), "lat0", "lon1")


def linear_predictor(df):
    """A fixed linear model, for maps that must equal their check SQL."""
    mean = 4.0 + 0.8 * F.col("depth_from_surface") + 0.3 * F.col("river_distance_km") - 0.1 * F.col("coast_distance_km")
    return df.withColumns({"mean": mean, "std": 3.0 + 0.1 * F.col("depth_from_surface")})


def plane_predictor(df):
    mean = 2.0 + 0.7 * F.col("depth_from_surface") + 3.0 * (F.col("latitude_deg") - 35.0)
    return df.withColumns({"mean": mean, "std": F.lit(4.0)})


@query("p7_p8_region_cube_slice", check_sql("""
select tile_id, count(*) as n_nodes, round(avg(2e0 + 0.7e0 * 10 + 3e0 * (latitude_deg - 35)), 6) as mean_at_10m from fx_nodes group by tile_id""", TILES_CTE, NODES_CTE))
def p7_p8_region_cube_slice(spark, sf):
    """Writes the cube by tile, reads it back and takes the slice nearest to 11 m."""
    path = scratch(spark, "cube")
    gr.write_cube(gr.tile_grid(study_tiles(spark, sf), 2500.0, [5.0, 10.0, 20.0]), plane_predictor, path)
    cube = spark.read.parquet(path)
    out = gr.depth_slice(cube, 11.0).groupBy(F.col("tile_id").cast("long").alias("tile_id")).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.avg("mean").alias("mean_at_10m"))
    return rounded(out, "mean_at_10m")


def hole_table(spark, sf):
    s = location_summary(inputs.measurements(spark, sf), ["absolute_elevation", "river_distance_km", "coast_distance_km"])
    return s.withColumn("hole_id", F.xxhash64("latitude_deg", "longitude_deg"))


NEAR_CTE = BOX_CTE + """,
fx_at as (select i * 24 + j as node, y0 + (y1 - y0) * i / 17e0 as la, x0 + (x1 - x0) * j / 23e0 as lo from bx cross join range(18) a(i) cross join range(24) b(j)),
fx_hole as (select latitude_deg, longitude_deg, avg(river_distance_km) as river, avg(coast_distance_km) as coast from fx_raw group by 1, 2),
fx_near as (select node, min_by(river, d) as river, min_by(coast, d) as coast, min(d) as d from (
  select *, sqrt((la - latitude_deg) * (la - latitude_deg) + (lo - longitude_deg) * (lo - longitude_deg)) as d from fx_at cross join fx_hole) group by node)"""


@query("p9_exceedance_map", check_sql(f"""
select node, depth as depth_from_surface, map, round(case when d < 0.15e0 then {cdf_sql('z')} end, 6) as probability from (
  select node, depth, map, d, case when side = 'below' then (c - mu) / sd else (mu - c) / sd end as z from (
    select *, 4e0 + 0.8e0 * depth + 0.3e0 * river - 0.1e0 * coast as mu, 3e0 + 0.1e0 * depth as sd from fx_near cross join (values (5e0), (10e0), (20e0)) v(depth)
    cross join (values ('P(N<5)', 5, 'below'), ('P(N<10)', 10, 'below'), ('P(N<15)', 15, 'below'), ('P(N>30)', 30, 'above')) m(map, c, side)))""", NEAR_CTE))
def p9_exceedance_map(spark, sf):
    nodes = gr.box_grid(inputs.measurements(spark, sf), 18, 24)
    near = gr.with_nearest_borehole(nodes, hole_table(spark, sf), ["river_distance_km", "coast_distance_km"])
    return rounded(gr.exceedance_map(near, linear_predictor), "probability")


@query("p10_trust_mask", check_sql("""
select node, round(min(km), 6) as km, min(km) > 5 as do_not_trust from (
  select node, 2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(la - latitude_deg) / 2), 2) + cos(radians(la)) * cos(radians(latitude_deg)) * pow(sin(radians(lo - longitude_deg) / 2), 2))) as km
  from fx_at cross join fx_hole) group by node""", NEAR_CTE))
def p10_trust_mask(spark, sf):
    nodes = gr.box_grid(inputs.measurements(spark, sf), 18, 24)
    return rounded(gr.trust_mask(nodes, hole_table(spark, sf)), "km")


SITES = [("west", 35.6, 138.9), ("centre", 36.2, 139.7), ("east", 36.0, 140.5)]
SITES_CTE = "sites(site, la, lo) as (values ('west', 35.6e0, 138.9e0), ('centre', 36.2e0, 139.7e0), ('east', 36e0, 140.5e0))"


@query("p11_site_profile", check_sql("""
select site, depth as depth_from_surface, round(mu, 6) as mean, round(mu - 1.959963984540054e0 * sd, 6) as lo, round(mu + 1.959963984540054e0 * sd, 6) as hi from (
  select site, depth, 4e0 + 0.8e0 * depth + 0.3e0 * river - 0.1e0 * coast as mu, 3e0 + 0.1e0 * depth as sd from (
    select site, min_by(river, d) as river, min_by(coast, d) as coast from (select *, pow(la - latitude_deg, 2) + pow(lo - longitude_deg, 2) as d from sites cross join fx_hole) group by site)
  cross join (select cast(unnest(range(51)) as double) as depth))""", SITES_CTE, NEAR_CTE))
def p11_site_profile(spark, sf):
    here = inputs.measurements(spark, sf).sparkSession.createDataFrame([(i, n, a, b) for i, (n, a, b) in enumerate(SITES)], "node long, site string, latitude_deg double, longitude_deg double")
    near = gr.with_nearest_borehole(here, hole_table(spark, sf), ["river_distance_km", "coast_distance_km"])
    return rounded(gr.site_profile(near, linear_predictor), "mean", "lo", "hi")


@query("p11_site_observations", check_sql("""
select site, row_key, depth_from_surface, n_value from fx_raw join sites on abs(latitude_deg - la) <= 0.05e0 and abs(longitude_deg - lo) <= 0.05e0""", SITES_CTE))
def p11_site_observations(spark, sf):
    return gr.site_observations(inputs.measurements(spark, sf), SITES, 0.05).select("site", "row_key", "depth_from_surface", "n_value")


@query("p12_coast_distance_grid")
def p12_coast_distance_grid(spark, sf):
    nodes = gr.box_grid(inputs.measurements(spark, sf), 40, 40)
    seg = src.segments_from_lines(line_features(spark, sf))
    out = lay.line_distance(nodes, seg, "node", "coast_distance_km")
    return out.select("node", F.round(F.col("coast_distance_km").cast("double"), 3).alias("coast_distance_km"))


@query("p13_polygon_rasterise", check_sql("""
select node, coalesce((select min(poly_id) + 1 from fx_rect where lo >= x0 and lo < x1 and la >= y0 and la < y1), 0) as class from fx_at""", NEAR_CTE, POLYGON_CTE))
def p13_polygon_rasterise(spark, sf):
    nodes = gr.box_grid(inputs.measurements(spark, sf), 18, 24)
    edges = src.edges_from_vertices(src.polygon_vertices(region_polygons(spark, sf), "geometry", "poly_id"), "poly_id").withColumn("code", F.col("poly_id") + 1)
    return lay.polygon_code(nodes, edges, "node", 0).select("node", F.col("code").alias("class"))

"""Queries: sources, quality control, samples."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from groundsieve.operators import quality
from groundsieve.plans import inputs
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.registry import query, rounded
from groundsieve.session import local_folder
from groundsieve.sources import layers, measurements, summaries


def scratch(spark, name: str) -> str:
    """A new folder for a written layer: beside the shared checkpoints if the session names a
    folder, else a temporary one on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        stamp = spark.sql("select uuid()").first()[0]
        return f"{shared.rstrip('/')}/{name}-{stamp}"
    return os.path.join(local_folder(spark), name)


RAW_COLS = ["latitude_deg", "longitude_deg", "spt_start_depth", "n_value", "mouth_elevation"]


@query("s1_csv_scan", check_sql("""
select count(*) as n_rows, count(distinct (latitude_deg, longitude_deg)) as n_locations,
  round(sum(n_value), 6) as n_sum, round(sum(spt_start_depth), 4) as depth_sum, round(sum(mouth_elevation), 4) as elevation_sum
from fx_raw"""))
def s1_csv_scan(spark, sf):
    path = scratch(spark, "raw")
    inputs.measurements(spark, sf).select(*RAW_COLS).write.option("header", True).csv(path)
    df = measurements.read_csv(spark, path)
    holes = df.groupBy("latitude_deg", "longitude_deg").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_value").alias("v"), F.sum("spt_start_depth").alias("d"), F.sum("mouth_elevation").alias("e"))
    return holes.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_locations"),
                     F.round(F.sum("v"), 6).alias("n_sum"), F.round(F.sum("d"), 4).alias("depth_sum"),
                     F.round(F.sum("e"), 4).alias("elevation_sum"))


@query("s2_parquet_projection", """
select l_linenumber, count(*) as n_rows, round(sum(l_quantity), 6) as quantity from lineitem group by l_linenumber""")
def s2_parquet_projection(spark, sf):
    df = measurements.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_linenumber", "l_quantity"])
    return df.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("s3_parquet_sink", check_sql("""
select cast(regime_code as smallint) as regime_code, count(*) as n_rows, round(sum(cast(cast(n_value as float) as double)), 6) as n_sum,
  round(sum(cast(cast(depth_from_surface as float) as double)), 3) as depth_sum
from fx_raw group by regime_code"""))
def s3_parquet_sink(spark, sf):
    path = scratch(spark, "enriched")
    measurements.write_parquet(measurements.final_schema(inputs.measurements(spark, sf)), path)
    df = spark.read.parquet(path)
    return df.groupBy("regime_code").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.col("n_value").cast("double")), 6).alias("n_sum"),
        F.round(F.sum(F.col("depth_from_surface").cast("double")), 3).alias("depth_sum"))


def line_features(spark, sf):
    """Line features from nations: five points each across the study box (lon, lat order)."""
    n = inputs.table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("double")
    pts = F.array(*[F.array(F.lit(138.5) + F.lit(0.625 * i) + k * 0.01,
                            F.lit(35.0) + F.pmod(k * (0.37 + 0.11 * i), F.lit(2.5))) for i in range(5)])
    return n.select(F.col("n_nationkey").alias("line_id"), F.concat(F.lit("P"), F.col("n_regionkey").cast("string")).alias("pref"),
                    pts.alias("coordinates"))


def _pt(i: int) -> str:
    return (f"138.5e0 + {0.625 * i}e0 + cast(n_nationkey as double) * 0.01e0 as x{i}, "
            f"35e0 + (cast(n_nationkey as double) * {0.37 + 0.11 * i:.17g}e0) % 2.5e0 as y{i}")


SEGMENTS_CTE = ("fx_points as (select n_nationkey as line_id, 'P' || cast(n_regionkey as varchar) as pref, "
                + ", ".join(_pt(i) for i in range(5)) + " from nation),\n"
                "fx_segments as (" + " union all ".join(
                    f"select line_id, pref, {i} as seq, y{i} as lat1, x{i} as lon1, y{i + 1} as lat2, x{i + 1} as lon2 from fx_points"
                    for i in range(4)) + ")")


@query("s4_line_layer", check_sql("""
select line_id, seq, round(lat1, 6) as lat1, round(lon1, 6) as lon1, round(lat2, 6) as lat2, round(lon2, 6) as lon2
from fx_segments where pref in ('P0', 'P2', 'P3')""", SEGMENTS_CTE))
def s4_line_layer(spark, sf):
    path = scratch(spark, "lines")
    line_features(spark, sf).write.json(path)
    seg = layers.read_line_layers(spark, [path], prefectures=["P0", "P2", "P3"])
    return rounded(seg, "lat1", "lon1", "lat2", "lon2")


def region_polygons(spark, sf):
    """One rectangle per region, overlapping its neighbour by 0.1 degrees, as GeoJSON text.

    Even regions are Polygon geometries, odd ones MultiPolygon features.
    """
    r = inputs.table(spark, sf, "region")
    k = F.col("r_regionkey").cast("double")
    x0, x1 = F.lit(138.55) + k * 0.45, F.lit(138.55) + (k + 1) * 0.45 + 0.1
    pt = lambda x, y: F.concat(F.lit("["), F.round(x, 6).cast("string"), F.lit(f",{y}]"))
    ring = F.concat(F.lit("["), F.concat_ws(",", pt(x0, 35.05), pt(x1, 35.05), pt(x1, 37.0), pt(x0, 37.0), pt(x0, 35.05)), F.lit("]"))
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))
    multi = F.concat(F.lit('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[['), ring, F.lit("]]}}"))
    return r.select(F.col("r_regionkey").alias("poly_id"), F.when(F.col("r_regionkey") % 2 == 0, polygon).otherwise(multi).alias("geometry"))


POLYGON_CTE = """
fx_rect as (select r_regionkey as poly_id, round(138.55e0 + cast(r_regionkey as double) * 0.45e0, 6) as x0,
  round(138.55e0 + (cast(r_regionkey as double) + 1) * 0.45e0 + 0.1e0, 6) as x1, 35.05e0 as y0, 37e0 as y1 from region),
fx_vertices as (
  select poly_id, 0 as seq, x0 as x, y0 as y from fx_rect union all select poly_id, 1, x1, y0 from fx_rect
  union all select poly_id, 2, x1, y1 from fx_rect union all select poly_id, 3, x0, y1 from fx_rect
  union all select poly_id, 4, x0, y0 from fx_rect),
fx_edges as (select a.poly_id, a.seq, a.x as x1, a.y as y1, b.x as x2, b.y as y2
  from fx_vertices a join fx_vertices b on a.poly_id = b.poly_id and b.seq = a.seq + 1)"""


@query("s5_geojson_vertices", check_sql(
    "select poly_id, 0 as part, 0 as ring, seq, x, y from fx_vertices", POLYGON_CTE))
def s5_geojson_vertices(spark, sf):
    return layers.polygon_vertices(region_polygons(spark, sf), "geometry", "poly_id")


@query("s5_polygon_edges", check_sql(
    "select poly_id, 0 as part, 0 as ring, seq, x1, y1, x2, y2 from fx_edges", POLYGON_CTE))
def s5_polygon_edges(spark, sf):
    return layers.edges_from_vertices(layers.polygon_vertices(region_polygons(spark, sf), "geometry", "poly_id"), "poly_id")


def raster_tiles(spark, sf):
    """Elevation cells at 0.1 degrees by averaging mouth elevations; two overlapping tiles."""
    m = inputs.measurements(spark, sf)
    cells = m.groupBy(F.floor((F.col("latitude_deg") - 35.0) * 10).cast("int").alias("row"),
                      F.floor((F.col("longitude_deg") - 138.5) * 10).cast("int").alias("col")).agg(
        F.round(F.avg("mouth_elevation"), 6).alias("value"))
    tile = F.explode(F.when(F.col("col") < 11, F.array(F.lit(0))).when(F.col("col") > 13, F.array(F.lit(1)))
                     .otherwise(F.array(F.lit(0), F.lit(1))))
    return cells.select("row", "col", "value", tile.alias("tile_seq")).withColumn(
        "value", F.col("value") + 1000.0 * F.col("tile_seq"))


RASTER_CTE = """
fx_cells as (select cast(floor((latitude_deg - 35e0) * 10) as int) as row, cast(floor((longitude_deg - 138.5e0) * 10) as int) as col,
  round(avg(mouth_elevation), 6) as value from fx_raw group by 1, 2),
fx_tiles as (select row, col, value, 0 as tile_seq from fx_cells where col <= 13
  union all select row, col, value + 1000e0, 1 from fx_cells where col >= 11)"""


@query("s10_raster_mosaic", check_sql("""
select row, col, round(min_by(value, tile_seq), 6) as value from fx_tiles group by row, col""", RASTER_CTE))
def s10_raster_mosaic(spark, sf):
    return rounded(layers.mosaic(raster_tiles(spark, sf)), "value")


@query("s11_provenance_rollup", check_sql("""
select 'run_' || cast(regime_code as varchar) as run_name, count(*) as n_folds, cast(sum(n_test) as bigint) as n_test, round(avg(rmse), 6) as rmse_mean,
  round(avg(mae), 6) as mae_mean, round(avg(std_mean), 6) as std_mean
from (select regime_code, fold, count(*) as n_test, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) as rmse,
             avg(abs(y_true - y_pred)) as mae, avg(y_std) as std_mean
      from fx_pred group by regime_code, fold) group by regime_code"""))
def s11_provenance_rollup(spark, sf):
    """Writes one summary document per regime, as runs do, then reads the folder back."""
    r = F.col("y_true") - F.col("y_pred")
    folds = inputs.predictions(spark, sf).groupBy("regime_code", "fold").agg(
        F.lit(0).cast("long").alias("n_train"), F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(r * r)).alias("rmse"),
        F.avg(F.abs(r)).alias("mae"), F.avg("y_std").alias("std_mean"))
    runs = folds.groupBy("regime_code").agg(
        F.collect_list(F.struct("fold", "n_train", "n_test", "rmse", "mae", "std_mean")).alias("spatial_kfold"),
        F.sum("n_test").alias("n_samples"))
    path = scratch(spark, "runs")
    (runs.select(F.concat(F.lit("run_"), F.col("regime_code").cast("string")).alias("run_name"), "n_samples", "spatial_kfold",
                 F.col("regime_code").alias("run"))
     .repartition("run").write.partitionBy("run").json(path))
    out = summaries.fold_means(summaries.read_summaries(spark, [path]))
    return rounded(out, "rmse_mean", "mae_mean", "std_mean")


def dirty(spark, sf):
    """Measurements with quality-control boundary cases mixed in by row key."""
    k = F.col("k")
    # a generated column is not put back into every comparison and check, each of which would round the price of its row again
    m = inputs.measurements(spark, sf).select("*", F.explode(F.array(F.col("row_key") % 997)).alias("k"))
    return m.select(
        "row_key", F.when(k == 1, None).when(k == 2, 20.0).when(k == 3, 50.0).otherwise(F.col("latitude_deg")).alias("latitude_deg"),
        F.when(k == 4, 120.0).when(k == 5, float("nan")).otherwise(F.col("longitude_deg")).alias("longitude_deg"),
        F.when(k == 6, 101.0).when(k == 7, 100.0).when(k == 8, 0.0).when(k == 9, -1.0).otherwise(F.col("n_value")).alias("n_value"),
        "spt_start_depth",
        F.when(k == 10, -1000.0).when(k == 11, None).when(k == 12, 4999.0).otherwise(F.col("mouth_elevation")).alias("mouth_elevation"))


DIRTY_CTE = """
fx_dirty as (select row_key,
  case row_key % 997 when 1 then null when 2 then 20e0 when 3 then 50e0 else latitude_deg end as latitude_deg,
  case row_key % 997 when 4 then 120e0 when 5 then cast('nan' as double) else longitude_deg end as longitude_deg,
  case row_key % 997 when 6 then 101e0 when 7 then 100e0 when 8 then 0e0 when 9 then -1e0 else n_value end as n_value,
  spt_start_depth,
  case row_key % 997 when 10 then -1000e0 when 11 then null when 12 then 4999e0 else mouth_elevation end as mouth_elevation
  from fx_raw)"""
CLEAN_WHERE = """latitude_deg is not null and longitude_deg is not null and not isnan(longitude_deg) and mouth_elevation is not null
  and latitude_deg > 20 and latitude_deg < 50 and longitude_deg > 120 and longitude_deg < 150
  and mouth_elevation > -1000 and mouth_elevation < 5000 and n_value between 0 and 100"""


@query("f1_f2_clean", check_sql(f"""
select row_key, latitude_deg, longitude_deg, n_value, mouth_elevation from fx_dirty where {CLEAN_WHERE}""", DIRTY_CTE))
def f1_f2_clean(spark, sf):
    return quality.clean(dirty(spark, sf)).select("row_key", "latitude_deg", "longitude_deg", "n_value", "mouth_elevation")


@query("f3_box_filter", check_sql("""
select row_key, latitude_deg, longitude_deg from fx_raw
where latitude_deg between 36.7e0 and 37.6e0 and longitude_deg between 140e0 and 140.7e0"""))
def f3_box_filter(spark, sf):
    m = inputs.measurements(spark, sf).select("row_key", "latitude_deg", "longitude_deg")
    return quality.in_box(m, quality.REGIONS["abukuma"])


@query("f4_derived_columns", check_sql("""
select row_key, spt_start_depth as depth_from_surface, round(mouth_elevation - spt_start_depth, 6) as absolute_elevation from fx_raw"""))
def f4_derived_columns(spark, sf):
    m = inputs.measurements(spark, sf).drop("depth_from_surface", "absolute_elevation")
    return rounded(quality.derive(m).select("row_key", "depth_from_surface", "absolute_elevation"), "absolute_elevation")


@query("f5_quality_funnel", check_sql("""
select step, name as "check", count(*) as n_rows, count(distinct (coalesce(latitude_deg, -1), longitude_deg)) as n_boreholes,
  (select count(*) from t where stage = 5 and n_value = 100) as n_at_cap
from t join (values (0, 'raw'), (1, 'keys'), (2, 'coordinates'), (3, 'elevation'), (4, 'n_range'), (5, 'box')) v(step, name) on t.stage >= v.step
group by step, name""", DIRTY_CTE, """
s as (select *,
  (latitude_deg is not null and longitude_deg is not null and not isnan(longitude_deg) and mouth_elevation is not null) as c1,
  coalesce(latitude_deg > 20 and latitude_deg < 50 and longitude_deg > 120 and longitude_deg < 150, false) as c2,
  coalesce(mouth_elevation > -1000 and mouth_elevation < 5000, false) as c3, n_value between 0 and 100 as c4,
  coalesce(latitude_deg between 35 and 37.5 and longitude_deg between 138.5 and 141, false) as c5 from fx_dirty),
t as (select *, case when not c1 then 0 when not c2 then 1 when not c3 then 2 when not c4 then 3 when not c5 then 4 else 5 end as stage from s)"""))
def f5_quality_funnel(spark, sf):
    return quality.funnel(dirty(spark, sf), quality.REGIONS["kanto"])


@query("f6_exact_sample", check_sql("""
select row_key, n_value from fx_raw order by md5('7:' || cast(row_key as varchar)), row_key limit 500"""))
def f6_exact_sample(spark, sf):
    return quality.exact_sample(inputs.measurements(spark, sf).select("row_key", "n_value"), 500, "row_key", 7)


@query("f6_fraction_sample", check_sql("""
select row_key, n_value from fx_raw where (cast('0x' || substr(md5(concat_ws(':', '7', row_key)), 1, 12) as bigint) + 0.5e0) / 281474976710656e0 < 0.1e0"""))
def f6_fraction_sample(spark, sf):
    return quality.fraction_sample(inputs.measurements(spark, sf).select("row_key", "n_value"), 0.1, "row_key", 7)


@query("f7_stratified_sample", check_sql("""
select regime_code, row_key from ranked join final using (regime_code) where rn <= budget""", """
counts as (select regime_code, count(*) as n from fx_raw group by regime_code),
base as (select regime_code, n, least(n, cast(floor(3000 * sqrt(n) / (select sum(sqrt(n)) from counts)) as bigint)) as b from counts),
final as (select regime_code, n, least(n, b + case when regime_code = (select regime_code from base order by n desc, regime_code limit 1)
   then greatest(3000 - (select sum(b) from base), 0) else 0 end) as budget from base),
ranked as (select regime_code, row_key, row_number() over (partition by regime_code order by
   cast('0x' || substr(md5(cast(row_key as varchar)), 1, 12) as bigint), row_key) as rn from fx_raw)"""))
def f7_stratified_sample(spark, sf):
    m = inputs.measurements(spark, sf).select("row_key", "regime_code")
    order = F.conv(F.substring(F.md5(F.col("row_key").cast("string")), 1, 12), 16, 10).cast("long")
    return quality.stratified_sample(m, "regime_code", "row_key", order, 3000).select("regime_code", "row_key")


@query("f8_missing_guard", check_sql("""
select regime_code, count(*) as n_rows, round(avg(case when groundwater_depth_m is null then 1e0 else 0e0 end), 6) as dropped_share,
  case when avg(case when groundwater_depth_m is null then 1e0 else 0e0 end) > 0.2e0 then 'fail'
       when avg(case when groundwater_depth_m is null then 1e0 else 0e0 end) > 0.05e0 then 'warn' else 'ok' end as verdict
from fx_raw group by regime_code"""))
def f8_missing_guard(spark, sf):
    g = quality.missing_guard(inputs.measurements(spark, sf), ["groundwater_depth_m", "n_value"], by=["regime_code"])
    return rounded(g, "dropped_share")


@query("a9_metadata_completeness", check_sql("""
select (select count(*) from fx_raw) as n_rows, input, round(share, 6) as share from (
  select 'groundwater_depth_m' as input, avg(case when groundwater_depth_m is not null then 1e0 else 0e0 end) as share from fx_raw
  union all select 'mouth_elevation', avg(case when mouth_elevation is not null then 1e0 else 0e0 end) from fx_raw
  union all select 'energy_ratio', 0e0 from region where r_regionkey = 0)"""))
def a9_metadata_completeness(spark, sf):
    m = inputs.measurements(spark, sf)
    return rounded(quality.completeness(m, {
        "groundwater_depth_m": F.col("groundwater_depth_m"), "mouth_elevation": F.col("mouth_elevation"),
        "energy_ratio": F.lit(None).cast("double")}), "share")

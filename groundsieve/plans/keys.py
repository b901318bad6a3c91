"""Queries: mesh keys, geometry columns, region labels and scalar numerics."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from groundsieve.functions import geo, mesh, numeric
from groundsieve.functions.ordered import quantiles
from groundsieve.operators import regions
from groundsieve.plans import inputs
from groundsieve.plans.ingest import RASTER_CTE, raster_tiles
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.registry import query, r6, rounded
from groundsieve.sources import layers

LOC_CTE = "fx_loc as (select distinct boring_key, latitude_deg, longitude_deg, regime_code, mesh_row, mesh_col from fx_raw)"


def locations(spark, sf):
    return inputs.measurements(spark, sf).select(
        "boring_key", "latitude_deg", "longitude_deg", "regime_code", "mesh_row", "mesh_col").distinct()


def _mesh_sql(level, r, c):
    row, col = f"cast(floor(latitude_deg * {r}e0) as bigint)", f"cast(floor((longitude_deg - 100e0) * {c}e0) as bigint)"
    if level == 1:
        code = "r * 100 + c"
    elif level == 2:
        code = "((r // 8) * 100 + c // 8) * 100 + (r % 8) * 10 + c % 8"
    else:
        code = "(((r // 80) * 100 + c // 80) * 100 + ((r // 10) % 8) * 10 + (c // 10) % 8) * 100 + (r % 10) * 10 + c % 10"
    return f"select boring_key, {level} as level, r as mesh_row, c as mesh_col, {code} as mesh_code from (select boring_key, {row} as r, {col} as c from fx_loc)"


@query("g1_mesh_key", check_sql(" union all ".join([_mesh_sql(1, 1.5, 1), _mesh_sql(2, 12, 8), _mesh_sql(4, 120, 80)]), LOC_CTE))
def g1_mesh_key(spark, sf):
    loc = locations(spark, sf).drop("mesh_row", "mesh_col")
    keys = F.array(*[F.struct(F.lit(lv).alias("level"), mesh.mesh_row(F.col("latitude_deg"), lv).alias("mesh_row"),
                              mesh.mesh_col(F.col("longitude_deg"), lv).alias("mesh_col"),
                              mesh.pack(mesh.mesh_row(F.col("latitude_deg"), lv), mesh.mesh_col(F.col("longitude_deg"), lv), lv).alias("mesh_code"))
                     for lv in (1, 2, 4)])
    return loc.select("boring_key", F.inline(keys))


@query("g2_mesh_bounds", check_sql("""
select mesh_row, mesh_col, round(mesh_row / 12e0, 6) as lat_min, round((mesh_row + 1) / 12e0, 6) as lat_max,
  round(mesh_col / 8e0 + 100, 6) as lon_min, round((mesh_col + 1) / 8e0 + 100, 6) as lon_max,
  round((mesh_row + 0.5e0) / 12e0, 6) as lat_mid, round((mesh_col + 0.5e0) / 8e0 + 100, 6) as lon_mid
from (select distinct mesh_row, mesh_col from fx_raw)"""))
def g2_mesh_bounds(spark, sf):
    cells = inputs.measurements(spark, sf).select("mesh_row", "mesh_col").distinct()
    return rounded(mesh.with_bounds(cells), "lat_min", "lat_max", "lon_min", "lon_max", "lat_mid", "lon_mid")


@query("g3_mesh_ring", check_sql("""
select distinct mesh_row + dr as mesh_row, mesh_col + dc as mesh_col
from (select distinct mesh_row, mesh_col from fx_raw where regime_code = 6)
cross join (select unnest([-1, 0, 1]) as dr) cross join (select unnest([-1, 0, 1]) as dc)"""))
def g3_mesh_ring(spark, sf):
    cells = inputs.measurements(spark, sf).where("regime_code = 6").select("mesh_row", "mesh_col").distinct()
    return mesh.ring(cells, 1)


@query("g4_local_projection", check_sql("""
select boring_key, round((longitude_deg - lon0) * 111.32e0 * greatest(cos(radians(lat0)), 0.1e0), 6) as x_km,
  round((latitude_deg - lat0) * 111.32e0, 6) as y_km
from fx_loc, (select round(avg(latitude_deg), 9) as lat0, round(avg(longitude_deg), 9) as lon0 from fx_loc)""", LOC_CTE))
def g4_local_projection(spark, sf):
    loc = locations(spark, sf)
    ref = loc.agg(F.struct(F.round(F.avg("latitude_deg"), 9).alias("la"), F.round(F.avg("longitude_deg"), 9).alias("lo"))).scalar()
    x, y = geo.local_km(F.col("latitude_deg"), F.col("longitude_deg"), F.col("_r.la"), F.col("_r.lo"))
    return loc.withColumn("_r", ref).select("boring_key", r6(x).alias("x_km"), r6(y).alias("y_km"))


@query("g5_haversine", check_sql("""
select boring_key, round(2 * 6371.0088e0 * asin(sqrt(least(1e0,
  sin(radians(latitude_deg - 35.6812e0) / 2) * sin(radians(latitude_deg - 35.6812e0) / 2)
  + cos(radians(35.6812e0)) * cos(radians(latitude_deg)) * sin(radians(longitude_deg - 139.7671e0) / 2) * sin(radians(longitude_deg - 139.7671e0) / 2)))), 6) as km
from fx_loc""", LOC_CTE))
def g5_haversine(spark, sf):
    km = geo.haversine_km(F.lit(35.6812), F.lit(139.7671), F.col("latitude_deg"), F.col("longitude_deg"))
    return locations(spark, sf).select("boring_key", r6(km).alias("km"))


def _utm_sql() -> str:
    n = geo.GRS80_F / (2 - geo.GRS80_F)
    a0 = geo.GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    f = lambda v: f"cast('{v!r}' as double)"
    ch = lambda x: f"((exp({x}) + exp(-({x}))) / 2)"
    sh = lambda x: f"((exp({x}) - exp(-({x}))) / 2)"
    east = "eta" + "".join(f" + {f(a)} * cos({2 * j} * xi) * {sh(f'{2 * j} * eta')}" for j, a in enumerate(al, 1))
    north = "xi" + "".join(f" + {f(a)} * sin({2 * j} * xi) * {ch(f'{2 * j} * eta')}" for j, a in enumerate(al, 1))
    return f"""
select boring_key, round(500000e0 + {f(0.9996 * a0)} * ({east}), 3) as easting_m, round({f(0.9996 * a0)} * ({north}), 3) as northing_m
from (select boring_key, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + t * t)) as eta from (
  select boring_key, radians(longitude_deg - 141e0) as dl,
    {sh(f"atanh(sin(radians(latitude_deg))) - {f(e)} * atanh({f(e)} * sin(radians(latitude_deg)))")} as t from fx_loc))"""


@query("g6_utm54", check_sql(_utm_sql(), LOC_CTE))
def g6_utm54(spark, sf):
    x, y = geo.utm54(F.col("latitude_deg"), F.col("longitude_deg"))
    return locations(spark, sf).select("boring_key", F.round(x, 3).alias("easting_m"), F.round(y, 3).alias("northing_m"))


def _box_values(boxes) -> str:
    return ", ".join(f"({i}, '{n}', {b[0]}e0, {b[1]}e0, {b[2]}e0, {b[3]}e0)" for i, (n, b) in enumerate(boxes.items()))


BOXES_CTE = f"boxes(ord, name, la0, la1, lo0, lo1) as (values {_box_values(regions.REGION_BOXES)})"
PREFS_CTE = f"prefs(ord, name, la0, la1, lo0, lo1) as (values {_box_values(regions.PREFECTURE_BOXES)})"


@query("g7_region_boxes", check_sql("""
select boring_key, name as region from fx_loc join boxes on latitude_deg between la0 and la1 and longitude_deg between lo0 and lo1""",
                                    LOC_CTE, BOXES_CTE))
def g7_region_boxes(spark, sf):
    return locations(spark, sf).select("boring_key", F.explode(regions.regions_of()).alias("region"))


@query("g8_first_box", check_sql("""
select boring_key, coalesce((select upper(name[1]) || name[2:] from prefs where latitude_deg >= la0 and latitude_deg < la1
  and longitude_deg >= lo0 and longitude_deg < lo1 order by ord limit 1), 'Other') as prefecture from fx_loc""", LOC_CTE, PREFS_CTE))
def g8_first_box(spark, sf):
    return locations(spark, sf).select("boring_key", regions.first_box().alias("prefecture"))


@query("g9_nearest_centre", check_sql(f"""
select boring_key, min_by(name, d2) as pref from (
  select boring_key, name, ord, pow(latitude_deg - 0.5e0 * (la0 + la1), 2)
    + pow(longitude_deg * {math.cos(math.radians(36.0))!r}e0 - 0.5e0 * (lo0 + lo1) * {math.cos(math.radians(36.0))!r}e0, 2) as d2
  from fx_loc cross join prefs) group by boring_key""", LOC_CTE, PREFS_CTE))
def g9_nearest_centre(spark, sf):
    return locations(spark, sf).select("boring_key", regions.nearest_centre().alias("pref"))


PREF_LOOKUP_CTE = """
fx_prefs as (select latitude_deg, longitude_deg, min_by(name, ord) as pref from fx_loc join prefs on latitude_deg >= la0 and latitude_deg < la1
  and longitude_deg >= lo0 and longitude_deg < lo1 where boring_key % 7 <> 0 group by latitude_deg, longitude_deg)"""


def prefecture_lookup(spark, sf):
    loc = locations(spark, sf).where("boring_key % 7 <> 0").withColumn("pref", F.lower(regions.first_box()))
    return loc.where("pref <> 'other'").select("latitude_deg", "longitude_deg", "pref")


@query("g10_prefecture_lookup", check_sql("""
select l.boring_key, coalesce(p.pref, 'other') as pref from fx_loc l left join fx_prefs p using (latitude_deg, longitude_deg)""",
                                          LOC_CTE, PREFS_CTE, PREF_LOOKUP_CTE))
def g10_prefecture_lookup(spark, sf):
    return regions.with_prefecture(locations(spark, sf), prefecture_lookup(spark, sf)).select("boring_key", "pref")


@query("g11_density_grid", check_sql("""
select least(cast(floor((latitude_deg - y0) / (y1 - y0) * 60) as int), 59) as lat_bin,
  least(cast(floor((longitude_deg - x0) / (x1 - x0) * 60) as int), 59) as lon_bin, count(*) as n_locations
from (select distinct latitude_deg, longitude_deg from fx_raw),
  (select min(latitude_deg) as y0, max(latitude_deg) as y1, min(longitude_deg) as x0, max(longitude_deg) as x1 from fx_raw)
group by 1, 2"""))
def g11_density_grid(spark, sf):
    return regions.density_grid(inputs.measurements(spark, sf))


@query("n1_log_target", check_sql("""
select row_key, round(ln(1 + greatest(n_value - 3, 0e0)), 6) as y_log, round(exp(ln(1 + greatest(n_value - 3, 0e0))) - 1, 6) as y_back from fx_raw"""))
def n1_log_target(spark, sf):
    m = inputs.measurements(spark, sf).withColumn("_y", numeric.log_target(F.col("n_value") - 3))
    return m.select("row_key", r6("_y").alias("y_log"), r6(numeric.unlog_target(F.col("_y"))).alias("y_back"))


@query("n2_lognormal_moments", check_sql("""
select row_key, round(exp(m) - 1, 6) as median, round(exp(m + s * s / 2) - 1, 6) as mean,
  round(sqrt(exp(s * s) - 1) * exp(m + s * s / 2), 6) as std
from (select row_key, ln(1 + n_value) as m, 0.1e0 + y_std / 50 as s from fx_pred)"""))
def n2_lognormal_moments(spark, sf):
    p = inputs.predictions(spark, sf).select("row_key", F.log1p("n_value").alias("m"), (0.1 + F.col("y_std") / 50).alias("s"))
    median, std = numeric.unlog_moments(F.col("m"), F.col("s"))
    mean, _ = numeric.unlog_moments(F.col("m"), F.col("s"), "mean")
    return p.select("row_key", r6(median).alias("median"), r6(mean).alias("mean"), r6(std).alias("std"))


@query("n3_standardise", check_sql("""
select row_key, round((n_value - mu) / (sd + 1e-6), 6) as y_std from fx_raw, (select avg(n_value) as mu, stddev_pop(n_value) as sd from fx_raw)"""))
def n3_standardise(spark, sf):
    m = inputs.measurements(spark, sf).select("row_key", "n_value")
    s = m.agg(F.struct(F.avg("n_value").alias("mu"), F.stddev_pop("n_value").alias("sd"))).scalar()
    return m.withColumn("_s", s).select("row_key", r6((F.col("n_value") - F.col("_s.mu")) / (F.col("_s.sd") + 1e-6)).alias("y_std"))


@query("n4_regime_one_hot", check_sql("select boring_key, " + ", ".join(
    f"case when least(greatest(regime_code, 0), 7) = {i} then 1 else 0 end as regime_{i}" for i in range(8)) + " from fx_loc", LOC_CTE))
def n4_regime_one_hot(spark, sf):
    return locations(spark, sf).select("boring_key", *numeric.one_hot(F.col("regime_code"), 8, "regime"))


FEATURES = ["latitude_deg", "longitude_deg", "depth_from_surface", "absolute_elevation", "river_distance_km", "coast_distance_km"]


@query("n5_feature_vector", check_sql("""
select row_key, round(latitude_deg, 6) as x0, round(depth_from_surface, 6) as x2, round(coast_distance_km, 6) as x5,
  case when regime_code = 1 then 1e0 else 0e0 end as x7, 14 as width from fx_raw"""))
def n5_feature_vector(spark, sf):
    m = inputs.measurements(spark, sf).select("row_key", *FEATURES, *numeric.one_hot(F.col("regime_code"), 8, "regime"))
    v = VectorAssembler(inputCols=FEATURES + [f"regime_{i}" for i in range(8)], outputCol="features").transform(m)
    v = v.withColumn("_a", vector_to_array("features"))
    return v.select("row_key", r6(F.col("_a")[0]).alias("x0"), r6(F.col("_a")[2]).alias("x2"), r6(F.col("_a")[5]).alias("x5"),
                    F.col("_a")[7].alias("x7"), F.size("_a").alias("width"))


@query("n6_positional_features", check_sql("select boring_key, " + ", ".join(
    f"round({fn}(radians({c}) * {f}e0), 6) as {fn}_{n}_{i}" for i, f in enumerate((1.0, 8.0, 64.0))
    for n, c in (("lat", "latitude_deg"), ("lon", "longitude_deg")) for fn in ("sin", "cos")) + " from fx_loc", LOC_CTE))
def n6_positional_features(spark, sf):
    cols = numeric.positional(F.col("latitude_deg"), F.col("longitude_deg"), 3, 64.0)
    df = locations(spark, sf).select("boring_key", *cols)
    return rounded(df, *[c for c in df.columns if c != "boring_key"])


CORRECTION_SQL = """
select row_key, round(s, 6) as overburden_kpa, round(least(sqrt(100 / greatest(s, 1e0)), 1.7e0), 6) as c_n,
  case when d < 3 then 0.75e0 when d < 4 then 0.8e0 when d < 6 then 0.85e0 when d < 10 then 0.95e0 else 1e0 end as c_r
from (select row_key, depth_from_surface as d, 18e0 * least(greatest(groundwater_depth_m, 0e0), greatest(depth_from_surface, 0.1e0))
  + (18e0 - 9.81e0) * (greatest(depth_from_surface, 0.1e0) - least(greatest(groundwater_depth_m, 0e0), greatest(depth_from_surface, 0.1e0))) as s
  from fx_raw where groundwater_depth_m is not null)"""


@query("n7_n8_n9_corrections", check_sql(CORRECTION_SQL))
def n7_n8_n9_corrections(spark, sf):
    m = inputs.measurements(spark, sf).where("groundwater_depth_m is not null")
    s = numeric.effective_overburden(F.col("depth_from_surface"), F.col("groundwater_depth_m"))
    return m.select("row_key", r6(s).alias("overburden_kpa"), r6(numeric.overburden_factor(s)).alias("c_n"),
                    numeric.rod_factor(F.col("depth_from_surface")).alias("c_r"))


def _horner_sql(x, coefs):
    out = f"{coefs[0]!r}e0" if "e" not in repr(coefs[0]) else repr(coefs[0])
    for c in coefs[1:]:
        lit = repr(c) if "e" in repr(c) else f"{c!r}e0"
        out = f"({out} * ({x}) + {lit})"
    return out


def cdf_sql(z: str) -> str:
    """Normal CDF as check SQL."""
    x = f"abs({z})"
    body = f"exp(-({x}) * ({x}) / 2) * {_horner_sql(x, numeric._CDF_NUM)} / {_horner_sql(x, numeric._CDF_DEN)}"
    far = f"exp(-({x}) * ({x}) / 2) / ({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65e0))))) / 2.506628274631e0"
    tail = f"(case when {x} < 7.07106781186547e0 then {body} else {far} end)"
    return f"(case when {z} > 0 then 1 - {tail} else {tail} end)"


def quantile_sql(p: str) -> str:
    """Normal quantile as check SQL."""
    mid = f"({p} - 0.5e0)"
    r = f"({mid} * {mid})"
    ql, qh = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (f"(case when {p} < 0.02425e0 then {_horner_sql(ql, numeric._ACK_C)} / {_horner_sql(ql, numeric._ACK_D)} "
            f"when {p} > 0.97575e0 then -{_horner_sql(qh, numeric._ACK_C)} / {_horner_sql(qh, numeric._ACK_D)} "
            f"else {_horner_sql(r, numeric._ACK_A)} * {mid} / {_horner_sql(r, numeric._ACK_B)} end)")


@query("n10_exceedance", check_sql(f"""
select row_key, round({cdf_sql('z5')}, 6) as p_below_5, round({cdf_sql('z30')}, 6) as p_above_30
from (select row_key, (5 - y_pred) / greatest(y_std, 1e-3) as z5, -((30 - y_pred) / greatest(y_std, 1e-3)) as z30 from fx_pred)"""))
def n10_exceedance(spark, sf):
    p = inputs.predictions(spark, sf)
    return p.select("row_key", r6(numeric.exceedance(F.col("y_pred"), F.col("y_std"), F.lit(5.0))).alias("p_below_5"),
                    r6(numeric.exceedance(F.col("y_pred"), F.col("y_std"), F.lit(30.0), "above")).alias("p_above_30"))


@query("n11_normal_quantile", check_sql(f"""
select row_key, round({quantile_sql('p')}, 6) as z, round(y_pred + 1.959963984540054e0 * y_std, 6) as upper_95
from (select row_key, y_pred, y_std, (cast(row_key % 9973 as double) + 0.5e0) / 9973 as p from fx_pred)"""))
def n11_normal_quantile(spark, sf):
    p = inputs.predictions(spark, sf).withColumn("_p", ((F.col("row_key") % 9973).cast("double") + 0.5) / 9973)
    upper = F.col("y_pred") + F.lit(numeric.normal_quantile(0.975)) * F.col("y_std")
    return p.select("row_key", r6(numeric.normal_quantile_col(F.col("_p"))).alias("z"), r6(upper).alias("upper_95"))


@query("n12_slope_aspect", check_sql("""
select row, col, round(slope, 6) as slope_deg, round(case when slope < 0.5e0 then -1e0 else ((90 - turn) % 360 + 360) % 360 end, 6) as aspect_deg
from (select row, col, degrees(atan(sqrt(zx * zx + zy * zy))) as slope, degrees(atan2(-zy, zx)) as turn from (
  select c.row, c.col, coalesce((e.value - w.value) / 1800e0, 0e0) as zx, coalesce((n.value - s.value) / 2200e0, 0e0) as zy
  from m c left join m e on e.row = c.row and e.col = c.col + 1 left join m w on w.row = c.row and w.col = c.col - 1
  left join m n on n.col = c.col and n.row = c.row + 1 left join m s on s.col = c.col and s.row = c.row - 1))""",
                                     RASTER_CTE, "m as (select row, col, min_by(value, tile_seq) as value from fx_tiles group by row, col)"))
def n12_slope_aspect(spark, sf):
    out = layers.slope_aspect(layers.mosaic(raster_tiles(spark, sf)), dx=900.0, dy=1100.0).drop("value")
    return rounded(out, "slope_deg", "aspect_deg")


@query("n13_depth_bins", check_sql("select depth_bin, count(*) as n_rows, min(depth_from_surface) as d_min, max(depth_from_surface) as d_max from fx_pred group by depth_bin"))
def n13_depth_bins(spark, sf):
    m = inputs.measurements(spark, sf)
    return m.groupBy(numeric.depth_bin(F.col("depth_from_surface")).alias("depth_bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("depth_from_surface").alias("d_min"), F.max("depth_from_surface").alias("d_max"))


@query("n14_quintile_label", check_sql("""
select row_key, cast(list_sum(list_transform(e, lambda x: case when x <= y_pred then 1 else 0 end)) as int) as quintile
from fx_pred, (select quantile_cont(y_pred, [0.2e0, 0.4e0, 0.6e0, 0.8e0]) as e from fx_pred)"""))
def n14_quintile_label(spark, sf):
    p = inputs.predictions(spark, sf).select("row_key", "y_pred")
    q = quantiles(p, [], "y_pred", {f"q{i}": i / 5 for i in range(1, 5)}).select(F.array("q1", "q2", "q3", "q4"))
    return p.withColumn("_e", q.scalar()).select("row_key", F.size(F.filter("_e", lambda e: e <= F.col("y_pred"))).alias("quintile"))


def qcut_edges(df, value: str, parts: int):
    """Inner quantile edges with duplicates dropped, as one array."""
    names = [f"q{i}" for i in range(parts + 1)]
    q = quantiles(df, [], value, {n: i / parts for i, n in enumerate(names)})
    edges = F.array_distinct(F.array(*names))
    return q.select(F.when(F.size(edges) > 2, F.slice(edges, F.lit(2), F.size(edges) - 2)).otherwise(F.array().cast("array<double>")))


@query("n15_quantile_bucket", check_sql("""
select row_key, cast(coalesce(list_sum(list_transform(e[2:len(e) - 1], lambda x: case when x <= n_value then 1 else 0 end)), 0) as int) as bucket
from fx_raw, (select list_sort(list_distinct(quantile_cont(n_value, [0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0, 1e0]))) as e from fx_raw)"""))
def n15_quantile_bucket(spark, sf):
    m = inputs.measurements(spark, sf).select("row_key", "n_value")
    return m.withColumn("_e", qcut_edges(m, "n_value", 10).scalar()).select(
        "row_key", F.size(F.filter("_e", lambda e: e <= F.col("n_value"))).alias("bucket"))


@query("n16_min_count_groups", check_sql("""
select litho_macro_code, regime_code, count(*) as n, count(*) >= 100 as reliable from fx_raw group by litho_macro_code, regime_code"""))
def n16_min_count_groups(spark, sf):
    g = inputs.measurements(spark, sf).groupBy("litho_macro_code", "regime_code").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("reliable", F.col("n") >= 100)

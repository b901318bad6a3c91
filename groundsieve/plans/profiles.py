"""Queries: borehole profiles and endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsieve.operators import profiles as pr
from groundsieve.plans import inputs
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.registry import query, rounded

LOC = "latitude_deg, longitude_deg"
SOFT_CTE = f"""
fx_soft as (select {LOC}, sum(case when ok and next_ok then next_d - d else 0e0 end) as soft from (
  select {LOC}, depth_from_surface as d, (depth_from_surface between 0 and 10 and n_value < 5) as ok,
    lead(depth_from_surface) over w as next_d, lead(depth_from_surface between 0 and 10 and n_value < 5) over w as next_ok
  from fx_raw window w as (partition by {LOC} order by depth_from_surface, n_value)) group by {LOC})"""
ENDPOINTS_CTE = SOFT_CTE + f""",
fx_ends as (select e.*, s.soft as soft_thickness_lt5_0_to_10m from (
  select {LOC}, min(case when n_value >= 30 then depth_from_surface end) as depth_to_first_n30,
    avg(case when depth_from_surface between 0 and 10 then n_value end) as mean_n_upper_10m,
    min(case when depth_from_surface between 0 and 10 then n_value end) as min_n_upper_10m,
    count(*) as n_rows_in_boring, max(depth_from_surface) as max_depth_observed, any_value(regime_code) as regime_code,
    any_value(river_distance_km) as river_distance_km, any_value(coast_distance_km) as coast_distance_km,
    max(absolute_elevation) as absolute_elevation
  from fx_raw group by {LOC}) e join fx_soft s using ({LOC}))"""


@query("a1_profile_order", check_sql(f"""
select row_key, row_number() over (partition by {LOC} order by depth_from_surface, row_key) as seq,
  count(*) over (partition by {LOC}) as n_in_profile from fx_raw"""))
def a1_profile_order(spark, sf):
    m = inputs.measurements(spark, sf).select("row_key", "latitude_deg", "longitude_deg", "depth_from_surface")
    return pr.profile_order(m).select("row_key", "seq", "n_in_profile")


@query("a2_first_crossing", check_sql(f"""
select {LOC}, min(case when n_value >= 30 then depth_from_surface end) as first_stiff,
  min(case when n_value < 5 then depth_from_surface end) as first_soft from fx_raw group by {LOC}"""))
def a2_first_crossing(spark, sf):
    return pr.aggregate_profile(inputs.measurements(spark, sf), {
        "first_stiff": pr.first_crossing(30.0), "first_soft": pr.first_crossing(5.0, "below")})


@query("a3_soft_thickness", check_sql(f"select {LOC}, round(soft, 6) as soft from fx_soft where soft > 0", SOFT_CTE))
def a3_soft_thickness(spark, sf):
    s = pr.soft_thickness(inputs.measurements(spark, sf)).withColumnRenamed("soft_thickness_lt5_0_to_10m", "soft")
    return rounded(s, "soft").where("soft > 0")


@query("a4_depth_range_aggregate", check_sql(f"""
select {LOC}, round(avg(case when depth_from_surface between 5 and 15 then n_value end), 6) as mean_5_15,
  max(case when depth_from_surface between 5 and 15 then n_value end) as max_5_15,
  count(case when depth_from_surface between 5 and 15 then n_value end) as n_5_15 from fx_raw group by {LOC}"""))
def a4_depth_range_aggregate(spark, sf):
    v = pr.in_depth_range(F.col("n_value"), 5.0, 15.0)
    out = pr.aggregate_profile(inputs.measurements(spark, sf), {"mean_5_15": F.avg(v), "max_5_15": F.max(v), "n_5_15": F.count(v)})
    return rounded(out, "mean_5_15")


@query("a5_a6_endpoints", check_sql(f"""
select {LOC}, depth_to_first_n30, case when depth_to_first_n30 <= 30 then 1 else 0 end as has_n30_within_30m,
  round(soft_thickness_lt5_0_to_10m, 6) as soft_thickness_lt5_0_to_10m, round(mean_n_upper_10m, 6) as mean_n_upper_10m, min_n_upper_10m,
  n_rows_in_boring, max_depth_observed, regime_code, river_distance_km, coast_distance_km, round(absolute_elevation, 6) as absolute_elevation
from fx_ends""", ENDPOINTS_CTE))
def a5_a6_endpoints(spark, sf):
    return rounded(pr.endpoints(inputs.measurements(spark, sf)), "soft_thickness_lt5_0_to_10m", "mean_n_upper_10m", "absolute_elevation")


@query("a7_location_summary", check_sql(f"""
select {LOC}, round(river, 6) as river_distance_km, round(coast, 6) as coast_distance_km, round(elev, 9) as absolute_elevation,
  litho_macro_code from (
  select {LOC}, avg(river_distance_km) as river, avg(coast_distance_km) as coast, avg(absolute_elevation) as elev from fx_raw group by {LOC})
join (select {LOC}, code as litho_macro_code from (select {LOC}, cast((row_key // 100) % 5 as int) as code, row_number() over (
    partition by {LOC} order by count(*) desc, cast((row_key // 100) % 5 as int)) as rn from fx_raw group by {LOC}, cast((row_key // 100) % 5 as int)) where rn = 1) using ({LOC})"""))
def a7_location_summary(spark, sf):
    m = inputs.measurements(spark, sf).withColumn("litho_macro_code", (F.floor(F.col("row_key") / 100) % 5).cast("int"))
    cols = ["river_distance_km", "coast_distance_km", "absolute_elevation"]
    out = rounded(pr.location_summary(m, cols, "litho_macro_code"), *cols[:2])
    return out.withColumn("absolute_elevation", F.round("absolute_elevation", 9))


@query("a8_target_histogram", check_sql("select least(cast(floor(n_value / 2) as int), 49) as bin, count(*) as n_rows from fx_raw group by 1"))
def a8_target_histogram(spark, sf):
    return pr.histogram(inputs.measurements(spark, sf))


@query("a8_depth_quartiles", check_sql("""
select depth_bin, count(*) as n, round(quantile_cont(n_value, 0.25e0), 6) as q25, round(quantile_cont(n_value, 0.5e0), 6) as q50,
  round(quantile_cont(n_value, 0.75e0), 6) as q75 from fx_pred group by depth_bin"""))
def a8_depth_quartiles(spark, sf):
    return rounded(pr.depth_quartiles(inputs.measurements(spark, sf)), "q25", "q50", "q75")


@query("a8_spikes", check_sql("""
select count(*) filter (n_value = 0) as n_at_0, count(*) filter (n_value = 50) as n_at_50, count(*) filter (n_value = 100) as n_at_100 from fx_raw"""))
def a8_spikes(spark, sf):
    return pr.spikes(inputs.measurements(spark, sf))


@query("a10_regime_distribution", check_sql("select regime_code, count(*) as n_rows from fx_raw group by regime_code"))
def a10_regime_distribution(spark, sf):
    return inputs.measurements(spark, sf).groupBy("regime_code").agg(F.count(F.lit(1)).alias("n_rows"))


SURVIVAL_CTE = """
fx_surv as (select *, greatest(coalesce(depth_to_first_n30, max_depth_observed), 0.1e0) as surv_time,
  cast(depth_to_first_n30 is not null as int) as surv_event from fx_ends)"""


@query("m11_survival_table", check_sql(f"select {LOC}, surv_time, surv_event from fx_surv", ENDPOINTS_CTE, SURVIVAL_CTE))
def m11_survival_table(spark, sf):
    return pr.survival_table(pr.endpoints(inputs.measurements(spark, sf))).select("latitude_deg", "longitude_deg", "surv_time", "surv_event")

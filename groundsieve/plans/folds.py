"""Queries: folds, buffers, splits and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsieve.functions.mesh import with_bounds
from groundsieve.operators import folds, regions
from groundsieve.plans import inputs
from groundsieve.plans.flagship import FOLDS_CTE, cell_folds
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.keys import BOXES_CTE, LOC_CTE, PREF_LOOKUP_CTE, PREFS_CTE, prefecture_lookup
from groundsieve.plans.profiles import ENDPOINTS_CTE
from groundsieve.plans.registry import query, r6, rounded
from groundsieve.operators.profiles import endpoints


@query("k1_balanced_folds", check_sql("select mesh_row, mesh_col, n_rows, fold from cell_folds", FOLDS_CTE, recursive=True))
def k1_balanced_folds(spark, sf):
    return cell_folds(spark, sf).select("mesh_row", "mesh_col", "n_rows", "fold")


CELLS_CTE = FOLDS_CTE[:FOLDS_CTE.index("packed as (")].rstrip().rstrip(",")


def _restart_cte(y: str, x: str, steps: int = 40, starts: int = 10) -> str:
    """Ten k-means++ starts and ``steps`` Lloyd steps of each, unrolled; more steps change nothing once no centre moves."""
    u = lambda j: f"(cast('0x' || substr(md5(concat_ws(':', '42', s, '{j}', mesh_code)), 1, 12) as bigint) + 0.5e0) / 281474976710656e0"
    near = lambda frame, centres: (f"select p.s, p.mesh_row, p.mesh_col, p.mesh_code, p.n_rows, p.y, p.x, min(d) as d2, cast(arg_min(fold, d + fold * 1e-12) as int) as fold from ("  # noqa: E731
                                   f"select p.*, c.fold, round((p.y - c.y) * (p.y - c.y) + (p.x - c.x) * (p.x - c.x), 9) as d from {frame} p join {centres} c using (s)) p group by all")
    parts = [f"k2_pts as materialized (select {y} as y, {x} as x, mesh_row, mesh_col, mesh_code, n_rows, s from k2_cells cross join range({starts}) r(s))",
             f"k2_c0 as materialized (select s, 0 as fold, arg_min(y, r) as y, arg_min(x, r) as x from (select *, {u(0)} as r from k2_pts) group by s)"]
    for j in (1, 2):
        parts.append(f"k2_c{j} as materialized (select * from k2_c{j - 1} union all select s, {j}, arg_min(y, r), arg_min(x, r) from ("
                     f"select *, -ln({u(j)}) / d2 as r from ({near('k2_pts', f'k2_c{j - 1}')}) where d2 > 0) group by s)")
    last = "k2_c2"
    for i in range(steps):
        parts.append(f"k2_m{i} as materialized (select s, fold, round(avg(y), 12) as y, round(avg(x), 12) as x from ({near('k2_pts', last)}) group by s, fold)")
        last = f"k2_m{i}"
    parts.append(f"k2_end as materialized ({near('k2_pts', last)})")
    parts.append("k2_best as (select * from k2_end where s = (select arg_min(s, t + s * 1e-9) from (select s, round(sum(d2), 6) as t from k2_end group by s)))")
    return ",\n".join(parts)


K2_SQL = "select mesh_row, mesh_col, n_rows, fold from k2_best"


@query("k2_contiguous_folds", check_sql(K2_SQL, CELLS_CTE, "k2_cells as (select *, 0.5e0 * (mesh_row / 12e0 + (mesh_row + 1) / 12e0) as lat_mid, 0.5e0 * (mesh_col / 8e0 + 100 + (mesh_col + 1) / 8e0 + 100) as lon_mid from cells)",
                                        _restart_cte("lat_mid", "lon_mid")))
def k2_contiguous_folds(spark, sf):
    """Cell midpoints, ten starts, until no centre moves."""
    cells = with_bounds(folds.cell_counts(inputs.measurements(spark, sf)))
    return folds.restarted_folds(cells, 3).select("mesh_row", "mesh_col", "n_rows", "fold")


@query("k2_data_mean_folds", check_sql(K2_SQL, CELLS_CTE, """
k2_cells as (select cells.*, lat, lon from cells join (select mesh_row, mesh_col, round(avg(latitude_deg), 9) as lat, round(avg(longitude_deg), 9) as lon
  from fx_raw group by mesh_row, mesh_col) using (mesh_row, mesh_col))""", _restart_cte("lat", "lon")))
def k2_data_mean_folds(spark, sf):
    """The same over the mean position of each cell's rows."""
    rows = inputs.measurements(spark, sf)
    means = rows.groupBy(*folds.CELL).agg(F.round(F.avg("latitude_deg"), 9).alias("lat"), F.round(F.avg("longitude_deg"), 9).alias("lon"))
    cells = folds.cell_counts(rows).join(means, folds.CELL)
    return folds.restarted_folds(cells, 3, y="lat", x="lon").select("mesh_row", "mesh_col", "n_rows", "fold")


USABLE_CTE = """
near as (select distinct fold, mesh_row + dr as mesh_row, mesh_col + dc as mesh_col from cell_folds
  cross join (select unnest([-1, 0, 1]) as dr) cross join (select unnest([-1, 0, 1]) as dc)),
usable as (select mesh_row, mesh_col, n_rows, fold from pairs p
  where not exists (select 1 from near n where n.fold = p.fold and n.mesh_row = p.mesh_row and n.mesh_col = p.mesh_col))"""


@query("k3_buffered_train", check_sql("""
select fold, count(*) as n_train, round(sum(n_value), 6) as n_sum from fx_raw join usable using (mesh_row, mesh_col) group by fold""",
                                      FOLDS_CTE, USABLE_CTE, recursive=True))
def k3_buffered_train(spark, sf):
    train = folds.buffered_train(inputs.measurements(spark, sf), cell_folds(spark, sf), 3, 1)
    return train.groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"), r6(F.sum("n_value")).alias("n_sum"))


@query("k4_train_shrinkage", check_sql("""
select fold, cast(n_base as bigint) as n_base, cast(n_train as bigint) as n_train, round(100e0 * (1 - cast(n_train as double) / n_base), 1) as shrinkage_pct from (
  select b.fold, b.n_base, coalesce(u.n_train, 0) as n_train from (select fold, sum(n_rows) as n_base from pairs where own <> fold group by fold) b
  left join (select fold, sum(n_rows) as n_train from usable group by fold) u using (fold))""", FOLDS_CTE, USABLE_CTE, recursive=True))
def k4_train_shrinkage(spark, sf):
    return folds.train_shrinkage(cell_folds(spark, sf), 3, 1)


@query("j9_buffer_exclusion", check_sql("select fold, mesh_row, mesh_col from usable", FOLDS_CTE, USABLE_CTE, recursive=True))
def j9_buffer_exclusion(spark, sf):
    return folds.usable_folds(cell_folds(spark, sf), 3, 1).select(F.explode("usable").alias("fold"), "mesh_row", "mesh_col")


@query("j10_train_test_split", check_sql("""
select fold, role, count(*) as n_rows from (select p.fold, case when p.own = p.fold then 'test' else 'train' end as role
  from fx_raw join pairs p using (mesh_row, mesh_col)) group by fold, role""", FOLDS_CTE, recursive=True))
def j10_train_test_split(spark, sf):
    rows = folds.with_fold(inputs.measurements(spark, sf), cell_folds(spark, sf))
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    split = rows.select(F.col("fold").alias("_own"), k.alias("fold"))
    role = F.when(F.col("_own") == F.col("fold"), "test").otherwise("train")
    return split.groupBy("fold", role.alias("role")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("k5_leave_region_out", check_sql("""
select k.name as fold, case when latitude_deg between la0 and la1 and longitude_deg between lo0 and lo1 then 'test' else 'train' end as role, count(*) as n_rows
from fx_raw cross join boxes k where exists (select 1 from fx_raw where latitude_deg between la0 and la1 and longitude_deg between lo0 and lo1) group by 1, 2""", BOXES_CTE))
def k5_leave_region_out(spark, sf):
    return regions.region_folds(inputs.measurements(spark, sf)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"))


@query("k6_leave_prefecture_out", check_sql("""
select k.pref as fold, case when l.pref = k.pref then 'test' else 'train' end as role, count(*) as n_rows
from fx_raw left join fx_prefs l using (latitude_deg, longitude_deg) cross join (select distinct pref from fx_prefs) k group by 1, 2""",
                                            LOC_CTE, PREFS_CTE, PREF_LOOKUP_CTE))
def k6_leave_prefecture_out(spark, sf):
    df = regions.with_prefecture(inputs.measurements(spark, sf), prefecture_lookup(spark, sf))
    return regions.prefecture_folds(df).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"))


# A block table of the caller: geology macro blocks of the study area.
BLOCKS = {"west": (35.0, 37.5, 138.5, 139.3), "plain": (35.0, 36.5, 139.3, 141.0), "north": (36.5, 37.5, 139.3, 141.0)}


@query("k7_leave_block_out", check_sql("""
select k.name as fold, case when latitude_deg between la0 and la1 and longitude_deg between lo0 and lo1 then 'test' else 'train' end as role, count(*) as n_rows
from fx_raw cross join (values ('west', 35e0, 37.5e0, 138.5e0, 139.3e0), ('plain', 35e0, 36.5e0, 139.3e0, 141e0), ('north', 36.5e0, 37.5e0, 139.3e0, 141e0)) k(name, la0, la1, lo0, lo1)
group by 1, 2"""))
def k7_leave_block_out(spark, sf):
    return regions.region_folds(inputs.measurements(spark, sf), BLOCKS).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"))


@query("k8_calibration_by_rows", check_sql("select mesh_row, mesh_col, fold, role from roles", FOLDS_CTE, recursive=True))
def k8_calibration_by_rows(spark, sf):
    return folds.fold_roles(cell_folds(spark, sf), 3, 0.2, 142)


@query("k9_calibration_by_cells", check_sql("""
select mesh_row, mesh_col, case when rn <= greatest(1, floor(n * 0.2e0)) then 'cal' else 'train' end as part from (
  select *, row_number() over (order by md5('5:' || cast(mesh_code as varchar)), mesh_code) as rn, count(*) over () as n from cells)""", CELLS_CTE))
def k9_calibration_by_cells(spark, sf):
    cells = folds.cell_counts(inputs.measurements(spark, sf))
    return folds.split_cells_by_share(cells, {"cal": 0.2}, seed=5).select("mesh_row", "mesh_col", "part")


@query("k10_three_way_split", check_sql("""
select mesh_row, mesh_col, case when rn <= greatest(1, floor(n * 0.15e0)) then 'iso'
  when rn <= 2 * greatest(1, floor(n * 0.15e0)) then 'conf' else 'train' end as part from (
  select *, row_number() over (order by md5('1042:' || cast(mesh_code as varchar)), mesh_code) as rn, count(*) over () as n from cells)""", CELLS_CTE))
def k10_three_way_split(spark, sf):
    cells = folds.cell_counts(inputs.measurements(spark, sf))
    return folds.split_cells_by_share(cells, {"iso": 0.15, "conf": 0.15}, seed=1042).select("mesh_row", "mesh_col", "part")


@query("k12_borehole_folds", check_sql("""
select fold, count(*) as n_boreholes, count(depth_to_first_n30) as n_events from (
  select e.*, cast(floor(latitude_deg * 12e0) as bigint) as mesh_row, cast(floor((longitude_deg - 100e0) * 8e0) as bigint) as mesh_col from fx_ends e)
join cell_folds using (mesh_row, mesh_col) group by fold""", FOLDS_CTE, ENDPOINTS_CTE, recursive=True))
def k12_borehole_folds(spark, sf):
    from groundsieve.functions.mesh import with_mesh

    ep = with_mesh(endpoints(inputs.measurements(spark, sf)))
    return folds.with_fold(ep, cell_folds(spark, sf)).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_boreholes"), F.count("depth_to_first_n30").alias("n_events"))


@query("k13_fold_report", check_sql("select fold, count(*) as n_rows, count(distinct (latitude_deg, longitude_deg)) as n_boreholes, "
    "count(distinct (mesh_row, mesh_col)) as n_cells, round(quantile_cont(depth_from_surface, 0.5e0), 6) as depth_median, "
    "round(quantile_cont(depth_from_surface, 0.95e0), 6) as depth_p95, round(avg(n_value), 6) as n_mean, round(stddev_samp(n_value), 6) as n_std, "
    "round(quantile_cont(n_value, 0.95e0), 6) as n_p95, "
    + ", ".join(f"round(avg(case when regime_code = {i} then 1e0 else 0e0 end), 6) as regime_{i}_share" for i in range(8))
    + " from fx_pred group by fold"))
def k13_fold_report(spark, sf):
    out = folds.fold_report(inputs.predictions(spark, sf))
    return rounded(out, "depth_median", "depth_p95", "n_mean", "n_std", "n_p95", *[f"regime_{i}_share" for i in range(8)])


@query("k14_fold_consistency", check_sql("""
select fold, count(*) as n_rows, true as consistent from fx_pred group by fold"""))
def k14_fold_consistency(spark, sf):
    """Predicted rows per fold against the fold table's own counts."""
    p = inputs.predictions(spark, sf)
    cells = p.groupBy("mesh_row", "mesh_col").agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("fold"), F.max("fold").alias("_m"))
    table = cells.groupBy("fold").agg(F.sum("n").alias("n_table"), F.max((F.col("_m") != F.col("fold")).cast("int")).alias("_mixed"))
    rows = p.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(table, "fold").select("fold", "n_rows", ((F.col("n_rows") == F.col("n_table")) & (F.col("_mixed") == 0)).alias("consistent"))

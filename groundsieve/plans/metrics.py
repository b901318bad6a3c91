"""Queries: prediction errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsieve.functions.mesh import pack
from groundsieve.operators import errors
from groundsieve.plans import inputs
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.keys import cdf_sql, quantile_sql
from groundsieve.plans.registry import query, rounded

SE = "(y_true - y_pred) * (y_true - y_pred)"


@query("e1_fold_errors", check_sql(f"""
select fold, count(*) as n, round(sqrt(avg({SE})), 6) as rmse, round(avg(abs(y_true - y_pred)), 6) as mae, round(avg(y_std), 6) as std_mean from fx_pred group by fold"""))
def e1_fold_errors(spark, sf):
    return rounded(errors.fold_errors(inputs.predictions(spark, sf)), "rmse", "mae", "std_mean")


@query("e2_regime_metrics", check_sql(f"""
select regime_code, count(*) as n, round(sqrt(avg({SE})), 6) as rmse, round(avg(abs(y_true - y_pred)), 6) as mae,
  round(1 - avg({SE}) / ((select var_pop(y_true) from fx_pred) + 1e-12), 6) as r2,
  round(avg(-0.5e0 * ln(2 * pi()) - ln(y_std) - 0.5e0 * {SE} / (y_std * y_std)), 6) as mean_ll,
  round(var_pop((y_true - y_pred) / y_std), 6) as z_var from fx_pred group by regime_code"""))
def e2_regime_metrics(spark, sf):
    return rounded(errors.regime_metrics(inputs.predictions(spark, sf)), "rmse", "mae", "r2", "mean_ll", "z_var")


@query("e3_stratified_errors", check_sql(" union all ".join(f"""
select '{s}' as stratum, {s} as code, count(*) as n, round(sqrt(avg({SE})), 6) as rmse, round(avg(abs(y_true - y_pred)), 6) as mae,
  round(avg(y_true - y_pred), 6) as bias from fx_pred group by {s}""" for s in ("depth_bin", "regime_code"))))
def e3_stratified_errors(spark, sf):
    return rounded(errors.stratified_errors(inputs.predictions(spark, sf), ["depth_bin", "regime_code"]), "rmse", "mae", "bias")


@query("e4_lithology_errors", check_sql(f"""
select litho_macro_code, count(*) as n, round(sqrt(avg({SE})), 6) as rmse, round(avg(abs(y_true - y_pred)), 6) as mae,
  round(avg(y_true - y_pred), 6) as bias from fx_pred group by litho_macro_code having count(*) >= 50 order by rmse"""))
def e4_lithology_errors(spark, sf):
    return rounded(errors.grouped_errors(inputs.predictions(spark, sf), "litho_macro_code"), "rmse", "mae", "bias")


STIFF_SQL = f"""
select fold, count(*) as n, count(*) filter (y_true >= 30) as n_subset, sqrt(avg({SE})) as rmse,
  sqrt(avg({SE}) filter (y_true >= 30)) as rmse_subset, avg(abs(y_true - y_pred)) filter (y_true >= 30) as mae_subset,
  avg(case when abs(y_true - y_pred) <= 2 * y_std then 1e0 else 0e0 end) as coverage from fx_pred group by fold"""


@query("e5_subset_errors", check_sql(
    "select fold, n, n_subset, round(rmse, 6) as rmse, round(rmse_subset, 6) as rmse_subset, round(mae_subset, 6) as mae_subset from f",
    f"f as ({STIFF_SQL})"))
def e5_subset_errors(spark, sf):
    return rounded(errors.subset_errors(inputs.predictions(spark, sf), F.col("y_true") >= 30), "rmse", "rmse_subset", "mae_subset")


def _fold_table(spark, sf):
    p = inputs.predictions(spark, sf)
    cover = F.avg(F.when(F.abs(errors.residual()) <= 2 * F.col("y_std"), 1.0).otherwise(0.0)).alias("coverage")
    return p.groupBy("fold").agg(errors.rmse(errors.residual()).alias("rmse"),
                                 errors.rmse(F.when(F.col("y_true") >= 30, errors.residual())).alias("rmse_subset"), cover)


AGG_SQL = "select count(*) as n_folds, " + ", ".join(
    f"{fn}({m}) as {m}_{n}" for m in ("rmse", "rmse_subset", "coverage")
    for n, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " from f"
AGG_COLS = [f"{m}_{n}" for m in ("rmse", "rmse_subset", "coverage") for n in ("mean", "std", "min", "max")]


@query("e6_fold_aggregate", check_sql("select n_folds, " + ", ".join(f"round({c}, 6) as {c}" for c in AGG_COLS) + " from g",
                                      f"f as ({STIFF_SQL})", f"g as ({AGG_SQL})"))
def e6_fold_aggregate(spark, sf):
    return rounded(errors.over_folds(_fold_table(spark, sf), ["rmse", "rmse_subset", "coverage"]), *AGG_COLS)


@query("e7_gate_verdict", check_sql("""
select round(rmse_mean, 6) as rmse_mean, round(coverage_mean, 6) as coverage_mean, rmse_mean <= 10e0 * 1.05e0 as rmse_ok,
  abs(coverage_mean - 0.95e0) <= 0.03e0 as coverage_ok, rmse_mean <= 10e0 * 1.05e0 and abs(coverage_mean - 0.95e0) <= 0.03e0 as passed from g""",
                                    f"f as ({STIFF_SQL})", f"g as ({AGG_SQL})"))
def e7_gate_verdict(spark, sf):
    s = errors.over_folds(_fold_table(spark, sf), ["rmse", "coverage"])
    out = errors.gate(s, rmse_ref=10.0, rmse_tol=0.05, coverage_tol=0.03)
    return rounded(out.select("rmse_mean", "coverage_mean", "rmse_ok", "coverage_ok", "passed"), "rmse_mean", "coverage_mean")


@query("e8_normalised_rmse", check_sql(f"""
select fold, round(sqrt(avg({SE})), 6) as rmse, round(stddev_pop(y_true), 6) as target_sd, round(sqrt(avg({SE})) / stddev_pop(y_true), 6) as nrmse
from fx_pred group by fold"""))
def e8_normalised_rmse(spark, sf):
    return rounded(errors.normalised_rmse(inputs.predictions(spark, sf), ["fold"]), "rmse", "target_sd", "nrmse")


@query("e9_subset_r2", check_sql(f"""
select regime_code, depth_bin, count(*) as n, round(case when var_pop(y_true) > 0 then 1 - avg({SE}) / var_pop(y_true) end, 5) as r2
from fx_pred where n_value >= 3 group by regime_code, depth_bin"""))
def e9_subset_r2(spark, sf):
    out = errors.subset_r2(inputs.predictions(spark, sf).where("n_value >= 3"), ["regime_code", "depth_bin"])
    return out.withColumn("r2", F.round("r2", 5))


@query("j14_paired_models", check_sql("""
select regime_code, count(*) as n, round(avg(abs(y_true - a)), 6) as mae_a, round(avg(abs(y_true - b)), 6) as mae_b,
  round(avg(case when abs(y_true - a) < abs(y_true - b) then 1e0 else 0e0 end), 6) as a_wins
from (select row_key, regime_code, y_true, y_pred as a from fx_pred) join (select row_key, 0.9e0 * y_pred + 1 as b from fx_pred) using (row_key) group by regime_code"""))
def j14_paired_models(spark, sf):
    p = inputs.predictions(spark, sf)
    a = p.select("row_key", "regime_code", "y_true", F.col("y_pred").alias("a"))
    b = p.select("row_key", (0.9 * F.col("y_pred") + 1).alias("b"))
    ea, eb = F.abs(F.col("y_true") - F.col("a")), F.abs(F.col("y_true") - F.col("b"))
    out = a.join(b, "row_key").groupBy("regime_code").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ea).alias("mae_a"), F.avg(eb).alias("mae_b"), F.avg(F.when(ea < eb, 1.0).otherwise(0.0)).alias("a_wins"))
    return rounded(out, "mae_a", "mae_b", "a_wins")


@query("e11_paired_bca", check_sql(f"""
select round(theta, 6) as difference, round(z0, 6) as bias_correction, round(acc, 6) as acceleration,
  round(ts[cast(floor(p_lo * 499) as int) + 1] + (ts[cast(ceil(p_lo * 499) as int) + 1] - ts[cast(floor(p_lo * 499) as int) + 1]) * (p_lo * 499 - floor(p_lo * 499)), 6) as ci_lo,
  round(ts[cast(floor(p_hi * 499) as int) + 1] + (ts[cast(ceil(p_hi * 499) as int) + 1] - ts[cast(floor(p_hi * 499) as int) + 1]) * (p_hi * 499 - floor(p_hi * 499)), 6) as ci_hi
from (select *, {cdf_sql('w_lo')} as p_lo, {cdf_sql('w_hi')} as p_hi from (
  select *, z0 + (z0 - 1.959963984540054e0) / (1 - acc * (z0 - 1.959963984540054e0)) as w_lo,
    z0 + (z0 + 1.959963984540054e0) / (1 - acc * (z0 + 1.959963984540054e0)) as w_hi from (
  select *, {quantile_sql('share')} as z0 from (
    select theta, acc, ts, least(greatest(cast(len(list_filter(ts, lambda x: x < theta)) as double) / 500, 1e-6), 1 - 1e-6) as share
    from theta_row, acc_row, boot_row))))""", f"""
cells as (select mesh_code, row_number() over (order by mesh_code) - 1 as i, n, a, b from (
  select ((mesh_row // 8) * 100 + (mesh_col // 8)) * 100 + (mesh_row % 8) * 10 + (mesh_col % 8) as mesh_code, count(*) as n,
    sum(pow(y_true - y_pred, 2)) as a, sum(pow(y_true - (0.9e0 * y_pred + 1), 2)) as b from fx_pred group by 1)),
tot as (select count(*) as c, sum(n) as n, sum(a) as a, sum(b) as b from cells),
theta_row as (select sqrt(a / n) - sqrt(b / n) as theta from tot),
picks as (select draw, cast('0x' || substr(md5('11:' || cast(draw as varchar) || ':' || cast(j as varchar)), 1, 12) as bigint) % c as i
  from tot, (select unnest(range(1, 501)) as draw) d, (select unnest(range(1, (select c + 1 from tot))) as j) jj),
boot_row as (select list_sort(list(t)) as ts from (
  select draw, sqrt(sum(a) / sum(n)) - sqrt(sum(b) / sum(n)) as t from picks join cells using (i) group by draw)),
jack as (select sqrt((t.a - c.a) / (t.n - c.n)) - sqrt((t.b - c.b) / (t.n - c.n)) as t from cells c, tot t),
acc_row as (select sum(pow(m - t, 3)) / (6 * pow(sum(pow(m - t, 2)), 1.5e0)) as acc from jack, (select avg(t) as m from jack))"""))
def e11_paired_bca(spark, sf):
    p = inputs.predictions(spark, sf).withColumns({
        "mesh_code": pack(F.col("mesh_row"), F.col("mesh_col")), "pred_b": 0.9 * F.col("y_pred") + 1})
    out = errors.paired_bca(p, "y_pred", "pred_b", "mesh_code", draws=500, seed=11)
    return rounded(out, "difference", "bias_correction", "acceleration", "ci_lo", "ci_hi")

"""Queries: survival models of the depth to the first stiff reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsieve.operators import learn, pairs, profiles as pr, quality, survival as sv, thresholds as th
from groundsieve.plans import inputs
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.learned import borehole_rows
from groundsieve.plans.profiles import ENDPOINTS_CTE, SURVIVAL_CTE
from groundsieve.plans.registry import query, rounded

# A fixed risk score, so that the checks need no fitted model.
RISK_SQL = "exp(round(0.03e0 * river_distance_km - 0.01e0 * coast_distance_km, 2))"
RISK_CTE = f"fx_risk as (select *, {RISK_SQL} as risk from fx_surv)"


def survival_rows(spark, sf):
    s = pr.survival_table(pr.endpoints(inputs.measurements(spark, sf)))
    return s.withColumn("risk", F.exp(F.round(0.03 * F.col("river_distance_km") - 0.01 * F.col("coast_distance_km"), 2)))


@query("j13_m15_concordance", check_sql("""
select regime_code, cast(sum(case when a.risk > b.risk then 1 else 0 end) as bigint) as concordant, cast(sum(case when a.risk = b.risk then 1 else 0 end) as bigint) as tied_risk,
  count(*) as pairs, round((sum(case when a.risk > b.risk then 1e0 when a.risk = b.risk then 0.5e0 else 0e0 end)) / count(*), 6) as c_index
from fx_risk a join fx_risk b using (regime_code) where a.surv_time < b.surv_time and a.surv_event = 1 group by regime_code""", ENDPOINTS_CTE, SURVIVAL_CTE, RISK_CTE))
def j13_m15_concordance(spark, sf):
    out = pairs.concordance(survival_rows(spark, sf), ["regime_code"], "surv_time", "surv_event", "risk")
    return rounded(out.where("pairs > 0"), "c_index")


HAZARD_CTE = """
fx_base as (select surv_time, d, d / s as hazard, sum(d / s) over (order by surv_time) as cumulative from (
  select surv_time, sum(surv_event) as d, sum(sum(risk)) over (order by surv_time desc) as s from fx_risk group by surv_time) where d > 0)"""


@query("m16_baseline_hazard", check_sql("select surv_time, cast(d as bigint) as d, round(hazard, 8) as hazard, round(cumulative, 6) as cumulative from fx_base", ENDPOINTS_CTE, SURVIVAL_CTE, RISK_CTE, HAZARD_CTE))
def m16_baseline_hazard(spark, sf):
    out = sv.baseline_hazard(survival_rows(spark, sf), "risk")
    return rounded(out, "cumulative").withColumn("hazard", F.round("hazard", 8))


@query("m16_survival_at_depths", check_sql("select latitude_deg, longitude_deg, " + ", ".join(
    f"round(exp(-coalesce((select max(cumulative) from fx_base where surv_time <= {t}), 0e0) * risk), 6) as surv_{t}" for t in (10, 20, 30)) + " from fx_risk",
    ENDPOINTS_CTE, SURVIVAL_CTE, RISK_CTE, HAZARD_CTE))
def m16_survival_at_depths(spark, sf):
    rows = survival_rows(spark, sf)
    out = sv.survival_at(rows, sv.baseline_hazard(rows, "risk"), "risk", [10.0, 20.0, 30.0])
    return rounded(out.select("latitude_deg", "longitude_deg", "surv_10", "surv_20", "surv_30"), "surv_10", "surv_20", "surv_30")


@query("m15_within_30m_scores", check_sql("""
, x as (select case when surv_event = 1 and surv_time <= 30 then 1 else 0 end as y,
  round(1 - exp(-coalesce((select max(cumulative) from fx_base where surv_time <= 30), 0e0) * risk), 9) as p from fx_risk),
t as (select p, count(*) as n, sum(y) as pos from x group by p)
select round(avg((p - y) * (p - y)), 6) as brier, (select round(sum(pos * (below + (n - pos) / 2e0)) / any_value(tp * (tn - tp)), 6) from (
  select *, coalesce(sum(n - pos) over (order by p rows between unbounded preceding and 1 preceding), 0) as below, sum(pos) over () as tp, sum(n) over () as tn from t)) as auc from x""",
    ENDPOINTS_CTE, SURVIVAL_CTE, RISK_CTE, HAZARD_CTE).replace("\n\n, x as", ",\nx as"))
def m15_within_30m_scores(spark, sf):
    rows = survival_rows(spark, sf)
    s = sv.survival_at(rows, sv.baseline_hazard(rows, "risk"), "risk", [30.0])
    s = s.select(F.lit(0).alias("g"), F.round(1 - F.col("surv_30"), 9).alias("p"), ((F.col("surv_event") == 1) & (F.col("surv_time") <= 30)).cast("int").alias("y"))
    out = th.brier_and_log_loss(s, ["g"]).join(th.roc_auc(s, ["g"]), "g")
    return rounded(out.select("brier", "auc"), "brier", "auc")


HORIZONS = (5.0, 10.0, 15.0, 20.0, 25.0, 30.0)
CENSOR_CTE = """
fx_cens as (select surv_time, n - d as c, sum(n) over (order by surv_time desc) - d as at_risk from (
  select surv_time, count(*) as n, sum(case when surv_event = 1 then 1 else 0 end) as d from fx_risk group by surv_time)),
fx_g as (select surv_time, exp(sum(l) over (order by surv_time) - l) as g_before, exp(sum(l) over (order by surv_time)) as g_at from (
  select surv_time, case when at_risk > c then ln(1 - c / cast(at_risk as double)) else 0e0 end as l from fx_cens)),
fx_when as (select unnest([5e0, 10e0, 15e0, 20e0, 25e0, 30e0]) as t)"""


@query("m15_time_dependent_auc", check_sql("""
select t, cast(n_cases as bigint) as n_cases, cast(tc as bigint) as n_controls, round(sum_w / (tw * tc), 6) as auc from (
  select t, sum(cases) as n_cases, any_value(tc) as tc, any_value(tw) as tw, sum(w * (below + ctrl / 2e0)) as sum_w from (
    select *, coalesce(sum(ctrl) over (partition by t order by risk rows between unbounded preceding and 1 preceding), 0) as below, sum(ctrl) over (partition by t) as tc, sum(w) over (partition by t) as tw from (
      select t, risk, sum(case when surv_event = 1 and surv_time <= t then 1 / g_before else 0e0 end) as w, sum(case when surv_event = 1 and surv_time <= t then 1 else 0 end) as cases,
        sum(case when surv_time > t then 1 else 0 end) as ctrl from fx_risk join fx_g using (surv_time) cross join fx_when group by t, risk)) group by t)""",
    ENDPOINTS_CTE, SURVIVAL_CTE, RISK_CTE, CENSOR_CTE))
def m15_time_dependent_auc(spark, sf):
    return rounded(sv.time_dependent_auc(survival_rows(spark, sf), "risk", HORIZONS), "auc")


BRIER_CTE = """
fx_bs as (select t, count(*) as n, avg(case when surv_event = 1 and surv_time <= t then s * s / g_before when surv_time > t then (1 - s) * (1 - s) / gt else 0e0 end) as brier from (
  select *, exp(-coalesce((select max(cumulative) from fx_base where fx_base.surv_time <= t), 0e0) * risk) as s, coalesce((select min(g_at) from fx_g where fx_g.surv_time <= t), 1e0) as gt
  from fx_risk join fx_g using (surv_time) cross join fx_when) group by t)"""


@query("m15_brier_over_time", check_sql("select n, t, round(brier, 6) as brier from fx_bs", ENDPOINTS_CTE, SURVIVAL_CTE, RISK_CTE, HAZARD_CTE, CENSOR_CTE, BRIER_CTE))
def m15_brier_over_time(spark, sf):
    rows = survival_rows(spark, sf)
    return rounded(sv.brier_over_time(rows, sv.baseline_hazard(rows, "risk"), "risk", HORIZONS), "brier")


@query("m15_integrated_brier", check_sql("""
select min(t) as t_from, max(u) as t_to, round(sum((u - t) * (brier + next) / 2) / (max(u) - min(t)), 6) as ibs from (
  select t, brier, lead(t) over (order by t) as u, lead(brier) over (order by t) as next from fx_bs) where u is not null""",
    ENDPOINTS_CTE, SURVIVAL_CTE, RISK_CTE, HAZARD_CTE, CENSOR_CTE, BRIER_CTE))
def m15_integrated_brier(spark, sf):
    rows = survival_rows(spark, sf)
    return rounded(sv.integrated_brier(sv.brier_over_time(rows, sv.baseline_hazard(rows, "risk"), "risk", HORIZONS)), "ibs")


@query("m17_proportional_hazards_test", check_sql("""
select (select count(*) from fx_risk where surv_event = 1) as n_events, covariate, round(corr(v - m, rk), 6) as correlation from (
  select unnest(['river_distance_km', 'absolute_elevation']) as covariate, unnest([river_distance_km, absolute_elevation]) as v, unnest([m1, m2]) as m, rk
  from fx_risk join (select surv_time, m1, m2, sum(d) over (order by surv_time) - (d - 1) / 2e0 as rk from (
    select surv_time, sum(surv_event) as d, sum(sum(risk * river_distance_km)) over w / sum(sum(risk)) over w as m1,
      sum(sum(risk * absolute_elevation)) over w / sum(sum(risk)) over w as m2 from fx_risk group by surv_time window w as (order by surv_time desc)) where d > 0) using (surv_time)
  where surv_event = 1) group by covariate""", ENDPOINTS_CTE, SURVIVAL_CTE, RISK_CTE))
def m17_proportional_hazards_test(spark, sf):
    return rounded(sv.proportionality(survival_rows(spark, sf), "risk", ["river_distance_km", "absolute_elevation"]), "correlation")


@query("m12_cox")
def m12_cox(spark, sf):
    """Ridge Cox model of each fold's complement: concordance, and P(stiff within 30 m) scores on the fold."""
    from groundsieve.functions.mesh import with_mesh
    from groundsieve.session import cut_lineage

    rows = cut_lineage(with_mesh(survival_rows(spark, sf)).withColumn("fold", (F.col("mesh_row") + 2 * F.col("mesh_col")) % 3))
    rows = quality.require_complete(rows, sv.COVARIATES)

    def run(i: int):
        train, test = rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)
        model = sv.cox(train)
        train, test = train.withColumn("_risk", model.risk()), test.withColumn("_risk", model.risk())
        c = pairs.concordance(test, [], "surv_time", "surv_event", "_risk")
        s = sv.survival_at(test, sv.baseline_hazard(train, "_risk"), "_risk", [30.0])
        s = s.select(F.lit(i).alias("fold"), (1 - F.col("surv_30")).alias("p"), ((F.col("surv_event") == 1) & (F.col("surv_time") <= 30)).cast("int").alias("y"))
        out = th.brier_and_log_loss(s, ["fold"]).join(th.roc_auc(s, ["fold"]), "fold").withColumn("c_index", c.select("c_index").scalar())
        return out.select("fold", "n", "brier", "auc", "c_index")

    return rounded(learn.each_fold(3, run), "brier", "auc", "c_index")


@query("m13_weibull_aft")
def m13_weibull_aft(spark, sf):
    rows = borehole_rows(spark, sf).persist()
    from pyspark.ml.functions import vector_to_array

    fit = lambda i: sv.weibull(rows.where(F.col("fold") != i)).transform(rows.where(F.col("fold") == i))
    out = learn.each_fold(3, fit).withColumn("_q", vector_to_array("quantiles"))
    return rounded(out.select("latitude_deg", "longitude_deg", F.col("_q")[1].alias("median_depth")), "median_depth")


@query("m14_forest_survival")
def m14_forest_survival(spark, sf):
    rows = borehole_rows(spark, sf).drop("features").persist()
    features = lambda df: learn.assemble(df, learn.BOREHOLE, extra=["interval_mid"])
    models = sv.forest_survival(rows, 3, features)
    return rounded(sv.forest_survival_at(models, rows, features, ["latitude_deg", "longitude_deg"], 30.0), "survival")

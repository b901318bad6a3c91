"""Queries: threshold classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsieve.operators import thresholds as th
from groundsieve.plans import inputs
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.registry import query, rounded

LABEL_CTE = """
fx_labels as (
  select row_key, regime_code, label, case when side = 'below' then cast(n_value < c as int) else cast(n_value >= c as int) end as y,
    case when side = 'below' then 1 - p else p end as p
  from (select row_key, regime_code, n_value, round(1 / (1 + exp(-(y_pred - 15) / 6)), 3) as p from fx_pred)
  cross join (values ('lt5', 'below', 5), ('lt10', 'below', 10), ('lt15', 'below', 15), ('ge30', 'above', 30)) v(label, side, c)),
ties as (select label, p, count(*) as n, sum(y) as pos from fx_labels group by label, p),
tot as (select label, sum(n) as n, sum(pos) as pos from ties group by label)"""


def probabilities(spark, sf):
    """Scores for P(stiff) and P(soft); rounded to three decimals to make ties."""
    p = inputs.predictions(spark, sf)
    s = F.round(1 / (1 + F.exp(-(F.col("y_pred") - 15) / 6)), 3)
    rows = th.with_labels(p.select("row_key", "regime_code", "n_value", s.alias("_p")))
    return rows.withColumn("p", F.when(F.col("label") == "ge30", F.col("_p")).otherwise(1 - F.col("_p"))).drop("_p")


@query("t1_threshold_labels", check_sql("""
select label, count(*) as n, round(avg(cast(y as double)), 6) as positive_rate from fx_labels group by label""", LABEL_CTE))
def t1_threshold_labels(spark, sf):
    return rounded(th.positive_rates(probabilities(spark, sf)), "positive_rate")


@query("t2_t8_brier_log_loss_skill", check_sql("""
select label, count(*) as n, round(avg((p - y) * (p - y)), 6) as brier,
  round(avg(-case when y = 1 then ln(least(greatest(p, 1e-7), 1 - 1e-7)) else ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)) end), 6) as log_loss,
  round(1 - avg((p - y) * (p - y)) / (avg(cast(y as double)) * (1 - avg(cast(y as double)))), 6) as brier_skill
from fx_labels group by label""", LABEL_CTE))
def t2_t8_brier_log_loss_skill(spark, sf):
    return rounded(th.brier_and_log_loss(probabilities(spark, sf), ["label"]), "brier", "log_loss", "brier_skill")


@query("t3_ece", check_sql("""
select label, round(sum(n * abs(acc - conf)) / sum(n), 6) as ece from (
  select label, least(floor(p * 15), 14) as b, count(*) as n, avg(p) as conf, avg(cast(y as double)) as acc from fx_labels group by 1, 2) group by label""", LABEL_CTE))
def t3_ece(spark, sf):
    return rounded(th.ece(probabilities(spark, sf), ["label"]), "ece")


@query("t4_roc_auc", check_sql("""
select label, round(sum(pos * (below + (n - pos) / 2e0)) / any_value(tp * (tn - tp)), 6) as auc from (
  select t.*, tot.pos as tp, tot.n as tn, coalesce(sum(t.n - t.pos) over (partition by label order by p rows between unbounded preceding and 1 preceding), 0) as below
  from ties t join tot using (label)) group by label""", LABEL_CTE))
def t4_roc_auc(spark, sf):
    return rounded(th.roc_auc(probabilities(spark, sf), ["label"]), "auc")


@query("t5_t7_average_precision_recall", check_sql("""
select label, round(sum(pos / tp * (cp / cn)), 6) as average_precision,
  round(coalesce(max(cp / tp) filter ((cn - cp) / (tn - tp) <= 0.01e0), 0e0), 6) as recall_at_fpr_1,
  round(coalesce(max(cp / tp) filter ((cn - cp) / (tn - tp) <= 0.05e0), 0e0), 6) as recall_at_fpr_5,
  round(coalesce(max(cp / tp) filter ((cn - cp) / (tn - tp) <= 0.1e0), 0e0), 6) as recall_at_fpr_10 from (
  select label, cast(t.pos as double) as pos, cast(tot.pos as double) as tp, cast(tot.n as double) as tn,
    cast(sum(t.n) over w as double) as cn, cast(sum(t.pos) over w as double) as cp
  from ties t join tot using (label) window w as (partition by label order by p desc rows unbounded preceding)) group by label""", LABEL_CTE))
def t5_t7_average_precision_recall(spark, sf):
    return rounded(th.rank_metrics(probabilities(spark, sf), ["label"]), "average_precision", "recall_at_fpr_1", "recall_at_fpr_5", "recall_at_fpr_10")


@query("t6_top_k_precision", check_sql("select label, " + ", ".join(
    f"round(sum(case when rn <= k{k} then y else 0 end) / any_value(k{k}), 6) as precision_top_{k}" for k in (1, 5, 10)) + " from (select *, "
    + ", ".join(f"greatest(1e0, round_even(n * {k / 100}e0, 0)) as k{k}" for k in (1, 5, 10))
    + " from (select label, y, row_number() over (partition by label order by p desc, row_key) as rn, count(*) over (partition by label) as n from fx_labels)) group by label", LABEL_CTE))
def t6_top_k_precision(spark, sf):
    out = th.top_k_precision(probabilities(spark, sf), ["label"], [0.01, 0.05, 0.1], "row_key")
    return rounded(out, "precision_top_1", "precision_top_5", "precision_top_10")


@query("t9_net_benefit", check_sql("""
select label, t as threshold, round(sum(case when p >= t and y = 1 then 1e0 else 0e0 end) / count(*)
  - sum(case when p >= t and y = 0 then 1e0 else 0e0 end) / count(*) * t / (1 - t), 6) as net_benefit
from fx_labels cross join (values (0.05e0), (0.1e0), (0.2e0), (0.5e0)) v(t) group by label, t""", LABEL_CTE))
def t9_net_benefit(spark, sf):
    return rounded(th.net_benefit(probabilities(spark, sf), ["label"], [0.05, 0.1, 0.2, 0.5]), "net_benefit")


@query("t10_reliability_equal_mass", check_sql("""
select label, cast(bin as int) as bin, count(*) as n, round(avg(p), 8) as mean_p, round(avg(cast(y as double)), 8) as observed from (
  select label, p, y, (select count(*) from range(1, 10) r(i) where floor(i * n / 10e0) <= rn - 1) as bin from (
    select label, p, y, row_number() over (partition by label order by p, row_key) as rn, count(*) over (partition by label) as n from fx_labels)) group by label, bin""", LABEL_CTE))
def t10_reliability_equal_mass(spark, sf):
    out = th.reliability_equal_mass(probabilities(spark, sf), ["label"], "row_key")
    return out.withColumns({c: F.round(c, 8) for c in ("mean_p", "observed")})


@query("t12_class_weights", check_sql("""
select label, count(*) as n, round(avg(cast(y as double)), 6) as positive_rate,
  round(case when avg(cast(y as double)) < 0.2e0 then greatest(1e0, (1 - avg(cast(y as double))) / avg(cast(y as double))) else 1e0 end, 6) as weight_positive
from fx_labels group by label""", LABEL_CTE))
def t12_class_weights(spark, sf):
    return rounded(th.class_weights(probabilities(spark, sf), ["label"]), "positive_rate", "weight_positive")

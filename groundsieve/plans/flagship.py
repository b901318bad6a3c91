"""Flagship: clean, key, fold, calibrate by group and report coverage, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundsieve.operators import calibration as cal, folds
from groundsieve.plans import inputs
from groundsieve.plans.registry import query, rounded
from groundsieve.session import cut_lineage

ALPHAS = (0.5, 0.8, 0.95)

# Check SQL of the fold layout: cells in hash order, greedy packing, calibration cells.
FOLDS_CTE = """
cells as (
  select mesh_row, mesh_col, count(*) as n_rows,
    ((mesh_row // 8) * 100 + (mesh_col // 8)) * 100 + (mesh_row % 8) * 10 + (mesh_col % 8) as mesh_code
  from fx_raw group by mesh_row, mesh_col),
ordered as (select *, row_number() over (order by md5('42:' || cast(mesh_code as varchar)), mesh_code) as i from cells),
packed as (
  select cast(0 as bigint) as i, cast(-1 as int) as fold, cast(0 as bigint) as a, cast(0 as bigint) as b, cast(0 as bigint) as c
  union all
  select i, cast(f as int), a + case when f = 0 then n_rows else 0 end, b + case when f = 1 then n_rows else 0 end,
         c + case when f = 2 then n_rows else 0 end
  from (select o.i, o.n_rows, p.a, p.b, p.c,
               case when p.a <= p.b and p.a <= p.c then 0 when p.b <= p.c then 1 else 2 end as f
        from packed p join ordered o on o.i = p.i + 1)),
cell_folds as (select o.mesh_row, o.mesh_col, o.mesh_code, o.n_rows, p.fold from ordered o join packed p using (i)),
pairs as (
  select c.mesh_row, c.mesh_col, c.mesh_code, c.n_rows, c.fold as own, k.fold
  from cell_folds c cross join (select distinct fold from cell_folds) k),
roles as (
  select mesh_row, mesh_col, fold, 'test' as role from pairs where fold = own
  union all
  select mesh_row, mesh_col, fold, case when coalesce(prior, 0) < 0.2e0 * total then 'cal' else 'fit' end
  from (select *, sum(n_rows) over (partition by fold order by md5(cast(142 + fold as varchar) || ':' || cast(mesh_code as varchar)), mesh_code
                                    rows between unbounded preceding and 1 preceding) as prior,
               sum(n_rows) over (partition by fold) as total
        from pairs where fold <> own))"""


def cell_folds(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    return folds.balanced_folds(folds.cell_counts(inputs.measurements(spark, sf)), k, seed=42)


@query("fold_conformal_coverage", inputs.check_sql("""
select fold, regime_code, alpha, count(*) as n_test,
  round(avg(case when abs(y_true - y_pred) <= q * y_std then 1e0 else 0e0 end), 6) as coverage,
  round(avg(2 * q * y_std), 6) as mean_width
from tests group by fold, regime_code, alpha""", FOLDS_CTE, """
rows_in as (select p.* exclude (fold, role), r.fold, r.role from fx_pred p join roles r using (mesh_row, mesh_col)),
scored as (select fold, regime_code, abs(y_true - y_pred) / y_std as s from rows_in where role = 'cal'),
alphas as (select unnest([0.5e0, 0.8e0, 0.95e0]) as alpha),
ranked as (
  select fold, cast(regime_code as varchar) as g, s, row_number() over (partition by fold, regime_code order by s) as i,
    count(*) over (partition by fold, regime_code) as n from scored
  union all
  select fold, '*', s, row_number() over (partition by fold order by s), count(*) over (partition by fold) from scored),
radii as (
  select fold, g, alpha, n, s as q from ranked, alphas
  where i = least(greatest(cast(ceil((n + 1) * alpha) as bigint), 1), n)),
tests as (
  select t.fold, t.regime_code, a.alpha, t.y_true, t.y_pred, t.y_std, coalesce(own.q, m.q) as q
  from rows_in t cross join alphas a
  left join radii own on own.fold = t.fold and own.g = cast(t.regime_code as varchar) and own.alpha = a.alpha and own.n >= 30
  join radii m on m.fold = t.fold and m.g = '*' and m.alpha = a.alpha
  where t.role = 'test')""", recursive=True))
def fold_conformal_coverage(spark: SparkSession, sf: str) -> DataFrame:
    # The cell layout is small and used by every later pass over the rows: work it out once.
    roles = cut_lineage(folds.fold_roles(cell_folds(spark, sf), 3, fraction=0.2, seed=142))
    rows = folds.with_roles(inputs.predictions(spark, sf), roles, keep=("test", "cal"))
    radii = cal.mondrian_radii(cal.with_score(rows.where("role = 'cal'")), "regime_code", ALPHAS, by=["fold"])
    tests = cal.with_group_radius(rows.where("role = 'test'"), radii, "regime_code", by=["fold"])
    out = cal.interval_coverage(tests, ALPHAS, by=["fold", "regime_code"])
    return rounded(out, "coverage", "mean_width")

"""Queries: calibration, conformal intervals and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsieve.functions.numeric import bin_index
from groundsieve.functions.ordered import quantiles
from groundsieve.operators import calibration as cal
from groundsieve.plans import inputs
from groundsieve.plans.inputs import check_sql
from groundsieve.plans.keys import cdf_sql, quantile_sql
from groundsieve.plans.registry import query, rounded

ALPHAS = (0.5, 0.8, 0.95)
Z = "abs(y_true - y_pred) / y_std"
ALPHA_CTE = "alphas as (select unnest([0.5e0, 0.8e0, 0.95e0]) as alpha)"
Z_CTE = ("zs(alpha, z) as (values " + ", ".join(
    f"({a}e0, {cal.normal_quantile((1 + a) / 2)!r}e0)" for a in ALPHAS) + ")")
# Radii per fold and group, marginal as '*', from calibration rows.
RADII_CTE = ALPHA_CTE + """,
scored as (select fold, regime_code, abs(y_true - y_pred) / y_std as s from fx_pred where role = 'cal'),
ranked as (
  select fold, cast(regime_code as varchar) as g, s, row_number() over (partition by fold, regime_code order by s) as i, count(*) over (partition by fold, regime_code) as n from scored
  union all select fold, '*', s, row_number() over (partition by fold order by s), count(*) over (partition by fold) from scored),
radii as (select fold, g, alpha, n, s as q from ranked, alphas where i = least(greatest(cast(ceil((n + 1) * alpha) as bigint), 1), n))"""


def _cal(spark, sf):
    return cal.with_score(inputs.predictions(spark, sf).where("role = 'cal'"))


def _test(spark, sf):
    return inputs.predictions(spark, sf).where("role = 'test'")


@query("q1_gaussian_coverage", check_sql(f"""
select fold, count(*) as n, alpha, round(avg(case when {Z} <= z then 1e0 else 0e0 end), 6) as coverage from fx_pred cross join zs where alpha = 0.95e0 group by fold, alpha""", Z_CTE))
def q1_gaussian_coverage(spark, sf):
    return rounded(cal.reliability(inputs.predictions(spark, sf), [0.95], ["fold"]).drop("gap"), "coverage")


@query("q2_reliability_table", check_sql(f"""
select regime_code, count(*) as n, alpha, round(avg(case when {Z} <= z then 1e0 else 0e0 end), 6) as coverage,
  round(avg(case when {Z} <= z then 1e0 else 0e0 end) - alpha, 6) as gap from fx_pred cross join zs group by regime_code, alpha""", Z_CTE))
def q2_reliability_table(spark, sf):
    return rounded(cal.reliability(inputs.predictions(spark, sf), ALPHAS, ["regime_code"]), "coverage", "gap")


@query("q3_temperature", check_sql(f"""
select t.fold, alpha, count(*) as n, round(any_value(temp), 6) as temperature, round(avg(case when {Z} / temp <= z then 1e0 else 0e0 end), 6) as coverage
from fx_pred t join (select fold, sqrt(avg(pow((y_true - y_pred) / y_std, 2))) as temp from fx_pred where role = 'cal' group by fold) using (fold) cross join zs
where role = 'test' group by t.fold, alpha""", Z_CTE))
def q3_temperature(spark, sf):
    temp = cal.temperature(inputs.predictions(spark, sf).where("role = 'cal'"), ["fold"])
    test = _test(spark, sf).join(cal.checked_broadcast(temp, 100), "fold")
    out = cal.reliability(test, ALPHAS, ["fold", "temperature"], scale=F.col("temperature")).drop("gap")
    return rounded(out, "temperature", "coverage")


@query("q4_conformal_radius", check_sql("select fold, n as n_cal, alpha, round(q, 6) as q from radii where g = '*'", RADII_CTE))
def q4_conformal_radius(spark, sf):
    return rounded(cal.conformal_radii(_cal(spark, sf), ALPHAS, ["fold"]), "q")


@query("q4_absolute_radius", check_sql("""
select n as n_cal, alpha, round(s, 6) as q from (select abs(y_true - y_pred) as s, row_number() over (order by abs(y_true - y_pred)) as i, count(*) over () as n
  from fx_pred where role = 'cal'), alphas where i = least(greatest(cast(ceil((n + 1) * alpha) as bigint), 1), n)""", ALPHA_CTE))
def q4_absolute_radius(spark, sf):
    rows = cal.with_score(inputs.predictions(spark, sf).where("role = 'cal'"), relative=False)
    return rounded(cal.conformal_radii(rows, ALPHAS), "q")


@query("q5_conformal_coverage", check_sql("""
select fold, count(*) as n_test, alpha, round(avg(case when abs(y_true - y_pred) <= q * y_std then 1e0 else 0e0 end), 6) as coverage,
  round(avg(2 * q * y_std), 6) as mean_width from fx_pred join (select * from radii where g = '*') using (fold) where role = 'test' group by fold, alpha""", RADII_CTE))
def q5_conformal_coverage(spark, sf):
    r = cal.conformal_radii(_cal(spark, sf), ALPHAS, ["fold"])
    packed = r.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("alpha", "q"))).alias("radii"))
    test = _test(spark, sf).join(cal.checked_broadcast(packed, 100), "fold")
    return rounded(cal.interval_coverage(test, ALPHAS, ["fold"]), "coverage", "mean_width")


@query("q6_mondrian_radius", check_sql("select fold, g as stratum, n as n_cal, alpha, round(q, 6) as q from radii where g = '*' or n >= 30", RADII_CTE))
def q6_mondrian_radius(spark, sf):
    return rounded(cal.mondrian_radii(_cal(spark, sf), "regime_code", ALPHAS, ["fold"]), "q")


@query("q7_mondrian_coverage", check_sql("""
select fold, regime_code, count(*) as n_test, alpha, round(avg(case when abs(y_true - y_pred) <= q * y_std then 1e0 else 0e0 end), 6) as coverage,
  round(avg(2 * q * y_std), 6) as mean_width from (
  select t.*, m.alpha, coalesce(o.q, m.q) as q from fx_pred t join radii m on m.fold = t.fold and m.g = '*'
  left join radii o on o.fold = t.fold and o.g = cast(t.regime_code as varchar) and o.alpha = m.alpha and o.n >= 30 where t.role = 'test') group by fold, regime_code, alpha""", RADII_CTE))
def q7_mondrian_coverage(spark, sf):
    radii = cal.mondrian_radii(_cal(spark, sf), "regime_code", ALPHAS, ["fold"])
    test = cal.with_group_radius(_test(spark, sf), radii, "regime_code", ["fold"])
    return rounded(cal.interval_coverage(test, ALPHAS, ["fold", "regime_code"]), "coverage", "mean_width")


GROUPINGS_SQL = """
select *, unnest(['regime', 'depth', 'mu', 'sigma', 'regime_depth']) as grouping,
  unnest([regime_code, depth_bin, mu_bin, sd_bin, regime_code * 6 + depth_bin]) as value from (
  select p.*, cast((y_pred >= m[1]) as int) + cast((y_pred >= m[2]) as int) + cast((y_pred >= m[3]) as int) + cast((y_pred >= m[4]) as int) as mu_bin,
    cast((y_std >= s[1]) as int) + cast((y_std >= s[2]) as int) + cast((y_std >= s[3]) as int) + cast((y_std >= s[4]) as int) as sd_bin
  from fx_pred p, (select quantile_cont(y_pred, [0.2e0, 0.4e0, 0.6e0, 0.8e0]) as m, quantile_cont(y_std, [0.2e0, 0.4e0, 0.6e0, 0.8e0]) as s from fx_pred where role = 'cal'))"""


@query("q8_mondrian_groupings", check_sql("""
select grouping, count(*) as n_test, alpha, round(avg(case when abs(y_true - y_pred) <= q * y_std then 1e0 else 0e0 end), 6) as coverage,
  round(avg(2 * q * y_std), 6) as mean_width from (
  select t.*, m.alpha, coalesce(o.q, m.q) as q from stacked t join rr m on m.grouping = t.grouping and m.v = '*'
  left join rr o on o.grouping = t.grouping and o.v = cast(t.value as varchar) and o.alpha = m.alpha and o.n >= 30 where t.role = 'test') group by grouping, alpha""",
    ALPHA_CTE, f"stacked as ({GROUPINGS_SQL})", """
sc as (select grouping, value, abs(y_true - y_pred) / y_std as s from stacked where role = 'cal'),
rk as (select grouping, cast(value as varchar) as v, s, row_number() over (partition by grouping, value order by s) as i, count(*) over (partition by grouping, value) as n from sc
  union all select grouping, '*', s, row_number() over (partition by grouping order by s), count(*) over (partition by grouping) from sc),
rr as (select grouping, v, alpha, n, s as q from rk, alphas where i = least(greatest(cast(ceil((n + 1) * alpha) as bigint), 1), n))"""))
def q8_mondrian_groupings(spark, sf):
    p = inputs.predictions(spark, sf)
    fit = p.where("role = 'cal'")
    probs = {f"q{i}": i / 5 for i in range(1, 5)}
    both = fit.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("y_pred", "y_std")])))
    # eight numbers: read once, then part of the plan as constants
    edges = {r["name"]: [0.0, *(r[q] for q in probs)] for r in quantiles(both, ["name"], "value", probs).collect()}
    label = lambda c: bin_index(F.col(c), edges[c])
    stacked = p.select("role", "y_true", "y_pred", "y_std", F.inline(F.array(*[
        F.struct(F.lit(n).alias("grouping"), v.cast("int").alias("value")) for n, v in (
            ("regime", F.col("regime_code")), ("depth", F.col("depth_bin")), ("mu", label("y_pred")),
            ("sigma", label("y_std")), ("regime_depth", F.col("regime_code") * 6 + F.col("depth_bin")))])))
    radii = cal.mondrian_radii(cal.with_score(stacked.where("role = 'cal'")), "value", ALPHAS, ["grouping"])
    test = cal.with_group_radius(stacked.where("role = 'test'"), radii, "value", ["grouping"])
    return rounded(cal.interval_coverage(test, ALPHAS, ["grouping"]), "coverage", "mean_width")


@query("q9_weighted_quantile", check_sql("""
select regime_code, round(coalesce(min(s) filter (cum / tot >= 0.8e0), max(s)), 6) as q from (
  select regime_code, s, sum(sum(w)) over (partition by regime_code order by s) as cum, sum(sum(w)) over (partition by regime_code) as tot
  from (select regime_code, abs(y_true - y_pred) / y_std as s, cast(row_key % 7 as double) as w from fx_pred where role = 'cal') group by regime_code, s) group by regime_code"""))
def q9_weighted_quantile(spark, sf):
    rows = _cal(spark, sf).withColumn("w", (F.col("row_key") % 7).cast("double"))
    return rounded(cal.weighted_quantile(rows, ["regime_code"], "score", "w", 0.8), "q")


Z_OF = lambda c: f"({c} - (select avg({c}) from fx_pred where role = 'cal')) / ((select stddev_pop({c}) from fx_pred where role = 'cal') + 1e-9)"
FEATS = ", ".join(f"{Z_OF(c)} as f{i}" for i, c in enumerate(("latitude_deg", "longitude_deg", "depth_from_surface", "regime_code"), 1))


@query("q10_locally_weighted_interval", check_sql("""
select t.row_key, round(coalesce(q, (select max(s) from c)), 6) as q from t left join (
  select row_key, coalesce(min(s) filter (cum / tot >= 0.9e0), max(s)) as q from (
    select row_key, s, sum(w) over (partition by row_key order by s, cal_key) as cum, sum(w) over (partition by row_key) as tot from (
      select row_key, cal_key, s, exp(-d2 / (2 * 0.1e0 * 0.1e0)) as w from (
        select t.row_key, c.row_key as cal_key, c.s, (t.f1 - c.f1) * (t.f1 - c.f1) + (t.f2 - c.f2) * (t.f2 - c.f2) + (t.f3 - c.f3) * (t.f3 - c.f3) + (t.f4 - c.f4) * (t.f4 - c.f4) as d2
        from t join c on c.regime_code = t.regime_code and c.g1 between t.g1 - 1 and t.g1 + 1 and abs(c.f2 - t.f2) <= 0.4e0 and abs(c.f3 - t.f3) <= 0.4e0) where d2 <= 0.4e0 * 0.4e0)) group by row_key) using (row_key)""", f"""
feats as (select *, cast(floor(f1 / 0.4e0) as int) as g1 from (select row_key, role, regime_code, abs(y_true - y_pred) / y_std as s, {FEATS} from fx_pred)),
c as (select * from feats where role = 'cal'), t as (select * from feats where role = 'test')"""))
def q10_locally_weighted_interval(spark, sf):
    """Radius of every test row. Two regimes are more than the kernel's reach apart, which the check's join uses."""
    cols = {"f1": F.col("latitude_deg"), "f2": F.col("longitude_deg"), "f3": F.col("depth_from_surface"), "f4": F.col("regime_code").cast("double")}
    rows = cal.standardised(inputs.predictions(spark, sf), inputs.predictions(spark, sf).where("role = 'cal'"), cols)
    out = cal.locally_weighted_radii(cal.with_score(rows.where("role = 'cal'")), rows.where("role = 'test'"), list(cols), 0.9, "row_key")
    return rounded(out, "q")


ISO_CTE = f"""
iso_pts as (select fold, p, (max(cum) - count(*) / 2e0) / any_value(tot) as e from (
  select fold, p, row_number() over (partition by fold order by p) as rn, rank() over (partition by fold order by p) - 1 + count(*) over (partition by fold, p) as cum,
    count(*) over (partition by fold) as tot from (
    select fold, round({cdf_sql('((y_true - y_pred) / y_std)')}, 12) as p from fx_pred where role = 'cal')) group by fold, p),
iso_grid as (select fold, i, 1e-4 + i * ((1 - 2e-4) / 2000) as p from (select distinct fold from iso_pts) cross join range(2001) r(i)),
iso_lo as (select g.fold, g.i, g.p, l.p as lp, l.e as le from iso_grid g asof left join iso_pts l on l.fold = g.fold and g.p >= l.p),
iso_both as (select g.*, h.p as hp, h.e as he from iso_lo g asof left join iso_pts h on h.fold = g.fold and g.p < h.p),
iso as (select fold, i, p, max(case when lp is null then he when hp is null then le else le + (he - le) * (p - lp) / (hp - lp) end) over (partition by fold order by i) as emp from iso_both)"""


@query("q11_isotonic_curve", check_sql("select fold, i, round(p, 6) as p, round(emp, 6) as emp from iso", ISO_CTE))
def q11_isotonic_curve(spark, sf):
    out = cal.isotonic_grid(inputs.predictions(spark, sf).where("role = 'cal'"), ["fold"])
    return rounded(out.withColumn("i", F.col("i").cast("long")), "p", "emp")


@query("q11_isotonic_interval", check_sql(f"""
select fold, alpha, round(avg(case when y_true between y_pred + z_lo * y_std and y_pred + z_hi * y_std then 1e0 else 0e0 end), 6) as coverage, round(avg((z_hi - z_lo) * y_std), 5) as mean_width
from fx_pred join (select fold, alpha, {quantile_sql('p_lo')} as z_lo, {quantile_sql('p_hi')} as z_hi from (
  select fold, alpha, coalesce(min(p) filter (emp >= 0.5e0 - alpha / 2), max(p)) as p_lo, coalesce(min(p) filter (emp >= 0.5e0 + alpha / 2), max(p)) as p_hi
  from iso cross join alphas group by fold, alpha)) using (fold) where role = 'test' group by fold, alpha""", ALPHA_CTE, ISO_CTE))
def q11_isotonic_interval(spark, sf):
    zs = cal.isotonic_z(cal.isotonic_grid(inputs.predictions(spark, sf).where("role = 'cal'"), ["fold"]), ALPHAS, ["fold"])
    t = _test(spark, sf).join(cal.checked_broadcast(zs, 1000), "fold")
    hit = F.col("y_true").between(F.col("y_pred") + F.col("z_lo") * F.col("y_std"), F.col("y_pred") + F.col("z_hi") * F.col("y_std"))
    out = t.groupBy("fold", "alpha").agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("coverage"),
                                         F.avg((F.col("z_hi") - F.col("z_lo")) * F.col("y_std")).alias("mean_width"))
    return rounded(out, "coverage").withColumn("mean_width", F.round("mean_width", 5))


@query("q12_interval_score", check_sql("""
select fold, round(avg(3.92e0 * y_std + 40e0 * (greatest(y_pred - 1.96e0 * y_std - y_true, 0e0) + greatest(y_true - y_pred - 1.96e0 * y_std, 0e0))), 6) as winkler
from fx_pred group by fold"""))
def q12_interval_score(spark, sf):
    w = 1.96 * F.col("y_std")
    s = cal.winkler(F.col("y_true"), F.col("y_pred") - w, F.col("y_pred") + w, 0.95)
    return rounded(inputs.predictions(spark, sf).groupBy("fold").agg(F.avg(s).alias("winkler")), "winkler")


@query("q13_conditional_coverage", check_sql("""
select subgroup, stratum, alpha, cast(sum(n) as bigint) as n, round(avg(coverage), 6) as coverage, round(avg(coverage - alpha), 6) as gap, round(avg(width), 6) as width from (
  select fold, subgroup, stratum, alpha, count(*) as n, avg(case when abs(y_true - y_pred) <= q * y_std then 1e0 else 0e0 end) as coverage, avg(2 * q * y_std) as width from (
    select fold, y_true, y_pred, y_std, unnest(['marginal', 'depth', 'regime', 'n_range']) as subgroup,
      unnest(['all', cast(depth_bin as varchar), cast(regime_code as varchar), case when y_true < 5 then '0' when y_true < 15 then '1' when y_true < 30 then '2' else '3' end]) as stratum
    from fx_pred where role = 'test') join (select * from radii where g = '*') using (fold)
  group by fold, subgroup, stratum, alpha having count(*) >= 30) group by subgroup, stratum, alpha""", RADII_CTE))
def q13_conditional_coverage(spark, sf):
    r = cal.conformal_radii(_cal(spark, sf), ALPHAS, ["fold"])
    packed = r.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("alpha", "q"))).alias("radii"))
    t = _test(spark, sf).join(cal.checked_broadcast(packed, 100), "fold")
    y = F.col("y_true")
    rng = F.when(y < 5, "0").when(y < 15, "1").when(y < 30, "2").otherwise("3")
    strata = F.array(*[F.struct(F.lit(n).alias("subgroup"), v.alias("stratum")) for n, v in (
        ("marginal", F.lit("all")), ("depth", F.col("depth_bin").cast("string")), ("regime", F.col("regime_code").cast("string")), ("n_range", rng))])
    per = cal.interval_coverage(t.select("fold", "y_true", "y_pred", "y_std", "radii", F.inline(strata)), ALPHAS, ["fold", "subgroup", "stratum"])
    out = per.where("n_test >= 30").groupBy("subgroup", "stratum", "alpha").agg(
        F.sum("n_test").alias("n"), F.avg("coverage").alias("coverage"), F.avg(F.col("coverage") - F.col("alpha")).alias("gap"), F.avg("mean_width").alias("width"))
    return rounded(out, "coverage", "gap", "width")


@query("q14_subset_coverage", check_sql("""
select subset, alpha, count(*) as n_subset, round(avg(case when abs(y_true - y_pred) <= q * y_std then 1e0 else 0e0 end), 6) as coverage from (
  select p.fold, y_true, y_pred, y_std, subset from fx_pred p cross join (values ('n_ge_30'), ('igneous'), ('metamorphic'), ('depth_ge_20')) v(subset)
  where role = 'test' and case subset when 'n_ge_30' then y_true >= 30 when 'igneous' then regime_code = 4 when 'metamorphic' then regime_code = 5 else depth_from_surface >= 20 end)
join (select * from radii where g = '*') using (fold) group by subset, alpha having count(*) >= 10""", RADII_CTE))
def q14_subset_coverage(spark, sf):
    r = cal.conformal_radii(_cal(spark, sf), ALPHAS, ["fold"])
    packed = r.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("alpha", "q"))).alias("radii"))
    t = _test(spark, sf).join(cal.checked_broadcast(packed, 100), "fold")
    subsets = F.array_compact(F.array(
        F.when(F.col("y_true") >= 30, "n_ge_30"), F.when(F.col("regime_code") == 4, "igneous"),
        F.when(F.col("regime_code") == 5, "metamorphic"), F.when(F.col("depth_from_surface") >= 20, "depth_ge_20")))
    out = cal.interval_coverage(t.withColumn("subset", F.explode(subsets)), ALPHAS, ["subset"]).where("n_test >= 10")
    return rounded(out.select("subset", "alpha", F.col("n_test").alias("n_subset"), "coverage"), "coverage")


@query("q15_affine_by_regime", check_sql("""
select regime_code, n, round(case when n >= 30 then b else 0e0 end, 6) as bias, round(case when n >= 30 then least(greatest(s / m, 0.25e0), 4e0) else 1e0 end, 6) as scale from (
  select regime_code, count(*) as n, avg(y_true - y_pred) as b, stddev_samp(y_true - y_pred) as s, avg(y_std) as m from fx_pred where role = 'cal' group by regime_code)"""))
def q15_affine_by_regime(spark, sf):
    return rounded(cal.affine_by_regime(inputs.predictions(spark, sf).where("role = 'cal'")), "bias", "scale")


def _methods(spark, sf):
    """Coverage of raw, temperature, isotonic and conformal intervals on test rows."""
    fit, test = inputs.predictions(spark, sf).where("role = 'cal'"), _test(spark, sf)
    raw = cal.reliability(test, ALPHAS)
    temp = cal.temperature(fit).scalar()
    scaled = cal.reliability(test.withColumn("_t", temp), ALPHAS, scale=F.col("_t"))
    radii = cal.conformal_radii(cal.with_score(fit), ALPHAS)
    arr = radii.agg(F.sort_array(F.collect_list(F.struct("alpha", "q")))).scalar()
    conf = cal.interval_coverage(test.withColumn("radii", arr), ALPHAS, [])
    zs = cal.isotonic_z(cal.isotonic_grid(fit), ALPHAS)
    z_arr = zs.agg(F.sort_array(F.collect_list(F.struct("alpha", "z_lo", "z_hi")))).scalar()
    t = test.withColumn("_z", z_arr)
    z = (F.col("y_true") - F.col("y_pred")) / F.col("y_std")
    iso = t.agg(*[F.avg(F.when(z.between(F.col("_z")[i]["z_lo"], F.col("_z")[i]["z_hi"]), 1.0).otherwise(0.0)).alias(f"c{i}") for i in range(len(ALPHAS))])
    iso = iso.select(F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"c{i}").alias("coverage")) for i, a in enumerate(ALPHAS)])))
    parts = [("raw", raw), ("temperature", scaled), ("isotonic", iso), ("conformal", conf)]
    out = None
    for name, df in parts:
        part = df.select(F.lit(name).alias("method"), "alpha", "coverage")
        out = part if out is None else out.unionByName(part)
    return out


@query("q16_method_comparison", check_sql(f"""
select method, round(avg(abs(coverage - alpha)), 6) as mean_abs_gap, rank() over (order by round(avg(abs(coverage - alpha)), 6)) = 1 as winner from (
  select 'raw' as method, alpha, avg(case when {Z} <= z then 1e0 else 0e0 end) as coverage from tst cross join zs group by alpha
  union all select 'temperature', alpha, avg(case when {Z} / t <= z then 1e0 else 0e0 end) from tst cross join zs cross join (select sqrt(avg(pow((y_true - y_pred) / y_std, 2))) as t from fx_pred where role = 'cal') group by alpha
  union all select 'conformal', alpha, avg(case when abs(y_true - y_pred) <= q * y_std then 1e0 else 0e0 end) from tst cross join (
    select alpha, s as q from (select s, row_number() over (order by s) as i, count(*) over () as n from (select {Z} as s from fx_pred where role = 'cal')), alphas where i = least(greatest(cast(ceil((n + 1) * alpha) as bigint), 1), n)) group by alpha
  union all select 'isotonic', alpha, avg(case when (y_true - y_pred) / y_std between z_lo and z_hi then 1e0 else 0e0 end) from tst cross join (
    select alpha, {quantile_sql('p_lo')} as z_lo, {quantile_sql('p_hi')} as z_hi from (select alpha, coalesce(min(p) filter (emp >= 0.5e0 - alpha / 2), max(p)) as p_lo,
      coalesce(min(p) filter (emp >= 0.5e0 + alpha / 2), max(p)) as p_hi from iso cross join alphas group by alpha)) group by alpha) group by method""",
    ALPHA_CTE, Z_CTE, "tst as (select * from fx_pred where role = 'test')",
    ISO_CTE.replace("select fold, round(", "select 0 as fold, round(")))
def q16_method_comparison(spark, sf):
    g = _methods(spark, sf).groupBy("method").agg(F.round(F.avg(F.abs(F.col("coverage") - F.col("alpha"))), 6).alias("mean_abs_gap"))
    best = g.agg(F.min(F.struct("mean_abs_gap", "method")).alias("b")).select("b.mean_abs_gap").scalar()
    return g.withColumn("winner", F.col("mean_abs_gap") == best)


@query("q17_cqr_interval", check_sql("""
select fold, round(any_value(q), 6) as q, round(avg(case when y_true between y_pred - y_std - q and y_pred + y_std + q then 1e0 else 0e0 end), 6) as coverage,
  round(avg(2 * y_std + 2 * q), 6) as mean_width from fx_pred join (
  select fold, s as q from (select fold, s, row_number() over (partition by fold order by s) as i, count(*) over (partition by fold) as n from (
    select fold, greatest(y_pred - y_std - y_true, y_true - y_pred - y_std) as s from fx_pred where role = 'cal')) where i = least(cast(ceil((n + 1) * 0.9e0) as bigint), n)) using (fold)
where role = 'test' group by fold"""))
def q17_cqr_interval(spark, sf):
    lo, hi = F.col("y_pred") - F.col("y_std"), F.col("y_pred") + F.col("y_std")
    fit = inputs.predictions(spark, sf).where("role = 'cal'").withColumn("score", cal.cqr_score(F.col("y_true"), lo, hi))
    r = cal.conformal_radii(fit, [0.9], ["fold"]).select("fold", "q")
    t = _test(spark, sf).join(cal.checked_broadcast(r, 100), "fold")
    q = F.col("q")
    out = t.groupBy("fold").agg(F.max("q").alias("q"), F.avg(F.when(F.col("y_true").between(lo - q, hi + q), 1.0).otherwise(0.0)).alias("coverage"),
                                F.avg(2 * F.col("y_std") + 2 * q).alias("mean_width"))
    return rounded(out, "q", "coverage", "mean_width")


@query("q18_scale_fallback", check_sql("""
select fold, round(case when sqrt(avg(pow(y_true - y_pred, 2))) > 0 then sqrt(avg(pow(y_true - y_pred, 2))) else 1e0 end, 6) as y_std from fx_pred where role = 'cal' group by fold"""))
def q18_scale_fallback(spark, sf):
    return rounded(cal.scale_fallback(inputs.predictions(spark, sf).where("role = 'cal'"), ["fold"]), "y_std")


@query("q19_quantile_interval", check_sql("""
select depth_bin, round(avg(case when y_true between y_pred - y_std and y_pred + 2 * y_std then 1e0 else 0e0 end), 6) as coverage, round(avg(3 * y_std), 6) as width from fx_pred group by depth_bin"""))
def q19_quantile_interval(spark, sf):
    lo, hi = F.col("y_pred") - F.col("y_std"), F.col("y_pred") + 2 * F.col("y_std")
    out = inputs.predictions(spark, sf).groupBy("depth_bin").agg(
        F.avg(F.when(F.col("y_true").between(lo, hi), 1.0).otherwise(0.0)).alias("coverage"), F.avg(hi - lo).alias("width"))
    return rounded(out, "coverage", "width")

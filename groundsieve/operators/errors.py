"""Prediction errors as grouped aggregates. Residual r = y - prediction; r > 0 is under-prediction."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundsieve.functions.numeric import normal_cdf, normal_quantile
from groundsieve.functions.ordered import row_numbers
from groundsieve.operators.small import checked_broadcast


def residual(y: str = "y_true", p: str = "y_pred") -> Column:
    return F.col(y) - F.col(p)


def rmse(r: Column) -> Column:
    return F.sqrt(F.avg(r * r))


def fold_errors(df: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """RMSE, MAE and mean predicted std."""
    r = residual()
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rmse(r).alias("rmse"), F.avg(F.abs(r)).alias("mae"),
                               F.avg("y_std").alias("std_mean"))


def regime_metrics(df: DataFrame, group: str = "regime_code") -> DataFrame:
    """Per-group errors, R2 against the global variance, mean log-likelihood and var of z."""
    bad = F.raise_error(F.lit("y_std must be strictly positive")).cast("double")
    sd = F.when(F.col("y_std") > 0, F.col("y_std")).otherwise(bad)
    r = residual()
    z = r / sd
    ll = -0.5 * math.log(2 * math.pi) - F.log(sd) - 0.5 * z * z
    total = df.agg(F.var_pop("y_true")).scalar()
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(r * r).alias("_mse"), F.avg(F.abs(r)).alias("mae"),
                              F.avg(ll).alias("mean_ll"), F.var_pop(z).alias("z_var"))
    return g.select(group, "n", F.sqrt("_mse").alias("rmse"), "mae", (1 - F.col("_mse") / (total + 1e-12)).alias("r2"), "mean_ll", "z_var")


def stratified_errors(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """RMSE, MAE and signed bias for several strata in one pass (E3): stratum, code."""
    r = residual()
    sets = df.withColumn("_r", r).groupingSets([[s] for s in strata], *strata).agg(
        F.count(F.lit(1)).alias("n"), rmse(F.col("_r")).alias("rmse"), F.avg(F.abs("_r")).alias("mae"), F.avg("_r").alias("bias"),
        *[F.grouping(s).alias(f"_g_{s}") for s in strata])
    name, code = None, None
    for s in strata:
        here = F.col(f"_g_{s}") == 0
        name = F.when(here, s) if name is None else name.when(here, s)
        code = F.when(here, F.col(s)) if code is None else code.when(here, F.col(s))
    return sets.select(name.alias("stratum"), code.alias("code"), "n", "rmse", "mae", "bias")


def grouped_errors(df: DataFrame, group: str, min_n: int = 50) -> DataFrame:
    """Errors of groups with at least ``min_n`` rows, worst last."""
    r = residual()
    return (df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), rmse(r).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.avg(r).alias("bias"))
            .where(F.col("n") >= min_n).orderBy("rmse"))


def subset_errors(df: DataFrame, subset: Column, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Errors of all rows and of a subset side by side (E5)."""
    r = residual()
    s = F.when(subset, r)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(s).alias("n_subset"), rmse(r).alias("rmse"),
                               rmse(s).alias("rmse_subset"), F.avg(F.abs(s)).alias("mae_subset"))


def over_folds(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, population std, min and max over folds; nulls are left out."""
    return per_fold.agg(F.count(F.lit(1)).alias("n_folds"), *[
        f(m).alias(f"{m}_{n}") for m in metrics
        for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def gate(summary: DataFrame, rmse_ref: float, rmse_tol: float, coverage_tol: float, nominal: float = 0.95) -> DataFrame:
    """Pass or fail against a reference error and a nominal coverage."""
    ok_r = F.col("rmse_mean") <= F.lit(rmse_ref * (1 + rmse_tol))
    ok_c = F.abs(F.col("coverage_mean") - F.lit(nominal)) <= F.lit(coverage_tol)
    return summary.withColumns({"rmse_ok": ok_r, "coverage_ok": ok_c, "passed": ok_r & ok_c})


def normalised_rmse(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RMSE over the population std of the target; NULL if that is 0."""
    r = residual()
    sd = F.stddev_pop("y_true")
    return df.groupBy(*by).agg(rmse(r).alias("rmse"), sd.alias("target_sd"), F.when(sd > 0, rmse(r) / sd).alias("nrmse"))


def subset_r2(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """R2 against the subset's own mean; NULL if its total is 0."""
    r = residual()
    v = F.var_pop("y_true")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(v > 0, 1 - F.avg(r * r) / v).alias("r2"))


def paired_bca(df: DataFrame, pred_a: str, pred_b: str, cell: str, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Cell-level bootstrap of rmse(a) - rmse(b) with a BCa interval.

    Rows are reduced to three sums per cell first. Resamples are draws x cells hashed picks,
    looked up against the cell table and summed per draw; the mesh bounds the cell table.
    """
    ea, eb = F.col("y_true") - F.col(pred_a), F.col("y_true") - F.col(pred_b)
    cells = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.sum(ea * ea).alias("a"), F.sum(eb * eb).alias("b"))
    cells = cells.withColumn("i", F.row_number().over(W.orderBy(cell)) - 1)
    total = cells.agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    stat = lambda n, a, b: F.sqrt(a / n) - F.sqrt(b / n)
    picks = total.select("c", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select(
        "c", "draw", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("j"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("j").cast("string"))), 1, 12), 16, 10).cast("long")
    picks = picks.select("draw", (h % F.col("c")).cast("int").alias("i"))
    boot = (picks.groupBy("draw", "i").agg(F.count(F.lit(1)).alias("w")).join(checked_broadcast(cells), "i").groupBy("draw")
            .agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("a")).alias("a"), F.sum(F.col("w") * F.col("b")).alias("b"))
            .select(stat(F.col("n"), F.col("a"), F.col("b")).alias("t")))
    one = total.select(F.struct("n", "a", "b").alias("s")).scalar()
    jack = cells.withColumn("_s", one).select(stat(F.col("_s.n") - F.col("n"), F.col("_s.a") - F.col("a"), F.col("_s.b") - F.col("b")).alias("t"))
    acc = jack.agg(F.avg("t").alias("m"), F.sum("t").alias("s1"), F.sum(F.col("t") * F.col("t")).alias("s2"),
                   F.sum(F.col("t") * F.col("t") * F.col("t")).alias("s3"), F.count(F.lit(1)).alias("k"))
    m, k = F.col("m"), F.col("k")
    # sums of (m - t)^2 and (m - t)^3 from power sums
    d2 = F.col("s2") - k * m * m
    d3 = k * m * m * m - 3 * m * m * F.col("s1") + 3 * m * F.col("s2") - F.col("s3")
    acc = acc.select(F.when(d2 > 0, d3 / (6 * F.pow(d2, F.lit(1.5)))).otherwise(0.0).alias("a"))
    theta = total.select(stat(F.col("n"), F.col("a"), F.col("b")))
    # at most ``draws`` values: one sorted array
    packed = boot.agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "ts", theta.scalar().alias("theta"), acc.scalar().alias("a"))
    from groundsieve.functions.numeric import normal_quantile_col

    share = F.size(F.filter("ts", lambda x: x < F.col("theta"))) / F.size("ts")
    packed = packed.withColumn("z0", normal_quantile_col(F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-6))))
    cols = []
    for name, q in (("ci_lo", (1 - level) / 2), ("ci_hi", (1 + level) / 2)):
        z = F.col("z0") + F.lit(normal_quantile(q))
        p = normal_cdf(F.col("z0") + z / (1 - F.col("a") * z))
        pos = p * (F.size("ts") - 1)
        lo, hi = F.get("ts", F.floor(pos).cast("int")), F.get("ts", F.ceil(pos).cast("int"))
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return packed.select(F.col("theta").alias("difference"), F.col("z0").alias("bias_correction"), F.col("a").alias("acceleration"), *cols)


def shuffled_columns(df: DataFrame, columns: Sequence[str], key: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the given columns replaced by those of another row (of the same ``by``), one permutation for all
    of them (E12): rows in key order meet rows in hash order at the same exact position."""
    by = list(by)
    base = row_numbers(df.withColumn("_k", F.col(key)), by, "_k", key, name="_pos")
    donor = df.select(key, *by, *columns).withColumn("_h", F.xxhash64(F.lit(seed), key))
    donor = row_numbers(donor, by, "_h", key, name="_pos").select("_pos", *by, *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = base.drop(*columns).join(donor, [*by, "_pos"])
    return out.withColumnsRenamed({f"_n_{c}": c for c in columns}).drop("_pos", "_k").select(*df.columns)

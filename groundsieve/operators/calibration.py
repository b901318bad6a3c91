"""Calibration of predictive intervals: Gaussian, temperature, split-conformal and relatives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundsieve.functions.numeric import normal_cdf, normal_quantile, normal_quantile_col
from groundsieve.functions.ordered import order_statistics, running_totals, value_counts
from groundsieve.operators.nearest import kernel_quantiles
from groundsieve.operators.small import checked_broadcast

MIN_GROUP = 30
MAX_GROUPS = 10_000
ALL = "*"


def _check_alpha(alpha: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must be in (0, 1), got {alpha}")


def positive_std(std: str = "y_std") -> Column:
    """The std column, failing the job where it is not above zero."""
    bad = F.raise_error(F.lit("y_std must be strictly positive")).cast("double")
    return F.when(F.col(std) > 0, F.col(std)).otherwise(bad)


def with_score(df: DataFrame, relative: bool = True) -> DataFrame:
    """Non-conformity score: absolute residual, in units of the predicted std if relative."""
    resid = F.abs(F.col("y_true") - F.col("y_pred"))
    return df.withColumn("score", resid / positive_std() if relative else resid)


def reliability(df: DataFrame, alphas: Sequence[float], by: Sequence[str] = (), scale: Column | None = None) -> DataFrame:
    """Nominal against empirical coverage of mu +- z * sd (Q1, Q2)."""
    for a in alphas:
        _check_alpha(a)
    z = F.abs(F.col("y_true") - F.col("y_pred")) / positive_std()
    if scale is not None:
        z = z / scale
    aggs = [F.avg(F.when(z <= F.lit(normal_quantile((1 + a) / 2)), 1.0).otherwise(0.0)).alias(f"_c{i}")
            for i, a in enumerate(alphas)]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    return wide.select(*by, "n", F.inline(F.array(*[
        F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_c{i}").alias("coverage"), (F.col(f"_c{i}") - F.lit(float(a))).alias("gap"))
        for i, a in enumerate(alphas)])))


def temperature(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """T = sqrt(mean z^2) (Q3)."""
    z = (F.col("y_true") - F.col("y_pred")) / positive_std()
    return df.groupBy(*by).agg(F.sqrt(F.avg(z * z)).alias("temperature"))


def conformal_radii(cal: DataFrame, alphas: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Marginal split-conformal radius per alpha (Q4): columns by, n_cal, alpha, q."""
    for a in alphas:
        _check_alpha(a)
    return order_statistics(cal, by, "score", alphas)


def mondrian_radii(cal: DataFrame, group: str, alphas: Sequence[float], by: Sequence[str] = (),
                   min_group: int = MIN_GROUP) -> DataFrame:
    """Radius per group with at least ``min_group`` rows, plus the marginal one as group '*' (Q6)."""
    for a in alphas:
        _check_alpha(a)
    radii = order_statistics(cal, by, "score", alphas, rollup=group, whole=ALL)
    return radii.where((F.col("stratum") == ALL) | (F.col("n_cal") >= min_group))


def with_group_radius(test: DataFrame, radii: DataFrame, group: str, by: Sequence[str] = (),
                      max_groups: int = MAX_GROUPS) -> DataFrame:
    """Add ``radii``: array of (alpha, q) of the row's group, or the marginal ones (Q7).

    Group codes come from code lists (regimes, depth bins, quintiles), so the radius table, a row per group and stratum, is
    bounded and broadcast behind a check.
    """
    packed = radii.groupBy(*by, "stratum").agg(F.sort_array(F.collect_list(F.struct("alpha", "q"))).alias("_q"))
    own = packed.where(F.col("stratum") != ALL).select(*by, F.col("stratum").alias("_s"), F.col("_q").alias("_own"))
    marginal = packed.where(F.col("stratum") == ALL).select(*by, F.col("_q").alias("_all"))
    out = test.withColumn("_s", F.col(group).cast("string"))
    out = out.join(checked_broadcast(marginal, max_groups), list(by)) if by else out.withColumn("_all", marginal.select("_all").scalar())
    out = out.join(checked_broadcast(own, max_groups), [*by, "_s"], "left")
    return out.withColumn("radii", F.coalesce("_own", "_all")).drop("_s", "_own", "_all")


def interval_coverage(df: DataFrame, alphas: Sequence[float], by: Sequence[str], relative: bool = True) -> DataFrame:
    """Share of rows inside mu +- q * sd, and mean width, per alpha (Q5, Q7)."""
    sd = F.col("y_std") if relative else F.lit(1.0)
    resid = F.abs(F.col("y_true") - F.col("y_pred"))
    ordered = sorted(alphas)
    aggs = []
    for i, _ in enumerate(ordered):
        q = F.col("radii")[i]["q"]
        aggs += [F.avg(F.when(resid <= q * sd, 1.0).otherwise(0.0)).alias(f"_c{i}"), F.avg(2 * q * sd).alias(f"_w{i}")]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"), *aggs)
    return wide.select(*by, "n_test", F.inline(F.array(*[
        F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_c{i}").alias("coverage"), F.col(f"_w{i}").alias("mean_width"))
        for i, a in enumerate(ordered)])))


def weighted_quantile(df: DataFrame, by: Sequence[str], value: str, weight: str, alpha: float) -> DataFrame:
    """Smallest value whose cumulative weight share reaches alpha; the maximum if all weights are 0 (Q9)."""
    ranked = running_totals(value_counts(df, by, value, {"w": F.col(weight)}, complete=True), by, value, ["w"])
    share = F.when(F.col("tot_w") > 0, F.col("cum_w") / F.col("tot_w"))
    return ranked.groupBy(*by).agg(
        F.coalesce(F.min(F.when(share >= F.lit(float(alpha)), F.col(value))), F.max(value)).alias("q"))


def winkler(y: Column, lo: Column, hi: Column, alpha: float) -> Column:
    """Interval score: width plus a miss penalty of 2 / (1 - alpha) (Q12)."""
    miss = F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0))
    return (hi - lo) + F.lit(2.0 / (1.0 - alpha)) * miss


def affine_by_regime(cal: DataFrame, by: Sequence[str] = ("regime_code",), lo: float = 0.25, hi: float = 4.0,
                     min_group: int = MIN_GROUP) -> DataFrame:
    """Bias and std scale per group; small groups keep the identity (Q15)."""
    resid = F.col("y_true") - F.col("y_pred")
    g = cal.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(resid).alias("_b"),
                             F.stddev_samp(resid).alias("_s"), F.avg("y_std").alias("_m"))
    enough = F.col("n") >= min_group
    scale = F.least(F.greatest(F.col("_s") / F.col("_m"), F.lit(lo)), F.lit(hi))
    return g.select(*by, "n", F.when(enough, F.col("_b")).otherwise(0.0).alias("bias"),
                    F.when(enough, scale).otherwise(1.0).alias("scale"))


def cqr_score(y: Column, lo: Column, hi: Column) -> Column:
    """Conformalised-quantile score (Q17)."""
    return F.greatest(lo - y, y - hi)


def scale_fallback(cal: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One global rmse as the std of a point model; 1.0 if it is 0 (Q18)."""
    resid = F.col("y_true") - F.col("y_pred")
    rmse = F.sqrt(F.avg(resid * resid))
    return cal.groupBy(*by).agg(F.when(rmse > 0, rmse).otherwise(1.0).alias("y_std"))


ISO_GRID = 2001
ISO_EDGE = 1e-4


def isotonic_grid(cal: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recalibration curve on 2001 grid probabilities (Q11): by, i, p, emp.

    The target of the fit is the mid-rank of the sorted probabilities, which already rises with
    them, so pooling only averages ties (probabilities equal to 12 decimals): the fit is the tie-group mid-rank, interpolated. Points
    are reduced to the last and first one inside each grid step before any window.
    """
    step = (1 - 2 * ISO_EDGE) / (ISO_GRID - 1)
    scored = cal.select(*by, ((F.col("y_true") - F.col("y_pred")) / positive_std()).alias("_z"))
    scored = scored.select(*by, F.round(normal_cdf(F.col("_z")), 12).alias("_p"))
    ranked = running_totals(value_counts(scored, by, "_p", complete=True), by, "_p", ["n"])
    pts = ranked.select(*by, "_p", ((F.col("cum_n") - F.col("n") / 2) / F.col("tot_n")).alias("_e"))
    # i = number of grid points strictly below p, so grid points i.. lie at or above it
    i = F.least(F.greatest(F.ceil((F.col("_p") - ISO_EDGE) / step), F.lit(0)), F.lit(ISO_GRID))
    cells = pts.withColumn("i", i).groupBy(*by, "i").agg(
        F.max(F.struct("_p", "_e")).alias("_last"), F.min(F.struct("_p", "_e")).alias("_first"))
    spark = cal.sparkSession
    slots = F.explode(F.sequence(F.lit(0), F.lit(ISO_GRID))).alias("i")
    frame = cells.select(*by).distinct().select(*by, slots) if by else spark.range(1).select(slots)
    full = frame.join(cells, [*by, "i"], "left")
    below = W.partitionBy(*by).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    above = W.partitionBy(*by).orderBy("i").rowsBetween(1, W.unboundedFollowing)
    full = full.withColumns({"_lo": F.last("_last", ignorenulls=True).over(below),
                             "_hi": F.first("_first", ignorenulls=True).over(above)}).where(F.col("i") < ISO_GRID)
    p = ISO_EDGE + F.col("i") * step
    lo_p, lo_e, hi_p, hi_e = F.col("_lo._p"), F.col("_lo._e"), F.col("_hi._p"), F.col("_hi._e")
    emp = (F.when(F.col("_lo").isNull(), hi_e).when(F.col("_hi").isNull(), lo_e)
           .otherwise(lo_e + (hi_e - lo_e) * (p - lo_p) / (hi_p - lo_p)))
    out = full.select(*by, "i", p.alias("p"), emp.alias("emp"))
    return out.withColumn("emp", F.max("emp").over(below))


def isotonic_z(grid: DataFrame, alphas: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Lower and upper z per alpha by inverting the curve at both tails: by, alpha, z_lo, z_hi."""
    top = F.max("p")
    aggs = []
    for j, a in enumerate(alphas):
        for side, target in (("lo", 0.5 - a / 2), ("hi", 0.5 + a / 2)):
            aggs.append(F.coalesce(F.min(F.when(F.col("emp") >= F.lit(target), F.col("p"))), top).alias(f"_{side}{j}"))
    wide = grid.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.inline(F.array(*[
        F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_lo{j}").alias("_pl"), F.col(f"_hi{j}").alias("_ph"))
        for j, a in enumerate(alphas)]))).select(
        *by, "alpha", normal_quantile_col(F.col("_pl")).alias("z_lo"), normal_quantile_col(F.col("_ph")).alias("z_hi"))


def standardised(df: DataFrame, fit: DataFrame, features: Mapping[str, Column]) -> DataFrame:
    """``df`` with the features in units of their spread over ``fit`` (population, plus 1e-9)."""
    stats = fit.select([c.alias(n) for n, c in features.items()]).agg(
        *[F.avg(n).alias(f"m_{n}") for n in features], *[F.stddev_pop(n).alias(f"s_{n}") for n in features]).first()
    return df.withColumns({n: (c - F.lit(stats[f"m_{n}"])) / F.lit((stats[f"s_{n}"] or 0.0) + 1e-9) for n, c in features.items()})


def locally_weighted_radii(cal: DataFrame, tests: DataFrame, features: Sequence[str], alpha: float, key: str, bandwidth: float = 0.1,
                           cutoff: float = 4.0, **sizes: int) -> DataFrame:
    """Kernel-weighted conformal radius of every test row (Q10): key, q.

    The kernel is Gaussian up to ``cutoff`` bandwidths, where a weight is exp(-8) of the highest, and 0 beyond: calibration
    and test rows meet tile by tile. A test row with no calibration row in reach has all weights zero and takes the largest score.
    """
    _check_alpha(alpha)
    near = kernel_quantiles(tests, cal, "score", alpha, bandwidth=bandwidth, cutoff=cutoff, query_key=key, point_key=key, coords=features, **sizes)
    top = cal.agg(F.max("score")).scalar()
    return tests.select(key).join(near, key, "left").select(key, F.coalesce("q", top).alias("q"))

"""Censored depth-to-stiff models on the borehole table (surv_time, surv_event)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.functions.ordered import running_totals
from groundsieve.operators import trees as tree_fits

PENALTY = 0.01
FOREST_SUBSET = 4  # of 14 features
COVARIATES = ("latitude_deg", "longitude_deg", "regime_code", "river_distance_km", "coast_distance_km", "absolute_elevation")


class Cox(NamedTuple):
    columns: tuple[str, ...]
    centre: np.ndarray
    scale: np.ndarray
    beta: np.ndarray  # on standardised covariates

    def risk(self) -> Column:
        """Partial hazard exp(x . beta) of a row."""
        eta = F.lit(0.0)
        for c, m, s, b in zip(self.columns, self.centre, self.scale, self.beta):
            eta = eta + (F.col(c) - F.lit(float(m))) * F.lit(float(b / s))
        return F.exp(eta)


def risk_sets(df: DataFrame, risk: str, moments: dict[str, Column], time: str = "surv_time", event: str = "surv_event") -> DataFrame:
    """One row per distinct time: events ``d``, sums over the risk set (rows not earlier), and sums
    over the tied events. ``moments`` are weighted by ``risk``; s_* is the risk set, e_* the events.
    """
    items = {"one": F.lit(1.0), **moments}
    is_event = F.col(event) == 1
    per = df.groupBy(time).agg(
        F.sum(F.col(event).cast("long")).alias("d"),
        *[F.sum(F.col(risk) * c).alias(f"w_{n}") for n, c in items.items()],
        *[F.sum(F.when(is_event, F.col(risk) * c).otherwise(0.0)).alias(f"e_{n}") for n, c in items.items()])
    r = running_totals(per, [], time, [f"w_{n}" for n in items], descending=True)
    return r.select(time, "d", *[F.col(f"cum_w_{n}").alias(f"s_{n}") for n in items], *[f"e_{n}" for n in items])


def cox(df: DataFrame, columns: Sequence[str] = COVARIATES, penalty: float = PENALTY, steps: int = 25, tol: float = 1e-6) -> Cox:
    """Cox proportional hazards with a ridge penalty, ties by Efron.

    Newton steps on the driver over a p x p system; the sums behind each step are one Spark
    aggregation by distinct time and running totals over times. No convergence within ``steps`` is
    an error.
    """
    p = len(columns)
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                   *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([stats[f"m{i}"] for i in range(p)], float)
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(p)], float)
    z = [(F.col(c) - F.lit(float(centre[i]))) / F.lit(float(scale[i])) for i, c in enumerate(columns)]
    rows = df.select("surv_time", "surv_event", *[v.alias(f"z{i}") for i, v in enumerate(z)]).persist()
    events = rows.where("surv_event = 1").agg(*[F.sum(f"z{i}") for i in range(p)]).first()
    event_sum = np.array([v or 0.0 for v in events], float)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    beta = np.zeros(p)
    for _ in range(steps):
        eta = sum((F.col(f"z{i}") * F.lit(float(beta[i])) for i in range(p)), F.lit(0.0))
        moments = {f"a{i}": F.col(f"z{i}") for i in range(p)} | {f"b{i}_{j}": F.col(f"z{i}") * F.col(f"z{j}") for i, j in pairs}
        sets = risk_sets(rows.withColumn("_w", F.exp(eta)), "_w", moments).where("d > 0")
        # Efron: the l-th of d tied events sees the risk set less l/d of the tied events
        tied = sets.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("d") - 1) / 1024))))
        tied = tied.withColumn("_l", F.explode(F.sequence(F.col("_blk") * 1024, F.least(F.col("_blk") * 1024 + 1023, F.col("d") - 1))))
        share = F.col("_l") / F.col("d")
        s = {n: F.col(f"s_{n}") - share * F.col(f"e_{n}") for n in ("one", *moments)}
        tied = tied.select(s["one"].alias("q"), *[(s[n] / s["one"]).alias(n) for n in moments])
        got = tied.agg(*[F.sum(f"a{i}") for i in range(p)], *[F.sum(F.col(f"b{i}_{j}") - F.col(f"a{i}") * F.col(f"a{j}")) for i, j in pairs]).first()
        grad = event_sum - np.array(got[:p], float) - penalty * stats["n"] * beta
        info = np.zeros((p, p))
        for v, (i, j) in zip(got[p:], pairs):
            info[i, j] = info[j, i] = v
        info += penalty * stats["n"] * np.eye(p)
        step = np.linalg.solve(info, grad)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    else:
        raise RuntimeError(f"the Cox model has not converged after {steps} Newton steps")
    rows.unpersist()
    return Cox(tuple(columns), centre, scale, beta)


def baseline_hazard(df: DataFrame, risk: str, time: str = "surv_time", event: str = "surv_event") -> DataFrame:
    """Breslow cumulative baseline hazard at event times (M16): time, d, hazard, cumulative."""
    sets = risk_sets(df, risk, {}, time, event).where("d > 0").select(time, "d", (F.col("d") / F.col("s_one")).alias("hazard"))
    return running_totals(sets, [], time, ["hazard"]).select(time, "d", "hazard", F.col("cum_hazard").alias("cumulative"))


def survival_at(df: DataFrame, hazard: DataFrame, risk: str, times: Sequence[float], time: str = "surv_time") -> DataFrame:
    """S(t | x) = exp(-H0(t) * risk) at the given times."""
    h = hazard.agg(*[F.coalesce(F.max(F.when(F.col(time) <= t, F.col("cumulative"))), F.lit(0.0)).alias(f"_h{i}") for i, t in enumerate(times)])
    out = df.withColumn("_h", h.select(F.array(*[f"_h{i}" for i in range(len(times))])).scalar())
    return out.withColumns({f"surv_{t:g}": F.exp(-F.col("_h")[i] * F.col(risk)) for i, t in enumerate(times)}).drop("_h")


def censoring_curve(df: DataFrame, time: str = "surv_time", event: str = "surv_event") -> DataFrame:
    """Kaplan-Meier curve of the censoring: time, g_before, g_at for every distinct time.

    At a tie events come before censorings, so who is censored is at risk with those that remain. Where all of them are
    censored at the last time the curve is left as it was before: nobody is seen beyond it.
    """
    is_event = (F.col(event) == 1).cast("long")
    per = df.groupBy(time).agg(F.count(F.lit(1)).alias("n"), F.sum(is_event).alias("d"))
    sets = running_totals(per, [], time, ["n"], descending=True)
    left = F.col("cum_n") - F.col("d")
    share = F.when(left > F.col("n") - F.col("d"), F.log(1 - (F.col("n") - F.col("d")) / left)).otherwise(0.0)
    logs = running_totals(sets.select(time, share.alias("l")), [], time, ["l"])
    return logs.select(time, F.exp(F.col("cum_l") - F.col("l")).alias("g_before"), F.exp("cum_l").alias("g_at"))


def _at_times(curve: DataFrame, times: Sequence[float], time: str) -> list[Column]:
    """The curve's value at each given time."""
    row = curve.agg(*[F.coalesce(F.min(F.when(F.col(time) <= t, F.col("g_at"))), F.lit(1.0)).alias(f"g{i}") for i, t in enumerate(times)]).first()
    return [F.lit(float(row[f"g{i}"])) for i in range(len(times))]


def time_dependent_auc(df: DataFrame, risk: str, times: Sequence[float], time: str = "surv_time", event: str = "surv_event") -> DataFrame:
    """Cumulative/dynamic AUC with inverse-probability-of-censoring weights (M15): t, n_cases, n_controls, auc; NULL without either.

    A case has its event by t and weighs 1 / G just before it; a control is seen beyond t. Equal risks are summed before they are ranked.
    """
    rows = df.select(time, event, F.col(risk).alias("_k")).join(censoring_curve(df, time, event), time)
    items = [F.struct(F.lit(float(t)).alias("t"), ((F.col(event) == 1) & (F.col(time) <= t)).alias("case"), (F.col(time) > t).cast("long").alias("ctrl")) for t in times]
    flat = rows.select("_k", "g_before", F.inline(F.array(*items))).where(F.col("case") | (F.col("ctrl") > 0))
    cells = flat.groupBy("t", "_k").agg(F.sum(F.when(F.col("case"), 1 / F.col("g_before")).otherwise(0.0)).alias("w"),
                                        F.sum(F.col("case").cast("long")).alias("cases"), F.sum("ctrl").alias("ctrl"))
    ranked = running_totals(cells, ["t"], "_k", ["ctrl", "w"])
    pairs = F.max("tot_w") * F.max("tot_ctrl")
    return ranked.groupBy("t").agg(F.sum("cases").alias("n_cases"), F.max("tot_ctrl").alias("n_controls"), F.when(
        pairs > 0, F.sum(F.col("w") * (F.col("cum_ctrl") - F.col("ctrl") / 2)) / pairs).alias("auc"))


def brier_over_time(df: DataFrame, hazard: DataFrame, risk: str, times: Sequence[float], time: str = "surv_time", event: str = "surv_event") -> DataFrame:
    """Censoring-weighted Brier score of S(t | x) at every given time (M15): t, n, brier. Rows censored before t weigh 0."""
    curve = censoring_curve(df, time, event)
    g = _at_times(curve, times, time)
    rows = survival_at(df, hazard, risk, times, time).join(curve, time)
    miss = []
    for t, at in zip(times, g):
        s = F.col(f"surv_{t:g}")
        early = (F.col(event) == 1) & (F.col(time) <= t)
        miss.append(F.when(early, s * s / F.col("g_before")).when(F.col(time) > t, (1 - s) * (1 - s) / at).otherwise(0.0))
    wide = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"_b{i}") for i, m in enumerate(miss)])
    return wide.select("n", F.inline(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"_b{i}").alias("brier")) for i, t in enumerate(times)])))


def integrated_brier(scores: DataFrame) -> DataFrame:
    """Mean of the score over its times by the trapezoid rule (M15): t_from, t_to, ibs. One row a time meets in one row."""
    s = scores.agg(F.sort_array(F.collect_list(F.struct("t", "brier"))).alias("s"))
    steps = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1),
                       lambda a, b: (b["t"] - a["t"]) * (a["brier"] + b["brier"]) / 2)
    span = F.element_at("s", -1)["t"] - F.element_at("s", 1)["t"]
    return s.where(F.size("s") > 1).select(F.element_at("s", 1)["t"].alias("t_from"), F.element_at("s", -1)["t"].alias("t_to"),
                                           (F.aggregate(steps, F.lit(0.0), lambda x, y: x + y) / span).alias("ibs"))


def proportionality(df: DataFrame, risk: str, columns: Sequence[str], time: str = "surv_time", event: str = "surv_event") -> DataFrame:
    """Correlation of Schoenfeld residuals with the rank of the event time, per covariate."""
    sets = risk_sets(df, risk, {f"m{i}": F.col(c) for i, c in enumerate(columns)}, time, event).where("d > 0")
    ranked = running_totals(sets, [], time, ["d"]).withColumn("_rank", F.col("cum_d") - (F.col("d") - 1) / 2)
    means = ranked.select(time, "_rank", *[(F.col(f"s_m{i}") / F.col("s_one")).alias(f"_x{i}") for i in range(len(columns))])
    ev = df.where(F.col(event) == 1).join(means, time)
    wide = ev.agg(F.count(F.lit(1)).alias("n_events"), *[F.corr(F.col(c) - F.col(f"_x{i}"), F.col("_rank")).alias(f"_r{i}") for i, c in enumerate(columns)])
    return wide.select("n_events", F.inline(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(f"_r{i}").alias("correlation"))
                                                       for i, c in enumerate(columns)])))


def weibull(train: DataFrame, quantile_probs: Sequence[float] = (0.1, 0.5, 0.9)):
    """Weibull accelerated failure time."""
    t = train.withColumn("_c", F.col("surv_event").cast("double"))
    return AFTSurvivalRegression(featuresCol="features", labelCol="surv_time", censorCol="_c", quantileProbabilities=list(quantile_probs),
                                 quantilesCol="quantiles", maxIter=30).fit(t)


def hazard_rows(df: DataFrame, width: float, horizon: Column) -> DataFrame:
    """One row per depth interval at risk, up to ``horizon``."""
    n = F.ceil(horizon / F.lit(width)).cast("int")
    return df.select("*", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("interval")).withColumn("interval_mid", (F.col("interval") + 0.5) * width)


def forest_survival(rows: DataFrame, k: int, features, width: float = 2.0, trees: int = 20, depth: int = 6, seed: int = 42) -> dict[int, list]:
    """Discrete-time hazard forests (M14), one of the complement of every fold 0..k-1, fitted in the same passes;
    ``features`` adds the vector incl. interval_mid."""
    rows = features(hazard_rows(rows, width, F.col("surv_time")))
    last = F.ceil(F.col("surv_time") / width).cast("int") - 1
    y = F.when((F.col("surv_event") == 1) & (F.col("interval") >= last), 1.0).otherwise(0.0)
    # a share of hazards: variance splits as Gini does; a classifier's nodes try the root of the number of features
    spec = tree_fits.Spec("forest", trees, depth, seed=seed, subset=FOREST_SUBSET)
    found = tree_fits.fit(rows, [tree_fits.Group(F.col("fold") != i, [y], [spec]) for i in range(k)])
    return dict(enumerate(found))


def forest_survival_at(models: dict[int, list], df: DataFrame, features, key: Sequence[str], depth_m: float, width: float = 2.0) -> DataFrame:
    """S(depth) = exp(sum log(1 - h)) over the intervals above it (M14), by the model of each row's fold."""
    rows = features(hazard_rows(df, width, F.lit(depth_m)))
    h = F.least(tree_fits.outputs(models, by=F.col("fold"))[0], F.lit(1 - 1e-9))
    return rows.withColumn("_h", h).groupBy(*key).agg(F.exp(F.sum(F.log(1 - F.col("_h")))).alias("survival"))

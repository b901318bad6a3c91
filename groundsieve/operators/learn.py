"""Models fitted at scale, and the protocols around them.

Every protocol works on one frame with ``fold`` and ``role`` columns: fit on role fit, transform
cal and test rows in one go, then score all folds in one grouped plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.functions.numeric import one_hot
from groundsieve.operators import calibration as cal, errors, folds, trees
from groundsieve.operators.small import checked_broadcast
from groundsieve.operators.trees import Spec
from groundsieve.session import cut_lineage

NUMERIC = ("latitude_deg", "longitude_deg", "depth_from_surface", "absolute_elevation", "river_distance_km", "coast_distance_km")
BOREHOLE = ("latitude_deg", "longitude_deg", "absolute_elevation", "river_distance_km", "coast_distance_km")
FOLD_THREADS = 3
REGIMES = 8  # the last entries of every feature vector


def assemble(df: DataFrame, numeric: Sequence[str] = NUMERIC, extra: Sequence[str] = ()) -> DataFrame:
    """Fixed-order feature vector: numeric columns, extras, regime one-hot.

    A NULL or NaN feature fails the fit: drop such rows first, behind ``require_complete`` (F8).
    """
    hot = one_hot(F.col("regime_code"), REGIMES, "_hot")
    wide = df.select("*", *hot)
    names = [*numeric, *extra, *[f"_hot_{i}" for i in range(REGIMES)]]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(wide).drop(*[f"_hot_{i}" for i in range(REGIMES)])


class Fitted(NamedTuple):
    """A fitted estimator: its prediction, or the mean and spread (forest) or probability (classifier)."""

    model: trees.Model
    prediction: str

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.prediction, trees.outputs({0: [self.model]}, by=F.lit(0))[0])


class Estimator(NamedTuple):
    """Trees to fit on ``features`` and a label; several are fitted in the same passes by ``trees.fit``."""

    spec: trees.Spec
    label: str
    weight: str | None = None
    prediction: str = "prediction"

    def getMaxIter(self) -> int:
        return self.spec.trees

    def group(self, where: Column) -> trees.Group:
        return trees.Group(where, [F.col(self.label)], [self.spec], F.col(self.weight) if self.weight else None)

    def fit(self, df: DataFrame) -> Fitted:
        return Fitted(trees.fit(df, [self.group(F.lit(True))], hot=REGIMES)[0][0], self.prediction)


def boosted(label: str, iterations: int = 20, depth: int = 5, seed: int = 42, weight: str | None = None, prediction: str = "prediction") -> Estimator:
    """Gradient-boosted trees (M2)."""
    return Estimator(trees.Spec("squared", iterations, depth, 0.2, seed), label, weight, prediction)


def forest(label: str, trees: int = 20, depth: int = 8, seed: int = 42) -> Estimator:
    """Random forest: mean and population std over its trees (M3)."""
    return Estimator(Spec("forest", trees, depth, seed=seed), label)


def classifier(label: str, iterations: int = 10, depth: int = 4, seed: int = 42, weight: str | None = None) -> Estimator:
    """Boosted binary classifier (M4): probability of label 1."""
    return Estimator(trees.Spec("log", iterations, depth, 0.1, seed), label, weight)


def fit_folds(rows: DataFrame, estimator: Estimator, where: Sequence[Column]) -> dict[int, list[trees.Model]]:
    """One model per condition, all fitted in the same passes."""
    found = trees.fit(rows, [estimator.group(w) for w in where], hot=REGIMES)
    return dict(enumerate(found))


def isotonic(train: DataFrame, score: str, label: str):
    """Isotonic recalibration (T11): equal scores are averaged and weighted first."""
    ties = train.groupBy(F.col(score).alias("_x")).agg(F.avg(F.col(label).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    return IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="_iso").fit(ties)


def apply_isotonic(model, df: DataFrame, score: str, name: str) -> DataFrame:
    out = model.setFeaturesCol(score).transform(df)
    return out.withColumn(name, F.least(F.greatest("_iso", F.lit(0.0)), F.lit(1.0))).drop("_iso")


def _pool(points: Iterator[tuple[float, float, float, float]]) -> list[list[float]]:
    """Adjacent blocks (first x, last x, sum, weight) in order of x, pooled until their means rise."""
    out: list[list[float]] = []
    for first, last, total, weight in points:
        while out and out[-1][2] * weight >= total * out[-1][3]:
            first, before, more = out[-1][0], out[-1][2], out.pop()[3]
            total, weight = total + before, weight + more
        out.append([first, last, total, weight])
    return out


def isotonic_curves(train: DataFrame, by: Sequence[str], score: str, label: str) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Isotonic recalibration of every group in one pass (T11): by -> scores and fitted values to interpolate between.

    Equal scores are averaged and weighted first. Ranges of scores are pooled in their tasks; only their blocks, which are few, meet by group.
    """
    by, blocks = list(by), ["_x0", "_x1", "_s", "_w"]
    ties = train.where(F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("_x0")).agg(F.sum(F.col(label).cast("double")).alias("_s"), F.count(F.lit(1)).cast("double").alias("_w"))
    ties = ties.select(*by, "_x0", F.col("_x0").alias("_x1"), "_s", "_w")

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(by, sort=False):
                new = zip(*(rows[c].to_numpy().tolist() for c in blocks))
                held[key] = _pool(chain(held.get(key, []), new))
        for key, rows in held.items():
            yield pd.DataFrame([[*key, *r] for r in rows], columns=[*by, *blocks])

    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ties.repartitionByRange(parts, *by, "_x0").sortWithinPartitions(*by, "_x0").mapInPandas(pooled, ties.schema)
    whole = lambda pdf: next(pooled(iter([pdf.sort_values("_x0")])))
    found: dict[tuple, tuple[list, list]] = {}
    for r in ranges.groupBy(*by).applyInPandas(whole, ties.schema).orderBy(*by, "_x0").collect():
        xs, ys = found.setdefault(tuple(r[c] for c in by), ([], []))
        for x in dict.fromkeys((r["_x0"], r["_x1"])):
            xs.append(x)
            ys.append(r["_s"] / r["_w"])
    return {key: (np.array(xs), np.array(ys)) for key, (xs, ys) in found.items()}


def recalibrated(df: DataFrame, curves: dict[tuple, tuple[np.ndarray, np.ndarray]], by: Sequence[str], score: str, name: str) -> DataFrame:
    """Add the score recalibrated by its group's curve, between 0 and 1."""

    @F.pandas_udf("double")
    def run(x: pd.Series, *keys: pd.Series) -> pd.Series:
        at, out = x.to_numpy(float), np.full(len(x), np.nan)
        for key, rows in pd.DataFrame(dict(enumerate(keys))).groupby(list(range(len(keys)))).indices.items():
            key = key if isinstance(key, tuple) else (key,)
            if key not in curves:
                raise ValueError(f"no rows to calibrate {key} on")
            out[rows] = np.interp(at[rows], *curves[key])
        return pd.Series(np.clip(out, 0.0, 1.0))

    return df.withColumn(name, run(F.col(score), *[F.col(c) for c in by]))


def each_fold(k: int, run: Callable[[int], DataFrame]) -> DataFrame:
    """Run a fold function for every fold from a small driver pool and union the results."""
    with ThreadPoolExecutor(max_workers=min(k, FOLD_THREADS)) as pool:
        parts = list(pool.map(run, range(k)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def cross_predict(rows: DataFrame, k: int, estimator: Callable[[], Estimator], name: str = "y_pred") -> DataFrame:
    """Fit on role fit, predict cal and test rows of the same fold; all folds are fitted together."""
    models = fit_folds(rows, estimator(), [(F.col("fold") == i) & (F.col("role") == "fit") for i in range(k)])
    return rows.where((F.col("role") != "fit") & F.col("fold").between(0, k - 1)).withColumn(name, trees.outputs(models, by=F.col("fold"))[0])


def inner_folds(df: DataFrame, k: int, inner: int, seed: int, by: str = "fold") -> DataFrame:
    """Columns ``_in0``, ... : the inner fold of each row among the rows outside fold 0, ...; NULL inside it."""
    for i in range(k):
        outside = df.where(F.col(by) != i)
        cells = cut_lineage(folds.balanced_folds(folds.cell_counts(outside), inner, seed)).select(*folds.CELL, F.col("fold").alias("_cell"))
        df = df.join(checked_broadcast(cells, folds.MAX_LEVEL2_CELLS), folds.CELL, "left")
        df = df.withColumn(f"_in{i}", F.when(F.col(by) != i, F.col("_cell"))).drop("_cell")
    return df


def nested_out_of_bag(rows: DataFrame, k: int, estimator: Estimator, inner: int, seed: int, also: Sequence[trees.Group] = ()) -> tuple[DataFrame, list[trees.Model], list]:
    """Out-of-bag predictions inside the complement of every fold, and a model of each whole complement.

    Returns the rows with ``_oob0``, ... (NULL inside fold 0, ...), the k models of the complements,
    and the models of the groups ``also``. Every model is fitted in the same passes.
    """
    rows = inner_folds(rows, k, inner, seed)
    where = [(F.col("fold") != i) & (F.col(f"_in{i}") != j) for i in range(k) for j in range(inner)]
    where += [F.col("fold") != i for i in range(k)]
    found = trees.fit(rows, [*[estimator.group(w) for w in where], *also], hot=REGIMES)
    for i in range(k):
        bag = {j: found[i * inner + j] for j in range(inner)}
        rows = rows.withColumn(f"_oob{i}", F.when(F.col("fold") != i, trees.outputs(bag, by=F.col(f"_in{i}"))[0]))
    rows = cut_lineage(rows)
    bad = rows.where(" or ".join(f"(fold <> {i} and (_oob{i} is null or isnan(_oob{i})))" for i in range(k))).count()
    if bad:
        raise ValueError(f"{bad} rows have no out-of-bag prediction")
    return rows, [found[k * inner + i][0] for i in range(k)], found[k * (inner + 1):]


def residual_hybrid(rows: DataFrame, k: int, teacher: Callable[[], Estimator], student: Callable[[], Estimator], target: str, key: str,
                    inner: int = 2, seed: int = 42) -> DataFrame:
    """A teacher plus a student of what it misses (M8): key, fold, base_pred, y_pred of every row, by models of the other folds.

    ``student`` fits the column ``_res`` on out-of-bag residuals. Residuals add up on the raw scale
    only, so a log target is refused.
    """
    if target.startswith("log"):
        raise ValueError("residuals add up on the raw scale: give the untransformed target")
    oob, whole, _ = nested_out_of_bag(rows, k, teacher(), inner, seed)
    second = student()
    groups = [trees.Group(F.col("fold") != i, [F.col(target) - F.col(f"_oob{i}")], [second.spec]) for i in range(k)]
    extra = trees.fit(oob, groups, hot=REGIMES)
    p = F.col("_p")
    wide = rows.withColumn("_p", trees.outputs({i: [whole[i], extra[i][0]] for i in range(k)}, by=F.col("fold")))
    return wide.select(key, "fold", p[0].alias("base_pred"), (p[0] + p[whole[0].width]).alias("y_pred"))


def out_of_bag(df: DataFrame, estimator: Callable[[], Estimator], k: int, seed: int, name: str = "base_pred") -> DataFrame:
    """Prediction of every row by a model that saw none of its mesh cell.

    Inner folds partition the cells, so every row is predicted once; a shortfall is an error.
    """
    cells = cut_lineage(folds.balanced_folds(folds.cell_counts(df), k, seed))
    rows = folds.with_fold(df.drop("fold"), cells).withColumnRenamed("fold", "_inner")
    models = fit_folds(rows, estimator(), [F.col("_inner") != i for i in range(k)])
    given, predicted = df.count(), rows.where(F.col("_inner").between(0, k - 1)).count()
    if given != predicted:
        raise ValueError(f"{given - predicted} of {given} rows have no out-of-bag prediction")
    return rows.withColumn(name, trees.outputs(models, by=F.col("_inner"))[0]).drop("_inner")


def boosted_quantiles(rows: DataFrame, label: str, taus: dict[str, float], stages: int = 3, depth: int = 4, rate: float = 0.5,
                      fit: Column | None = None, seed: int = 42, by: str | None = None, k: int = 1) -> DataFrame:
    """Quantile regression by boosting on the pinball gradient (M5).

    Each stage fits one tree per quantile to its gradient and sets its leaves to the exact residual
    quantile of their rows. All rows get a prediction; only rows where ``fit`` holds are learned from.
    With ``by``, each of its values 0..k-1 has models of its own, fitted in the same passes.
    """
    fit, own = fit if fit is not None else F.lit(True), F.col(by) if by else F.lit(0)
    specs = [trees.Spec("pinball", stages, depth, rate, seed, tau) for tau in taus.values()]
    models = trees.fit(rows, [trees.Group(fit & (own == i), [F.col(label)], specs) for i in range(k)], hot=REGIMES)
    out = rows.withColumn("_q", trees.outputs(dict(enumerate(models)), by=own))
    return out.withColumns({n: F.col("_q")[i] for i, n in enumerate(taus)}).drop("_q")


def hurdle(rows: DataFrame, k: int, seed: int = 42, iterations: int = 5, stiff: float = 30.0, min_component: int = 50, keep: Sequence[str] = ()) -> DataFrame:
    """Hurdle model of every fold 0..k-1 (M9): rows with role test and part train, iso or conf.

    P(stiff) with isotonic recalibration, a soft and a stiff regressor, and a single regressor for
    comparison; mixture mean and variance with component variances from held-out conf rows
    (pooled below ``min_component`` rows). Gives fold, part, y_true, the columns ``keep`` and p_stiff,
    mu_soft, mu_stiff, y_pred, y_std, y_single of conf and test rows. The 4 k models are fitted in the same passes.
    """
    rows = rows.withColumn("is_stiff", (F.col("n_value") >= stiff).cast("double"))
    train = F.col("part") == "train"
    rates = {r["fold"]: r["r"] or 0.0 for r in rows.where(train).groupBy("fold").agg(F.avg("is_stiff").alias("r")).collect()}  # a row per fold
    value, fitted = boosted("n_value", iterations, seed=seed), []
    for i in range(k):
        here, rate = train & (F.col("fold") == i), rates.get(i, 0.0)
        up = max(1.0, (1 - rate) / rate) if 0 < rate < 0.2 else 1.0
        weight = F.when(F.col("is_stiff") == 1, up).otherwise(1.0)
        fitted += [classifier("is_stiff", iterations, seed=seed).group(here)._replace(weight=weight), value.group(here & (F.col("is_stiff") == 0)),
                   value.group(here & (F.col("is_stiff") == 1)), value.group(here)]
    found = [m[0] for m in trees.fit(rows, fitted, hot=REGIMES)]
    names = ["p_raw", "mu_soft", "mu_stiff", "y_single"]
    held = rows.where(F.col("part") != "train").withColumn("_m", trees.outputs({i: found[4 * i : 4 * i + 4] for i in range(k)}, by=F.col("fold")))
    held = cut_lineage(held.select("fold", "part", "n_value", "is_stiff", *keep, *[F.col("_m")[i].alias(n) for i, n in enumerate(names)]))

    curves = isotonic_curves(held.where("part = 'iso'"), ["fold"], "p_raw", "is_stiff")
    out = recalibrated(held.where("part <> 'iso'"), curves, ["fold"], "p_raw", "p_stiff")
    p = F.col("p_stiff")
    out = out.withColumn("y_pred", (1 - p) * F.col("mu_soft") + p * F.col("mu_stiff"))
    conf = out.where("part = 'conf'")
    soft_r, stiff_r = F.col("n_value") - F.col("mu_soft"), F.col("n_value") - F.col("mu_stiff")
    pooled = F.var_pop(F.col("n_value") - F.col("y_pred"))
    is_s = F.col("is_stiff") == 1
    v = conf.groupBy("fold").agg(F.when(F.count(F.when(~is_s, 1)) >= min_component, F.var_pop(F.when(~is_s, soft_r))).otherwise(pooled).alias("_soft"),
                                 F.when(F.count(F.when(is_s, 1)) >= min_component, F.var_pop(F.when(is_s, stiff_r))).otherwise(pooled).alias("_stiff"))
    out = out.join(checked_broadcast(v, folds.MAX_FOLDS), "fold", "left")
    gap, zero = F.col("mu_stiff") - F.col("mu_soft"), F.lit(0.0)
    var = p * F.coalesce("_stiff", zero) + (1 - p) * F.coalesce("_soft", zero) + p * (1 - p) * gap * gap
    out = out.withColumn("y_std", F.sqrt(F.greatest(var, F.lit(1e-9)))).withColumn("y_true", F.col("n_value"))
    return out.drop("_soft", "_stiff")


def evaluate(pred: DataFrame, alpha: float = 0.95, group: str = "regime_code") -> DataFrame:
    """Per-fold errors and coverage of a point model: scale fallback, group radii, one plan."""
    scale = cal.scale_fallback(pred.where("role = 'cal'"), ["fold"])
    rows = pred.drop("y_std").join(checked_broadcast(scale, folds.MAX_FOLDS), "fold")
    radii = cal.mondrian_radii(cal.with_score(rows.where("role = 'cal'")), group, [alpha], ["fold"])
    test = cal.with_group_radius(rows.where("role = 'test'"), radii, group, ["fold"])
    r = errors.residual()
    hit = F.abs(r) <= F.col("radii")[0]["q"] * F.col("y_std")
    stiff = F.col("y_true") >= 30
    return test.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_test"), errors.rmse(r).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.stddev_pop("y_true").alias("target_sd"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.when(stiff, F.when(hit, 1.0).otherwise(0.0))).alias("coverage_stiff"))


def permutation_importance(models: dict[int, list[trees.Model]], rows: DataFrame, groups: Sequence[Sequence[str]], key: str, features: Callable[[DataFrame], DataFrame],
                           label: str = "n_value", seed: int = 7) -> DataFrame:
    """Rise in RMSE of every fold's model on the fold's rows after shuffling each group of columns with one permutation.

    Rows are ranked once: all groups read their columns of the same partner.
    """
    mine = {c: f"_s_{c}" for cols in groups for c in cols}
    both = rows.drop("features").withColumns({s: F.col(c) for c, s in mine.items()})
    both = cut_lineage(errors.shuffled_columns(both, list(mine.values()), key, seed, by=["fold"]))
    r = F.col(label) - F.col("_p")

    def scored(df: DataFrame, name: str) -> DataFrame:
        return features(df).withColumn("_p", trees.outputs(models, by=F.col("fold"))[0]).groupBy("fold").agg(errors.rmse(r).alias(name))

    base = scored(both, "_base")
    parts = [scored(both.withColumns({c: F.col(mine[c]) for c in cols}), "rmse").withColumn("columns", F.lit("+".join(cols))) for cols in groups]
    out = reduce(lambda a, b: a.unionByName(b), parts).join(checked_broadcast(base, folds.MAX_FOLDS), "fold")
    return out.select("columns", "rmse", (F.col("rmse") - F.col("_base")).alias("rise"), "fold")

"""Numerics of the fitted models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundsieve.operators import kriging, learn, survival as sv


def test_kriging_interpolates_and_reverts():
    xs = np.array([[[0.0], [1.0], [2.0], [3.0]]])
    ys = np.array([[1.0, 2.0, 3.0, 4.0]])
    near, sd_near = kriging.krige_batch(np.array([[1.5]]), xs, ys)
    far, sd_far = kriging.krige_batch(np.array([[500.0]]), xs, ys)
    assert near[0] == pytest.approx(2.5, abs=0.3) and far[0] == pytest.approx(2.5, abs=1e-6) and sd_far[0] > sd_near[0]


def test_local_update_leaves_far_queries_alone(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 2.0), (2, 99.0, 0.0, 5.0, 2.0)], "k long, x double, y double, y_pred double, y_std double")
    o = spark.createDataFrame([(7, 0.1, 0.0, 9.0, 5.0, 1.0), (8, 0.2, 0.1, 9.0, 5.0, 1.0)], "k long, x double, y double, y_true double, y_pred double, y_std double")
    got = {r["k"]: r for r in kriging.residual_update(q, o, key="k", point_key="k", coords=["x", "y"], radius=3.0, max_points=8).collect()}
    assert got[2]["mean"] == 5.0 and got[2]["std"] == 2.0 and not got[2]["updated"]
    assert 5.0 < got[1]["mean"] < 9.5 and got[1]["updated"] and got[1]["std"] >= 2.0


def test_cox_is_the_penalised_maximum(spark):
    rng = np.random.default_rng(4)
    n = 250
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(8 * np.exp(-0.7 * x[:, 0] + 0.3 * x[:, 1])))
    e = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"surv_time": t, "surv_event": e, "a": x[:, 0], "b": x[:, 1]}))
    model = sv.cox(df, ["a", "b"], steps=6)
    z = (x - x.mean(0)) / x.std(0, ddof=1)

    def loglik(beta):
        eta, out = z @ beta, 0.0
        for u in np.unique(t[e == 1]):
            d = (t == u) & (e == 1)
            s, tied = np.exp(eta[t >= u]).sum(), np.exp(eta[d]).sum()
            out += eta[d].sum() - sum(np.log(s - j / d.sum() * tied) for j in range(d.sum()))
        return out - 0.5 * sv.PENALTY * n * beta @ beta

    best = loglik(model.beta)
    for step in (np.array([1e-3, 0]), np.array([0, 1e-3])):
        assert loglik(model.beta + step) < best + 1e-9 and loglik(model.beta - step) < best + 1e-9
    assert model.beta[0] > 0.3 > 0 > model.beta[1]


def test_boosting_beats_the_mean_and_quantiles_are_ordered(spark, small):
    from groundsieve.plans import learned

    rows = learned.fold_layout(learned.feature_rows(spark, small), 1).persist()
    test = learn.cross_predict(rows, 1, lambda: learn.boosted("n_value", 5, 2)).where("role = 'test'")
    r = F.col("n_value") - F.col("y_pred")
    got = test.agg(F.sqrt(F.avg(r * r)).alias("rmse"), F.stddev_pop("n_value").alias("sd")).first()
    assert got["rmse"] < got["sd"]
    q = learn.boosted_quantiles(rows, "n_value", {"lo": 0.1, "hi": 0.9}, stages=1, fit=F.col("role") == "fit").where("role = 'test'")
    c = q.agg(F.avg((F.col("n_value").between(F.col("lo"), F.col("hi"))).cast("double")).alias("c")).first()["c"]
    assert 0.6 < c <= 1.0


def test_fits_refuse_tables_with_many_gaps(spark, small, monkeypatch):
    """More than a fifth of the rows without a covariate stops the feature frame; fewer are dropped."""
    from groundsieve.plans import inputs, learned

    whole = inputs.predictions(spark, small)
    gap = lambda m: lambda *_: whole.withColumn("coast_distance_km", F.when(F.col("row_key") % 100 >= m, F.col("coast_distance_km")))
    monkeypatch.setattr(inputs, "predictions", gap(40))
    with pytest.raises(ValueError):
        learned.feature_rows(spark, small)
    monkeypatch.setattr(inputs, "predictions", gap(5))
    assert learned.feature_rows(spark, small).count() == whole.where("row_key % 100 >= 5").count()


def test_local_update_of_all_folds_is_that_of_each(spark):
    """One search that leaves out the own fold, split into several groups of candidates; neighbours are not shuffled to the solve."""
    rng = np.random.default_rng(8)
    n = 240
    p = pd.DataFrame({"k": np.arange(n), "fold": np.arange(n) % 3, "x": rng.random(n) * 9, "y": rng.random(n) * 9, "y_true": rng.normal(size=n), "y_pred": 0.0, "y_std": 1.0})
    df = spark.createDataFrame(p)
    args = dict(key="k", point_key="k", coords=["x", "y"], radius=3.0, max_points=6)
    got = kriging.residual_update(df, df, exclude="fold", **args).toPandas().set_index("k").sort_index()
    each = [kriging.residual_update(df.where(F.col("fold") == i), df.where(F.col("fold") != i), **args).toPandas() for i in range(3)]
    want = pd.concat(each).set_index("k").sort_index()
    assert len(got) == n and np.allclose(got["mean"], want["mean"]) and np.allclose(got["std"], want["std"])
    near = kriging.local_kriging(df, df, 6, key="k", point_key="k", coords=["x", "y"], value="y_true", exclude="fold")
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroups")[0]


def test_isotonic_curves_of_all_groups_equal_one_fit_each(spark):
    """One pass for every group gives what a fit of its own gives, between and beyond the scores it has seen."""
    from groundsieve.operators import learn

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "h": "a", "p": np.round(rng.random(3000), 3)})
    pdf["y"] = (rng.random(3000) < pdf.p ** (1 + pdf.g)).astype(int)
    pdf.loc[pdf.g == 2, "p"] = 0.25  # one score only
    df = spark.createDataFrame(pdf)
    new = spark.createDataFrame(pd.DataFrame({"i": np.arange(900), "g": np.arange(900) % 3, "h": "a", "p": rng.random(900) * 1.2 - 0.1}))
    got = learn.recalibrated(new, learn.isotonic_curves(df, ["g", "h"], "p", "y"), ["g", "h"], "p", "q").toPandas().set_index("i").q
    for g in range(3):
        want = learn.apply_isotonic(learn.isotonic(df.where(F.col("g") == g), "p", "y"), new.where(F.col("g") == g), "p", "q").toPandas().set_index("i").q
        np.testing.assert_allclose(got.loc[want.index], want, atol=1e-12)
    with pytest.raises(Exception, match="no rows to calibrate"):
        learn.recalibrated(new, learn.isotonic_curves(df.where("g > 0"), ["g", "h"], "p", "y"), ["g", "h"], "p", "q").collect()

"""Exact ranks and quantiles, with crowded values and groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundsieve.functions import ordered as od
from groundsieve.operators import calibration as cal


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 0 holds most rows; in it one value holds a third of all rows."""
    rng = np.random.default_rng(3)
    g = np.where(rng.random(3000) < 0.8, 0, rng.integers(1, 5, 3000))
    v = np.round(rng.normal(size=3000), 2)
    v[:1000] = 0.25
    g[:1000] = 0
    pdf = pd.DataFrame({"g": g, "v": v, "k": np.arange(3000), "w": rng.integers(0, 4, 3000)})
    return spark.createDataFrame(pdf).repartition(4), pdf


def test_row_numbers(skewed):
    df, pdf = skewed
    for desc in (False, True):
        got = od.row_numbers(df, ["g"], "v", "k", descending=desc).toPandas().set_index("k")["rn"].sort_index()
        want = pdf.sort_values(["v", "k"], ascending=[not desc, True]).groupby("g").cumcount() + 1
        assert (got == want.sort_index()).all()


def test_running_totals(skewed):
    df, pdf = skewed
    got = od.running_totals(od.value_counts(df, [], "v", {"w": F.col("w")}), [], "v", ["n", "w"]).toPandas().sort_values("v")
    want = pdf.groupby("v")["w"].agg(["size", "sum"]).cumsum()
    assert (got["cum_n"].to_numpy() == want["size"].to_numpy()).all()
    assert (got["cum_w"].to_numpy() == want["sum"].to_numpy()).all()


def test_quantiles(skewed):
    df, pdf = skewed
    got = od.quantiles(df, ["g"], "v", {"a": 0.025, "b": 0.5, "c": 0.95}).toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(sub["v"], [0.025, 0.5, 0.95]))


@pytest.mark.parametrize("n, alpha, q", [(19, 0.95, 19), (5, 0.95, 5), (100, 0.5, 51)])
def test_order_statistic(spark, n, alpha, q):
    df = spark.range(1, n + 1).select(F.col("id").cast("double").alias("score"))
    assert cal.conformal_radii(df, [alpha]).first()["q"] == q


def test_mondrian_fallback(spark):
    df = spark.range(59).select(F.when(F.col("id") < 29, 1).otherwise(2).alias("g"), F.col("id").cast("double").alias("score"))
    radii = cal.mondrian_radii(df, "g", [0.9])
    assert {r["stratum"] for r in radii.collect()} == {"*", "2"}
    test = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 1.0)], "g int, y_true double, y_pred double, y_std double")
    got = {r["g"]: r["radii"][0]["q"] for r in cal.with_group_radius(test, radii, "g").collect()}
    assert got[1] == got[3] == 53.0 and got[2] == 56.0  # ceil(60 * .9) = 54th of all; ceil(31 * .9) = 28th of group 2


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 1.0), (0, 3.0, 2.0), (1, 5.0, 0.0), (1, 4.0, 0.0)], "g int, v double, w double")
    got = {r["g"]: r["q"] for r in cal.weighted_quantile(df, ["g"], "v", "w", 0.5).collect()}
    assert got == {0: 2.0, 1: 5.0}


def test_coverage_on_own_calibration_set(spark):
    df = spark.range(500).select(F.lit(0.0).alias("y_true"), ((F.col("id") * 37) % 101 / 10.0).alias("y_pred"), F.lit(1.5).alias("y_std"))
    scored = cal.with_score(df)
    for r in cal.conformal_radii(scored, [0.5, 0.9]).collect():
        assert scored.where(F.col("score") <= r["q"]).count() / 500 >= r["alpha"]


def test_std_must_be_positive(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0)], "y_true double, y_pred double, y_std double")
    with pytest.raises(Exception, match="strictly positive"):
        cal.with_score(df).collect()


def test_alpha_is_checked(spark):
    with pytest.raises(ValueError):
        cal.conformal_radii(spark.range(3).withColumn("score", F.lit(1.0)), [1.0])


@pytest.mark.parametrize("held", [10, 1_000_000])
def test_selection_by_strata_and_refinement(skewed, monkeypatch, held):
    """Strata and their marginal equal numpy, whether brackets are read at once or refined first."""
    monkeypatch.setattr(od, "HELD", held)
    monkeypatch.setattr(od, "SKETCH", 64)
    df, pdf = skewed
    rows = df.withColumn("side", F.col("k") % 2)
    got = {(r["side"], r["stratum"], r["alpha"]): (r["n_cal"], r["q"]) for r in od.order_statistics(rows, ["side"], "v", [0.3, 0.9], rollup="g").collect()}
    for side, part in pdf.groupby(pdf["k"] % 2):
        for name, sub in [("*", part), *((str(g), s) for g, s in part.groupby("g"))]:
            for a in (0.3, 0.9):
                k = min(max(int(np.ceil((len(sub) + 1) * a)), 1), len(sub))
                assert got.pop((side, name, a)) == (len(sub), np.sort(sub["v"].to_numpy())[k - 1])
    assert not got


def test_no_raw_rows_are_shuffled_by_group(spark, skewed):
    """Without automatic broadcasts, rows still meet their group's cuts by broadcast, and move by group and range."""
    df, _ = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = od.running_totals(od.value_counts(df, ["g"], "v"), ["g"], "v", ["n"])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan

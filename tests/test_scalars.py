"""Scalar functions, metrics and sources on small cases."""

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundsieve.functions import legend, numeric
from groundsieve.functions.ordered import row_numbers
from groundsieve.operators import errors, quality, thresholds as th
from groundsieve.sources import layers, measurements


def test_depth_bin_edges(spark):
    d = [0.0, 2.0, 5.0, 9.99, 10.0, 50.0]
    got = spark.createDataFrame([(v,) for v in d], "d double").select(numeric.depth_bin(F.col("d"))).collect()
    assert [r[0] for r in got] == [0, 1, 2, 2, 3, 5]


def test_normal_cdf_and_quantile(spark):
    z = [-9.0, -3.3, -1.0, 0.0, 0.5, 2.0, 8.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(numeric.normal_cdf(F.col("z"))).collect()]
    np.testing.assert_allclose(got, [0.5 * math.erfc(-v / math.sqrt(2)) for v in z], atol=1e-14)
    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(numeric.normal_quantile_col(F.col("p"))).collect()]
    np.testing.assert_allclose(got, [numeric.normal_quantile(v) for v in p], atol=1e-8)


def test_legend_rules(spark):
    rows = [("中新世〜鮮新世", "MIOCENE"), ("後期更新世", "LATE_PLEISTOCENE"), ("第四紀 更新世", "MIDDLE_PLEISTOCENE"), ("時代未詳", "OTHER"), ("  ", "UNKNOWN"), (None, "UNKNOWN")]
    got = spark.createDataFrame(rows, "a string, w string").select(legend.era_code(F.col("a")), "w").collect()
    assert all(legend.ERAS[r[0]] == r[1] for r in got)
    n = F.lit(None).cast("string")
    one = spark.range(1).select(legend.regime_code(n, n, n, n).alias("none"), legend.regime_code(F.lit("x"), F.lit("完新世"), F.lit("堆積岩"), F.lit("石灰岩")).alias("lime"),
                                legend.regime_code(F.lit("x"), F.lit(""), F.lit(" 付加体 "), F.lit("")).alias("group")).first()
    assert (one["none"], one["lime"], one["group"]) == (7, 6, 3)


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(i, float(p), y) for i, (p, y) in enumerate([(1.0, 1), (0.9, 1), (0.9, 0), (0.4, 1), (0.4, 0), (0.4, 0), (0.1, 0), (0.1, 1), (0.05, 0), (0.0, 0)])]
    return spark.createDataFrame(rows, "k int, p double, y int").withColumn("g", F.lit(0))


def test_auc_and_average_precision(scores):
    pdf = scores.toPandas()
    p, y = pdf["p"].to_numpy(), pdf["y"].to_numpy()
    diff = p[y == 1][:, None] - p[y == 0][None, :]
    assert th.roc_auc(scores, ["g"]).first()["auc"] == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())
    got = th.rank_metrics(scores, ["g"], [0.0, 0.2]).first()
    ap, tp, n = 0.0, 0, 0
    for v in sorted(set(p), reverse=True):
        new = y[p == v].sum()
        tp, n = tp + new, n + (p == v).sum()
        ap += new / y.sum() * tp / n
    assert got["average_precision"] == pytest.approx(ap)
    assert got["recall_at_fpr_0"] == pytest.approx(1 / 4) and got["recall_at_fpr_20"] == pytest.approx(2 / 4)


def test_one_class_has_no_auc(scores):
    assert th.roc_auc(scores.where("y = 0"), ["g"]).first()["auc"] is None


def test_net_benefit(scores):
    got = {r["threshold"]: r["net_benefit"] for r in th.net_benefit(scores, ["g"], [0.2, 1.0]).collect()}
    assert got[0.2] == pytest.approx(0.3 - 0.3 * 0.25) and got[1.0] is None


def test_ece_last_bin_is_closed(spark):
    df = spark.createDataFrame([(1.0, 1), (0.99, 1)], "p double, y int").withColumn("g", F.lit(0))
    assert th.ece(df, ["g"]).first()["ece"] == pytest.approx(0.005)


def test_top_k_rounds_half_to_even(spark):
    df = spark.range(50).select(F.lit(0).alias("g"), F.col("id").alias("k"), (F.col("id") / 50).alias("p"), (F.col("id") >= 48).cast("int").alias("y"))
    assert th.top_k_precision(df, ["g"], [0.05], "k").first()["precision_top_5"] == 1.0  # k = 2, not 3


def test_tempered_budgets(spark):
    counts = spark.createDataFrame([("a", 10000), ("b", 100), ("c", 4)], "g string, n long")
    got = {r["g"]: r["budget"] for r in quality.tempered_budgets(counts, "g", 200).collect()}
    assert got["c"] <= 4 and sum(got.values()) == 200 and got["a"] > got["b"] > got["c"]


def test_missing_guard_stops_a_fit(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") > 2, 1.0))
    with pytest.raises(ValueError):
        quality.require_complete(df, ["x"])


def test_csv_columns(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "a.csv")
    with open(path, "w") as f:
        f.write("n_value,latitude_deg,longitude_deg,spt_start_depth,extra\n5,35.5,139.5,1.0,x\n")
    r = measurements.read_csv(spark, path).first()
    assert (r["n_value"], r["mouth_elevation"]) == (5.0, 0.0)
    with open(path, "w") as f:
        f.write("n_value,latitude_deg\n5,35.5\n")
    with pytest.raises(KeyError):
        measurements.read_csv(spark, path)


def test_bad_geometry(spark):
    df = spark.createDataFrame([(1, '{"type":"Point","coordinates":[1,2]}')], "k int, j string")
    with pytest.raises(Exception, match="Polygon"):
        layers.polygon_vertices(df, "j", "k").collect()
    df = spark.createDataFrame([(1, '{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}')], "k int, j string")
    with pytest.raises(Exception, match="four positions"):
        layers.polygon_vertices(df, "j", "k").collect()


def test_shuffled_columns_is_a_permutation(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"), F.lit(1).alias("c"))
    pdf = errors.shuffled_columns(df, ["a", "b"], "k", 1).toPandas()
    assert sorted(pdf["a"]) == [2 * i for i in range(200)] and (pdf["a"] * 3 == pdf["b"] * 2).all() and (pdf["a"] != pdf["k"] * 2).sum() > 150


def test_legend_text_is_stripped_of_unicode_blanks(spark):
    got = spark.range(1).select(legend.regime_code(F.lit("x"), F.lit(""), F.lit("　付加体 "), F.lit("")).alias("wide"),
                                legend.regime_code(F.lit("x"), F.lit(""), F.lit("付加体"), F.lit("")).alias("plain"),
                                legend.regime_code(F.lit("　"), F.lit("　"), F.lit("　"), F.lit(" ")).alias("blank"),
                                legend.regime_code(F.lit(None).cast("string"), F.lit(""), F.lit(""), F.lit("")).alias("none")).first()
    assert got.wide == got.plain and got.blank == got.none


@pytest.mark.parametrize("n, values", [(1000, 40), (1000, 3), (7, 2), (300, 300)])
def test_equal_mass_slices_rank_only_the_values_that_an_edge_cuts(spark, monkeypatch, n, values):
    ranked = []

    def spied(df, *args, **kwargs):
        ranked.append(df.count())
        return row_numbers(df, *args, **kwargs)

    monkeypatch.setattr(th, "row_numbers", spied)
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"k": rng.permutation(n), "g": np.arange(n) % 2, "p": rng.integers(0, values, n) / values, "y": rng.integers(0, 2, n)})
    got = th.reliability_equal_mass(spark.createDataFrame(pdf), ["g"], "k").toPandas().set_index(["g", "bin"]).sort_index()
    pdf = pdf.sort_values(["g", "p", "k"])
    pdf["rn"], size = pdf.groupby("g").cumcount(), pdf.groupby("g")["k"].transform("size")
    pdf["bin"] = sum((i * size // 10 <= pdf["rn"]).astype(int) for i in range(1, 10))
    want = pdf.groupby(["g", "bin"]).agg(n=("k", "size"), mean_p=("p", "mean"), observed=("y", "mean"))
    assert got.index.equals(want.index.set_levels(got.index.levels[1], level=1)) and (got["n"] == want["n"]).all()
    np.testing.assert_allclose(got[["mean_p", "observed"]].to_numpy(), want[["mean_p", "observed"]].to_numpy())
    assert values < 40 or max(ranked) < 0.6 * n

"""Hand-computed profile cases."""

import pytest
from pyspark.sql import functions as F

from groundsieve.operators import profiles as pr

CASES = {
    "boundary": [(1, 29), (2, 30), (3, 50)],
    "never": [(1, 3), (2, 4)],
    "below_30m": [(29, 10), (31, 35)],
    "soft": [(1, 4), (2, 4), (3, 8), (4, 2), (10, 1), (11, 1)],
    "single_soft": [(5, 1)],
    "deep_only": [(12, 9)],
    "duplicate_depth": [(1, 2), (2, 3), (2, 9), (3, 1)],
}


@pytest.fixture(scope="module")
def ends(spark):
    rows, names = [], {}
    for i, (name, readings) in enumerate(CASES.items()):
        names[float(35 + i)] = name
        rows += [(35.0 + i, 139.0, float(d), float(n), 0, 1.0, 2.0, 10.0 - d, i * 100 + j) for j, (d, n) in enumerate(readings)]
    df = spark.createDataFrame(rows, "latitude_deg double, longitude_deg double, depth_from_surface double, n_value double, regime_code int, "
                                     "river_distance_km double, coast_distance_km double, absolute_elevation double, row_key long")
    out = pr.survival_table(pr.endpoints(df)).collect()
    return {names[r["latitude_deg"]]: r for r in out}


def test_first_crossing(ends):
    assert ends["boundary"]["depth_to_first_n30"] == 2 and ends["boundary"]["has_n30_within_30m"] == 1
    assert ends["never"]["depth_to_first_n30"] is None and ends["never"]["has_n30_within_30m"] == 0
    assert ends["below_30m"]["depth_to_first_n30"] == 31 and ends["below_30m"]["has_n30_within_30m"] == 0


def test_survival_columns(ends):
    assert (ends["never"]["surv_time"], ends["never"]["surv_event"]) == (2, 0)
    assert (ends["below_30m"]["surv_time"], ends["below_30m"]["surv_event"]) == (31, 1)


def test_soft_thickness(ends):
    assert ends["soft"]["soft_thickness_lt5_0_to_10m"] == 7  # 1-2 and 4-10; 11 m is outside the band
    assert ends["single_soft"]["soft_thickness_lt5_0_to_10m"] == 0
    # order is depth, then N: 1(2) 2(3) 2(9) 3(1): only 1-2 joins two soft neighbours
    assert ends["duplicate_depth"]["soft_thickness_lt5_0_to_10m"] == 1


def test_upper_10m(ends):
    assert ends["deep_only"]["mean_n_upper_10m"] is None and ends["deep_only"]["min_n_upper_10m"] is None
    assert ends["soft"]["min_n_upper_10m"] == 1


def test_static_value_is_shallowest(ends):
    assert ends["below_30m"]["absolute_elevation"] == 10.0 - 29


def test_mode_is_checked():
    with pytest.raises(ValueError):
        pr.first_crossing(30.0, "sideways")


def test_soft_thickness_of_a_crowded_borehole(spark):
    """One location with a third of all rows equals a plain walk over its readings."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 35.0).otherwise(36.0 + (F.col("id") % 50) / 100).alias("latitude_deg"), F.lit(139.0).alias("longitude_deg"),
        ((F.col("id") * 7919) % 1500 / 100.0).alias("depth_from_surface"), ((F.col("id") * 31) % 9).cast("double").alias("n_value"))
    got = {r[0]: r[2] for r in pr.soft_thickness(df).collect()}
    pdf = df.toPandas().sort_values(["latitude_deg", "depth_from_surface", "n_value"])
    for lat, g in pdf.groupby("latitude_deg"):
        z, n = g["depth_from_surface"].to_numpy(), g["n_value"].to_numpy()
        ok = (z >= 0) & (z <= 10) & (n < 5)
        want = (z[1:] - z[:-1])[ok[1:] & ok[:-1]].sum()
        assert got.get(lat, 0.0) == pytest.approx(want)


def test_profile_order_holds_nothing_per_borehole_on_the_driver(spark, monkeypatch):
    """More boreholes than a bounded list may name; readings without a depth come last."""
    from groundsieve.functions import ordered

    monkeypatch.setattr(ordered, "MAX_GROUPS", 3)
    nan = float("nan")
    rows = [(36.0 + h, 139.0, d, h * 100 + j) for h in range(8) for j, d in enumerate([7.0, 0.2, None, 7.0, nan, 31.5])]
    df = spark.createDataFrame(rows, "latitude_deg double, longitude_deg double, depth_from_surface double, row_key long")
    got = {r["row_key"]: (r["seq"], r["n_in_profile"]) for r in pr.profile_order(df).collect()}
    assert got == {h * 100 + j: (seq, 6) for h in range(8) for j, seq in enumerate([2, 1, 6, 3, 5, 4])}

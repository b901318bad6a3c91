"""Blocked spatial joins against brute force."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundsieve.functions import geo
from groundsieve.operators import layers as lay, nearest, pairs


def brute(q, p, keys, k):
    d2 = 0.0
    for j in range(q.shape[1]):
        d2 = d2 + (q[:, j][:, None] - p[:, j][None, :]) ** 2
    order = np.lexsort((np.broadcast_to(keys, d2.shape), d2), axis=1)[:, :k]
    return keys[order], np.sqrt(np.take_along_axis(d2, order, axis=1))


@pytest.fixture(scope="module")
def clustered():
    """A third of all points share one small town, some share one exact position."""
    rng = np.random.default_rng(1)
    p = rng.random((900, 2)) * 100
    p[:300] = 50 + np.round(rng.random((300, 2)), 1)
    p[:60] = [50.0, 50.0]
    q = np.vstack([rng.random((150, 2)) * 100, p[:50]])
    return q, p


@pytest.mark.parametrize("rows_per_tile, rows_per_group", [(50, 120), (4000, 200000)])
def test_knn_equals_brute_force(spark, clustered, rows_per_tile, rows_per_group):
    q, p = clustered
    qd = spark.createDataFrame(pd.DataFrame({"qk": np.arange(len(q)), "x": q[:, 0], "y": q[:, 1]}))
    pd_ = spark.createDataFrame(pd.DataFrame({"pk": np.arange(len(p)) * 3, "x": p[:, 0], "y": p[:, 1], "v": p[:, 0] * 2}))
    got = nearest.knn_join(qd, pd_, 7, query_key="qk", point_key="pk", coords=["x", "y"], payload=["v"],
                           rows_per_tile=rows_per_tile, rows_per_group=rows_per_group).toPandas().sort_values("qk")
    keys, dist = brute(q, p, np.arange(len(p)) * 3, 7)
    assert len(got) == len(q)
    np.testing.assert_array_equal(np.stack(got["neighbours"].to_numpy()), keys)
    np.testing.assert_allclose(np.stack(got["distances"].to_numpy()), dist)
    np.testing.assert_allclose(np.stack(got["v"].to_numpy()), p[keys // 3, 0] * 2)


def test_knn_with_fewer_points_than_k_and_cut_off(spark):
    qd = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "qk long, x double, y double")
    pt = spark.createDataFrame([(7, 1.0, 0.0), (8, 3.0, 0.0)], "pk long, x double, y double")
    rows = nearest.knn_join(qd, pt, 5, query_key="qk", point_key="pk", coords=["x", "y"]).collect()
    assert {r["qk"]: r["neighbours"] for r in rows} == {1: [7, 8], 2: [8, 7]}
    rows = nearest.knn_join(qd, pt, 5, query_key="qk", point_key="pk", coords=["x", "y"], max_distance=2.0).collect()
    assert {r["qk"]: r["neighbours"] for r in rows} == {1: [7]}


def test_idw_rows_equal_brute_force(spark, small):
    from groundsieve.plans import inputs, nearby

    got = nearby.idw_rows(spark, small).toPandas().set_index("row_key")["y_pred"]
    x, y = geo.local_km(F.col("latitude_deg"), F.col("longitude_deg"), 36.0, 139.7)
    pdf = inputs.predictions(spark, small).select("row_key", "fold", "n_value", x.alias("x"), y.alias("y"), (F.col("depth_from_surface") * 0.001).alias("z")).toPandas()
    te, tr = pdf[pdf.fold == 0], pdf[pdf.fold != 0]
    keys, dist = brute(te[["x", "y", "z"]].to_numpy(), tr[["x", "y", "z"]].to_numpy(), tr["row_key"].to_numpy(), 16)
    vals = tr.set_index("row_key")["n_value"].loc[keys.ravel()].to_numpy().reshape(keys.shape)
    w = 1 / np.maximum(dist, 1e-12) ** 2
    np.testing.assert_allclose(got.loc[te["row_key"]].to_numpy(), (w * vals).sum(1) / w.sum(1), rtol=1e-9)


def test_segment_distance(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 20.0, 5.0, 20.0, 5.0)], "sid long, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 5.0, 3.0), (2, -3.0, -4.0), (3, 20.0, 6.0)], "k long, x double, y double")
    got = nearest.knn_join(pts, seg, 1, query_key="k", point_key="sid", coords=["x", "y"], segments=["x1", "y1", "x2", "y2"])
    assert {r["k"]: r["distances"][0] for r in got.collect()} == {1: 3.0, 2: 5.0, 3: 1.0}


def test_empty_line_layer_is_an_error(spark):
    seg = spark.createDataFrame([], "line_id int, seq int, lat1 double, lon1 double, lat2 double, lon2 double")
    with pytest.raises(ValueError):
        lay.line_distance(spark.createDataFrame([(1, 35.0, 139.0)], "k long, latitude_deg double, longitude_deg double"), seg, "k", "km")


def test_polygon_code_equals_ray_casting(spark):
    rng = np.random.default_rng(5)
    polys = []
    for i in range(4):  # star-shaped rings that overlap
        a = np.sort(rng.random(40)) * 2 * np.pi
        r = 0.3 + 0.5 * rng.random(40)
        cx, cy = rng.random(2) * 1.5
        ring = np.stack([cx + r * np.cos(a), cy + r * np.sin(a)], axis=1)
        polys.append(np.vstack([ring, ring[:1]]))
    edges = [(i, 10 + i, 0, s, *map(float, ring[s]), *map(float, ring[s + 1])) for i, ring in enumerate(polys) for s in range(len(ring) - 1)]
    ed = spark.createDataFrame(edges, "poly_id int, code int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    pts = rng.random((300, 2)) * 2 - 0.25
    got = lay.polygon_code(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "k int, longitude_deg double, latitude_deg double"), ed, "k", -1)
    got = {r["k"]: r["code"] for r in got.collect()}
    for i, (px, py) in enumerate(pts):
        want = -1
        for j in reversed(range(4)):
            n = sum(((e[5] <= py) != (e[7] <= py)) and e[4] + (py - e[5]) / (e[7] - e[5]) * (e[6] - e[4]) > px for e in edges if e[0] == j)
            want = 10 + j if n % 2 else want
        assert got[i] == want


def test_utm_reference_point(spark):
    """35 N 139 E: the central-meridian distance and its mirror image."""
    e, n = geo.utm54(F.col("lat"), F.col("lon"))
    r = spark.createDataFrame([(35.0, 139.0), (35.0, 143.0), (35.0, 141.0)], "lat double, lon double").select(e.alias("e"), n.alias("n")).collect()
    assert r[0]["e"] + r[1]["e"] == pytest.approx(1_000_000, abs=1e-3) and r[0]["n"] == pytest.approx(r[1]["n"], abs=1e-3)
    assert r[2]["e"] == pytest.approx(500_000, abs=1e-3)
    e2 = geo.GRS80_F * (2 - geo.GRS80_F)
    phi = np.linspace(0, np.radians(35.0), 200001)
    f = geo.GRS80_A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5  # meridian radius of curvature
    arc = ((f[1:] + f[:-1]) / 2 * np.diff(phi)).sum()
    assert r[2]["n"] == pytest.approx(0.9996 * arc, abs=1e-3)


def test_concordance_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 400), "t": np.round(rng.random(400) * 20), "e": rng.integers(0, 2, 400), "r": np.round(rng.random(400), 1)})
    pdf.loc[:130, "t"] = 7.0  # a third of all rows at one time
    got = pairs.concordance(spark.createDataFrame(pdf), ["g"], "t", "e", "r").toPandas().set_index("g")
    for g, s in pdf.groupby("g"):
        t, e, r = (s[c].to_numpy() for c in "ter")
        ok = (t[:, None] < t[None, :]) & (e[:, None] == 1)
        assert got.loc[g, "pairs"] == ok.sum()
        assert got.loc[g, "concordant"] == (ok & (r[:, None] > r[None, :])).sum()
        assert got.loc[g, "tied_risk"] == (ok & (r[:, None] == r[None, :])).sum()


def test_registry_rejects_duplicates(spark):
    c = lay.Covariate("a", lambda df, n: df)
    with pytest.raises(ValueError):
        lay.apply_registry(spark.range(1), [c, c])


def test_knn_without_any_hit_and_without_coordinates(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, None, 0.0), (4, float("nan"), 1.0)], "k long, x double, y double")
    far = spark.createDataFrame([(9, 500.0, 500.0), (8, None, None)], "q long, x double, y double")
    args = dict(query_key="q", point_key="k", coords=["x", "y"])
    assert nearest.knn_join(far, points, 2, max_distance=1.0, **args).count() == 0
    got = nearest.knn_join(far, points, 3, **args).collect()
    assert [(r.q, r.neighbours) for r in got] == [(9, [2, 1])]


def test_lag_pairs_equal_brute_force_in_crowded_blocks(spark):
    import random

    r = random.Random(4)
    rows = [(k, r.uniform(0, 30) if k % 2 else r.uniform(0, 250), r.uniform(0, 250), r.random()) for k in range(120)]
    got = {g.lag: (g.n_pairs, round(g.gamma, 9)) for g in pairs.lag_pairs(spark.createDataFrame(rows, "k long, x double, y double, v double"), "k", "x", "y", "v", rows_per_part=7).collect()}
    want = {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            d = ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5
            if d < 100:
                n, s = want.get(int(d // 5), (0, 0.0))
                want[int(d // 5)] = (n + 1, s + (a[3] - b[3]) ** 2)
    assert got == {k: (n, round(s / n / 2, 9)) for k, (n, s) in want.items()}


def test_halo_of_several_cells_keeps_every_row(spark):
    from groundsieve.functions import mesh
    from groundsieve.operators import grids

    row, col = mesh.mesh_row(F.lit(36.02), 2), mesh.mesh_col(F.lit(139.5), 2)
    tile = mesh.with_bounds(spark.range(1).select(row.alias("mesh_row"), col.alias("mesh_col"), F.lit(1).cast("long").alias("tile_id")), 2).drop("lat_mid", "lon_mid")
    rows = spark.range(400).select("id", (F.lit(35.5) + F.col("id") / 400).alias("latitude_deg"), F.lit(139.5).alias("longitude_deg"))
    wide = grids.halo(tile, 30.0)
    b = wide.first()
    want = rows.where(F.col("latitude_deg").between(b.lat_min, b.lat_max)).count()
    assert grids.halo_rows(rows, wide).count() == want > 150


@pytest.mark.parametrize("max_tiles, rows_per_tile, rows_per_group", [(16, 20, 60), (65_536, 40, 100)])
def test_two_levels_and_exclusion_equal_brute_force(spark, clustered, monkeypatch, max_tiles, rows_per_tile, rows_per_group):
    """With few coarse tiles, fine ones are cut; every query meets the other folds only."""
    monkeypatch.setattr(nearest, "MAX_TILES", max_tiles)
    _, p = clustered
    fold = np.arange(len(p)) % 3
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(p)) * 3, "x": p[:, 0], "y": p[:, 1], "v": p[:, 0] * 2, "fold": fold}))
    got = nearest.knn_join(df, df, 5, query_key="k", point_key="k", coords=["x", "y"], payload=["v"], exclude="fold",
                           rows_per_tile=rows_per_tile, rows_per_group=rows_per_group).toPandas().set_index("k")
    assert len(got) == len(p)
    for f in range(3):
        q, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        keys, dist = brute(p[q], p[rest], rest * 3, 5)
        sub = got.loc[q * 3]
        np.testing.assert_array_equal(np.stack(sub["neighbours"].to_numpy()), keys)
        np.testing.assert_allclose(np.stack(sub["distances"].to_numpy()), dist)


def test_copies_do_not_grow_with_the_rows(spark, monkeypatch):
    """Block rows a row, where a coarse tile has 250 and where it has 2,000 rows."""
    monkeypatch.setattr(nearest, "MAX_TILES", 32)
    rng = np.random.default_rng(2)
    copies = []
    for n in (4_000, 32_000):
        df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "x": rng.random(n), "y": rng.random(n)}))
        blocks = nearest.met(df, df, 5, query_key="k", point_key="k", coords=["x", "y"], rows_per_tile=50)
        copies.append(blocks.right.count() / n)
    assert max(copies) < 20 and copies[1] < 1.25 * copies[0]


@pytest.mark.parametrize("rows_per_tile, rows_per_group, max_tiles", [(4000, 200000, 65_536), (40, 30, 65_536), (20, 25, 16)])
def test_kernel_quantiles_equal_brute_force(spark, clustered, monkeypatch, rows_per_tile, rows_per_group, max_tiles):
    """One block a query or many: the weighted quantile of every query with a point in reach."""
    monkeypatch.setattr(nearest, "MAX_TILES", max_tiles)
    q, p = clustered
    v = np.round(np.random.default_rng(8).random(len(p)), 2)
    qd = spark.createDataFrame(pd.DataFrame({"qk": np.arange(len(q)), "x": q[:, 0], "y": q[:, 1]}))
    pt = spark.createDataFrame(pd.DataFrame({"pk": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "v": v}))
    got = nearest.kernel_quantiles(qd, pt, "v", 0.8, bandwidth=1.0, cutoff=3.0, query_key="qk", point_key="pk", coords=["x", "y"],
                                   rows_per_tile=rows_per_tile, rows_per_group=rows_per_group).toPandas().set_index("qk")["q"]
    want = {}
    for i, at in enumerate(q):
        d2 = ((p - at) ** 2).sum(axis=1)
        near = np.flatnonzero(d2 <= 9.0)
        if len(near):
            near = near[np.argsort(v[near], kind="stable")]
            cum = np.cumsum(np.exp(-d2[near] / 2))
            want[i] = v[near][np.argmax(cum / cum[-1] >= 0.8)]
    assert got.to_dict() == want


def test_lag_sums_leave_out_leaves_that_are_too_far():
    """Against all pairs, among themselves and between two tiles; leaves beyond the reach cost nothing."""
    rng = np.random.default_rng(0)
    a, b = rng.random((700, 3)) * [180, 150, 10], rng.random((900, 3)) * [180, 150, 10] + [60, 0, 0]
    for x, y in ((a, b), (a, None)):
        other = x if y is None else y
        d = np.sqrt(((x[:, None, :2] - other[None, :, :2]) ** 2).sum(axis=2))
        e, take = (x[:, None, 2] - other[None, :, 2]) ** 2, d < 100
        if y is None:
            take &= np.triu(np.ones_like(take), 1)
        lag = np.floor(d[take] / 5).astype(int)
        n, total = pairs._lag_sums(x, y, 100.0, 5.0)
        assert (n == np.bincount(lag, minlength=20)).all() and np.allclose(total, np.bincount(lag, e[take], 20))
    n, _ = pairs._lag_sums(a, a + [10_000, 0, 0], 100.0, 5.0)
    assert not n.any()


def test_kernel_quantiles_write_no_sums(spark, monkeypatch, tmp_path):
    """What a search leaves in the shared folders follows its rows, however many points a query weighs."""
    n = 1_000
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "x": rng.random(n), "y": rng.random(n), "v": rng.random(n)}))
    nearest.cut_lineage(df)
    kept = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for at in (kept, tmp_path) for f in at.rglob("*") if f.is_file())
    monkeypatch.setattr(nearest, "shared_folder", lambda _: f"{tmp_path}/points", raising=False)
    before = size()
    out = nearest.kernel_quantiles(df, df, "v", 0.8, bandwidth=0.3, cutoff=5.0, query_key="k", point_key="k", coords=["x", "y"], rows_per_tile=100, rows_per_group=200)
    assert out.count() == n
    assert size() - before < 500 * n


def test_kernel_quantiles_list_few_values_at_a_time(spark, clustered, monkeypatch):
    """Equal values, which no cuts tell apart, are listed for a few queries at a time."""
    q, p = clustered
    qd = spark.createDataFrame(pd.DataFrame({"qk": np.arange(len(q)), "x": q[:, 0], "y": q[:, 1]}))
    pt = spark.createDataFrame(pd.DataFrame({"pk": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "v": np.where(np.arange(len(p)) % 10 > 0, 1.0, 2.0)}))
    wanted = dict(bandwidth=1.0, cutoff=3.0, query_key="qk", point_key="pk", coords=["x", "y"])
    want = nearest.kernel_quantiles(qd, pt, "v", 0.9, **wanted).toPandas().set_index("qk")["q"].to_dict()
    monkeypatch.setattr(nearest, "LISTED", 50, raising=False)
    got = nearest.kernel_quantiles(qd, pt, "v", 0.9, **wanted, rows_per_tile=20, rows_per_group=25).toPandas().set_index("qk")["q"].to_dict()
    assert got == want and set(got.values()) == {1.0, 2.0}


def test_kernel_weights_are_exact_and_cheap():
    """Twelve digits of exp(-d^2 / 2) inside the cut-off, a point at the cut-off included; far less work than a distance and an exponential a pair."""
    from time import perf_counter

    rng = np.random.default_rng(3)
    q, p = rng.random((64, 4)) + 1000, rng.random((2048, 4)) * 6 + 997
    p[0], p[1] = q[0], q[0] + [4, 0, 0, 0]
    weights = nearest._kernel(4.0)

    def plain():
        d2 = nearest._point_d2(q, p)
        return np.where(d2 <= 16.0, np.exp(-d2 / 2), 0.0)

    want, got = plain(), weights(q, p)
    assert want[0, 1] > 0 and (want == 0).any()
    np.testing.assert_allclose(got, want, rtol=1e-11)
    took = []
    for run in (plain, lambda: weights(q, p)):
        each = []
        for _ in range(15):
            t = perf_counter()
            run()
            each.append(perf_counter() - t)
        took.append(min(each))
    assert took[1] < 0.75 * took[0]


def test_lag_sums_of_trees_equal_brute_force_at_edges():
    """Rows that lie exactly on lag edges, a crowded place, one row, and far boxes: counts are equal, squares to rounding."""
    rng = np.random.default_rng(6)

    def rows(n, side, shift=0.0):
        out = np.c_[rng.random((n, 2)) * side + [shift, 0], rng.normal(size=n) * 10 + 1e4]
        out[: n // 5, :2] = np.round(out[: n // 5, :2] / 5) * 5
        return out

    for a, b in ((rows(1, 1), rows(700, 150)), (rows(900, 60), rows(1000, 60, 30)), (rows(600, 0), rows(600, 300)), (rows(500, 10), rows(500, 10, 140))):
        for other in (None, b):
            p, q = a, a if other is None else b
            d = np.sqrt((p[:, None, 0] - q[None, :, 0]) ** 2 + (p[:, None, 1] - q[None, :, 1]) ** 2)
            ok = (d < 100) & (np.arange(len(p))[:, None] < np.arange(len(q)) if other is None else True)
            lag = (d[ok] / 5).astype(int)
            n, total = pairs._lag_sums(a, other, 100.0, 5.0)
            np.testing.assert_array_equal(n, np.bincount(lag, minlength=20)[:20])
            np.testing.assert_allclose(total, np.bincount(lag, ((p[:, None, 2] - q[None, :, 2]) ** 2)[ok], 20)[:20], rtol=1e-9, atol=1e-6)


def test_lag_pairs_copy_no_points(spark):
    """A point is shuffled once, however many tiles it meets, and work grows more slowly than the pairs."""
    rows = spark.range(4000).selectExpr("id", "(id * 7919 % 4001) / 40.0 as x", "(id * 104729 % 4001) / 40.0 as y", "id % 13 as v")
    out = pairs.lag_pairs(rows, "id", "x", "y", "v", rows_per_part=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "Join" not in plan and "FlatMapGroupsInPandas" not in plan
    n = {r.lag: r.n_pairs for r in out.collect()}
    assert sum(n.values()) > 7_000_000
    rng, compared = np.random.default_rng(2), []
    leaves = pairs._leaf_pairs
    try:
        pairs._leaf_pairs = lambda a, b, i, *more: compared.append(len(i) * pairs.LEAF**2) or leaves(a, b, i, *more)
        a, b = (np.c_[rng.random((8000, 2)) * 8 + [x, 0], rng.random(8000)] for x in (0, 40))
        pairs._lag_sums(a, b, 100.0, 5.0)
    finally:
        pairs._leaf_pairs = leaves
    assert 0 < sum(compared) < 0.3 * 8000 * 8000

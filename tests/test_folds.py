"""Fold guarantees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundsieve.operators import folds, regions


@pytest.fixture(scope="module")
def cells(spark):
    df = spark.range(3000).select((F.lit(420) + F.col("id") % 9).alias("mesh_row"), (F.lit(308) + F.floor(F.col("id") / 9) % 7).alias("mesh_col"))
    crowd = spark.range(1500).select(F.lit(424).cast("long").alias("mesh_row"), F.lit(311).cast("long").alias("mesh_col"))  # a third of all rows in one cell
    return folds.cell_counts(df.union(crowd))


def test_balanced_folds_partition_cells(cells):
    got = folds.balanced_folds(cells, 3, 1).toPandas()
    assert len(got) == 63 and got["mesh_code"].is_unique and set(got["fold"]) == {0, 1, 2}
    load = got.groupby("fold")["n_rows"].sum()
    assert load.max() - load.min() <= got["n_rows"].max()


def test_fold_count_is_checked(cells):
    with pytest.raises(ValueError):
        folds.balanced_folds(cells, 1)
    with pytest.raises(Exception, match="cannot fill"):
        folds.balanced_folds(cells, 64).collect()


def test_no_cell_on_both_sides_and_calibration_reaches_target(cells):
    f = folds.balanced_folds(cells, 3, 1)
    roles = folds.fold_roles(f, 3, 0.2, 5).join(f.select("mesh_row", "mesh_col", "n_rows"), ["mesh_row", "mesh_col"]).toPandas()
    assert not roles.duplicated(["mesh_row", "mesh_col", "fold"]).any()
    for _, g in roles.groupby("fold"):
        train = g[g.role != "test"]
        assert g[g.role == "cal"]["n_rows"].sum() >= 0.2 * train["n_rows"].sum()


def test_buffered_train_is_a_strict_subset(spark, cells):
    f = folds.contiguous_folds(cells, 2, iterations=3)
    pdf = folds.usable_folds(f, 2, 1).toPandas()
    owner = {(r.mesh_row, r.mesh_col): r.fold for r in pdf.itertuples()}
    for r in pdf.itertuples():
        near = {owner.get((r.mesh_row + a, r.mesh_col + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)} - {None}
        assert set(r.usable) == {0, 1} - near
    s = folds.train_shrinkage(f, 2, 1).toPandas()
    assert (s["n_train"] < s["n_base"]).all() and (s["shrinkage_pct"] > 0).all()


def test_point_in_two_overlapping_regions(spark):
    df = spark.createDataFrame([(37.2, 140.0), (36.0, 140.0)], "latitude_deg double, longitude_deg double")
    got = {(r["latitude_deg"], r["fold"]): r["role"] for r in regions.region_folds(df).collect()}
    assert got[(37.2, "tohoku")] == got[(37.2, "kanto")] == "test" and got[(36.0, "tohoku")] == "train"


def test_unknown_prefecture(spark):
    df = spark.createDataFrame([(36.0, 139.0, "other")], "latitude_deg double, longitude_deg double, pref string")
    with pytest.raises(ValueError):
        regions.prefecture_folds(df, ["atlantis"])


def test_broadcast_size_is_checked(spark):
    from groundsieve.operators.small import checked_broadcast

    with pytest.raises(Exception, match="more than 5 rows"):
        spark.range(3).join(checked_broadcast(spark.range(10), 5), "id").collect()
    assert spark.range(3).join(checked_broadcast(spark.range(10), 10), "id").count() == 3


def test_buffer_that_empties_a_fold_is_an_error(spark):
    tiny = spark.createDataFrame([(424, c, 10, f) for c, f in ((311, 0), (312, 1), (313, 2))], "mesh_row int, mesh_col int, n_rows long, fold int")
    rows = tiny.select("mesh_row", "mesh_col", "fold")
    with pytest.raises(ValueError, match="no train cell"):
        folds.buffered_train(rows, tiny, 3, 2)


def test_restarted_folds_are_a_fixed_point_and_the_best_start(spark):
    """Nothing moves in one more step; no single start does better; ties in position share a fold."""
    rng = np.random.default_rng(6)
    pos = np.vstack([c + rng.normal(size=(40, 2)) * 0.4 for c in ((0, 0), (3, 0), (0, 3), (3.5, 3.5))]).round(3)
    pos[5] = pos[6]
    pdf = pd.DataFrame({"mesh_row": np.arange(len(pos)), "mesh_col": 0, "mesh_code": np.arange(len(pos)), "n_rows": 1, "a": pos[:, 0], "b": pos[:, 1]})
    cells = spark.createDataFrame(pdf)

    def inertia(fold):
        centres = np.array([pos[fold == k].mean(axis=0) for k in range(4)])
        d2 = ((pos[:, None] - centres[None]) ** 2).sum(-1)
        assert (d2.argmin(axis=1) == fold).all()
        return d2.min(axis=1).sum()

    fold = lambda **kw: folds.restarted_folds(cells, 4, y="a", x="b", **kw).toPandas().sort_values("mesh_row")["fold"].to_numpy()
    best = fold()
    assert best[5] == best[6]
    assert inertia(best) <= min(inertia(fold(seed=s, starts=1)) for s in range(3)) + 1e-6

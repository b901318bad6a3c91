"""Queries that once read a part of their tables or protocol."""

from pyspark.sql import functions as F

from groundsieve.operators import grids as gr, layers as lay
from groundsieve.plans import grids, inputs
from groundsieve.plans.ingest import line_features
from groundsieve.sources import layers as src


def test_coast_distance_is_that_of_the_nearest_line_of_any_group(spark, small):
    nodes, lines = gr.box_grid(inputs.measurements(spark, small), 40, 40), line_features(spark, small)
    groups = [r.pref for r in lines.select("pref").distinct().collect()]
    per = [{r["node"]: r["km"] for r in lay.line_distance(nodes, src.segments_from_lines(lines.where(F.col("pref") == g)), "node", "km").collect()} for g in groups]
    got = {r["node"]: r["coast_distance_km"] for r in grids.p12_coast_distance_grid(spark, small).collect()}
    assert len(groups) == 5 and got == {n: round(float(min(p[n] for p in per)), 3) for n in per[0]}


def test_every_fold_and_target_is_reported(spark, small, monkeypatch):
    from groundsieve.plans import learned

    monkeypatch.setattr(learned, "ITERATIONS", 1)
    n = inputs.predictions(spark, small).count()
    hurdle = learned.m9_hurdle(spark, small).collect()
    assert sorted(r.fold for r in hurdle) == [0, 1, 2] and sum(r.n_test for r in hurdle) == n
    assert {r.fold for r in learned.e12_permutation_importance(spark, small).select("fold").collect()} == {0, 1, 2}
    ends = {(r.target, r.fold) for r in learned.m10_endpoint_models(spark, small).select("target", "fold").collect()}
    assert ends == {(t, i) for t in ("depth_to_first_n30", "soft_thickness_lt5_0_to_10m", "mean_n_upper_10m", "min_n_upper_10m") for i in range(3)}
    parts = {(r.geometry, r.fold) for r in learned.m20_correction_sensitivity(spark, small).select("geometry", "fold").collect()}
    assert parts == {("dispersed", 0), ("dispersed", 1), ("dispersed", 2), ("contiguous", 0), ("contiguous", 1)}


class Stopped(Exception):
    pass


def test_queries_use_the_stages_of_their_operators(spark, small, monkeypatch):
    import inspect

    import pytest

    from groundsieve.operators import learn
    from groundsieve.plans import learned

    default = lambda f, name: inspect.signature(f).parameters[name].default
    stages, trees = default(learn.boosted_quantiles, "stages"), default(learn.boosted, "iterations")
    assert trees == default(learn.forest, "trees")

    def stop(value):
        raise Stopped(value)

    monkeypatch.setattr(learn, "boosted_quantiles", lambda *a, stages=stages, **k: stop(stages))
    monkeypatch.setattr(learn, "out_of_bag", lambda df, make, *a, **k: stop(make().getMaxIter()))
    monkeypatch.setattr(learn, "cross_predict", lambda rows, k, make: stop(make().getMaxIter()))
    for plan, want in ((learned.m5_quantile_boosting, stages), (learned.k11_out_of_bag, trees), (learned.m21_buffer_sweep, trees)):
        with pytest.raises(Stopped) as e:
            plan(spark, small)
        assert e.value.args == (want,)
    used = []
    monkeypatch.setattr(learn, "boosted", lambda label, iterations=trees, *a, **k: stop(iterations) if used.append(iterations) is None else None)
    monkeypatch.setattr(learn, "forest", lambda label, trees=trees, *a, **k: stop(trees) if used.append(trees) is None else None)
    with pytest.raises(Stopped):
        learned.m20_correction_sensitivity(spark, small)
    assert used and set(used) == {trees}


def test_contiguous_folds_stop_when_no_cell_moves(spark):
    from groundsieve.operators import folds

    cells = spark.range(400).select((430 + F.floor(F.col("id") / 20)).alias("mesh_row"), (310 + F.col("id") % 20).alias("mesh_col"), F.lit(1).cast("long").alias("n_rows"))
    cells = cells.withColumn("mesh_code", folds.pack(F.col("mesh_row"), F.col("mesh_col")))
    got = folds.contiguous_folds(cells, 5, seed=3, iterations=None).toPandas()
    y, x = (got.mesh_row + 0.5) / 12, (got.mesh_col + 0.5) / 8
    at = {f: (y[g].mean(), x[g].mean()) for f, g in got.groupby("fold").groups.items()}
    nearest = [min((round((a - cy) ** 2 + (b - cx) ** 2, 9), f) for f, (cy, cx) in at.items())[1] for a, b in zip(y, x)]
    assert len(got) == 400 and nearest == list(got.fold)

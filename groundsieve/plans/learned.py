"""Queries: fitted models and their protocols. Random parts make these rows-only checks."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from groundsieve.functions import geo, numeric
from groundsieve.functions.mesh import with_mesh
from groundsieve.functions.ordered import order_statistics, quantiles
from groundsieve.operators import calibration as cal, errors, folds, kriging, learn, profiles as pr, quality, thresholds as th, trees
from groundsieve.plans import inputs
from groundsieve.plans.flagship import cell_folds
from groundsieve.plans.nearby import holes
from groundsieve.plans.registry import query, rounded
from groundsieve.session import cut_lineage

ITERATIONS, QUANTILE_STAGES = 20, 3  # tree stages (or trees) of the registered queries: the operators' defaults
FOLDS = 3
TARGETS = ("n_value", "n_cn", "n_cn_cr")
COLS = ["row_key", "latitude_deg", "longitude_deg", "depth_from_surface", "absolute_elevation", "river_distance_km", "coast_distance_km",
        "regime_code", "n_value", "fold", "role", "mesh_row", "mesh_col"]


def feature_rows(spark, sf):
    """Feature vectors of all rows with complete covariates, spread evenly: a small input file is a single scan task."""
    rows = quality.require_complete(inputs.predictions(spark, sf, inputs.spread(spark, sf)).select(*COLS), [*learn.NUMERIC, "regime_code"])
    return learn.assemble(rows).withColumn("y_true", F.col("n_value"))


def fold_layout(rows, k: int = 3):
    """Every row once per fold with its role there."""
    out = rows.withColumnsRenamed({"fold": "_own", "role": "_role"}).withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    role = F.when(F.col("_own") == F.col("fold"), "test").when(F.col("_role") == "cal", "cal").otherwise("fit")
    return out.withColumn("role", role).drop("_own", "_role")


def all_folds(spark, sf):
    return fold_layout(feature_rows(spark, sf), FOLDS)


def held_out(run):
    """``run(i)`` for every fold i; its rows get the fold's number."""
    return learn.each_fold(FOLDS, lambda i: run(i).withColumn("fold", F.lit(i)))


@query("m2_boosted_regressor")
def m2_boosted_regressor(spark, sf):
    out = learn.cross_predict(all_folds(spark, sf), FOLDS, lambda: learn.boosted("n_value", ITERATIONS))
    return rounded(out.where("role = 'test'").select("row_key", "y_pred"), "y_pred")


@query("m3_forest_with_spread")
def m3_forest_with_spread(spark, sf):
    rows = feature_rows(spark, sf)
    models = learn.fit_folds(rows, learn.forest("n_value", trees=ITERATIONS, depth=6), [
        (F.col("fold") != i) & (F.col("role") != "cal") for i in range(FOLDS)])
    out = rows.withColumn("_m", trees.outputs(models, by=F.col("fold")))
    return rounded(out.select("row_key", F.col("_m")[0].alias("y_pred"), F.col("_m")[1].alias("y_std")), "y_pred", "y_std")


@query("m4_t11_classifier_isotonic")
def m4_t11_classifier_isotonic(spark, sf):
    """The four threshold labels on every fold: boosted classifier, class weight, isotonic on calibration cells; raw and
    recalibrated scores. The twelve classifiers are fitted in the same passes."""
    n = F.col("n_value")
    labels = {name: n < cut if side == "below" else n >= cut for name, (side, cut) in th.LABELS.items()}
    jobs = [(name, i) for name in labels for i in range(FOLDS)]
    rows = all_folds(spark, sf)
    outcome = F.array(*[F.struct(F.lit(name).alias("label"), y.cast("int").alias("y")) for name, y in labels.items()])
    weights = {(r["label"], r["fold"]): r["weight_positive"] for r in th.class_weights(
        rows.where("role = 'fit'").select("fold", F.inline(outcome)), ["label", "fold"]).collect()}
    groups = []
    for name, i in jobs:
        y = labels[name].cast("double")
        spec = learn.classifier("y").spec
        groups.append(trees.Group((F.col("fold") == i) & (F.col("role") == "fit"), [y], [spec], F.when(y == 1, weights[name, i]).otherwise(1.0)))
    found = [m[0] for m in trees.fit(rows, groups, hot=learn.REGIMES)]
    models = {i: [found[jobs.index((name, i))] for name in labels] for i in range(FOLDS)}
    scored = rows.where("role <> 'fit'").withColumn("_p", trees.outputs(models, by=F.col("fold")))
    each = F.array(*[F.struct(F.lit(name).alias("label"), labels[name].cast("int").alias("y"), F.col("_p")[j].alias("p_raw")) for j, name in enumerate(labels)])
    scored = cut_lineage(scored.select("fold", "role", F.inline(each)))

    curves = learn.isotonic_curves(scored.where("role = 'cal'"), ["label", "fold"], "p_raw", "y")
    test = learn.recalibrated(scored.where("role = 'test'"), curves, ["label", "fold"], "p_raw", "p_iso")
    both, by = test.select("label", "y", F.inline(F.array(F.struct(F.lit("raw").alias("score"), F.col("p_raw").alias("p")),
                                                          F.struct(F.lit("isotonic").alias("score"), F.col("p_iso").alias("p"))))), ["label", "score"]
    both = cut_lineage(both)
    out = th.brier_and_log_loss(both, by).join(th.ece(both, by), by).join(th.roc_auc(both, by), by)
    return rounded(out, "brier", "log_loss", "brier_skill", "ece", "auc")


TAUS = {"q025": 0.025, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q975": 0.975}


@query("m5_quantile_boosting")
def m5_quantile_boosting(spark, sf):
    """Five quantiles, conformalised on calibration rows: coverage and width before and after."""
    rows = all_folds(spark, sf)
    q = learn.boosted_quantiles(rows, "n_value", TAUS, stages=QUANTILE_STAGES, fit=F.col("role") == "fit", by="fold", k=FOLDS).where("role <> 'fit'")
    q = q.withColumn("score", cal.cqr_score(F.col("y_true"), F.col("q025"), F.col("q975"))).select("fold", "role", "y_true", "score", *TAUS)
    q = cut_lineage(q)
    radii = cal.conformal_radii(q.where("role = 'cal'"), [0.95], ["fold"]).select("fold", F.col("q").alias("_r"))
    t, y = q.where("role = 'test'").join(folds.checked_broadcast(radii, folds.MAX_FOLDS), "fold"), F.col("y_true")
    return rounded(t.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - F.col("q50"))).alias("mae_median"),
        F.avg(F.when(y.between(F.col("q025"), F.col("q975")), 1.0).otherwise(0.0)).alias("coverage_raw"),
        F.avg(F.when(y.between(F.col("q025") - F.col("_r"), F.col("q975") + F.col("_r")), 1.0).otherwise(0.0)).alias("coverage_cqr"),
        F.avg(F.col("q975") - F.col("q025") + 2 * F.col("_r")).alias("width_cqr")), "mae_median", "coverage_raw", "coverage_cqr", "width_cqr")


@query("m6_local_kriging")
def m6_local_kriging(spark, sf):
    """Mean N of every borehole from its 100 nearest boreholes of the other folds."""
    h = holes(spark, sf)
    out = kriging.local_kriging(h, h, 100, key="boring_key", point_key="boring_key", coords=["x", "y"], value="v", exclude="fold")
    return rounded(out, "mean", "std")


@query("m7_trees_plus_spatial_residual")
def m7_trees_plus_spatial_residual(spark, sf):
    """Boosted mean plus kriged out-of-bag residuals (20 neighbouring boreholes)."""
    rows = feature_rows(spark, sf)
    x, y = geo.local_km(F.col("latitude_deg"), F.col("longitude_deg"), 36.0, 139.7)
    site = lambda df, v: df.groupBy("latitude_deg", "longitude_deg").agg(F.avg(v).alias("res")).withColumns(
        {"x": x, "y": y, "site": F.xxhash64("latitude_deg", "longitude_deg")})
    oob, whole, _ = learn.nested_out_of_bag(rows, FOLDS, learn.boosted("n_value", ITERATIONS, 4), 2, seed=5)
    base = oob.select("row_key", "fold", F.xxhash64("latitude_deg", "longitude_deg").alias("site"),
                      trees.outputs({i: [m] for i, m in enumerate(whole)}, by=F.col("fold"))[0].alias("_base"))

    def run(i: int):
        train, test = oob.where(F.col("fold") != i), oob.where(F.col("fold") == i)
        k = kriging.local_kriging(site(test, F.lit(0.0)), site(train, F.col("n_value") - F.col(f"_oob{i}")), 20, key="site", point_key="site",
                                  coords=["x", "y"], value="res")
        return base.where(F.col("fold") == i).join(k, "site").select("row_key", (F.col("_base") + F.col("mean")).alias("y_pred"), F.col("std").alias("y_std"))

    return rounded(held_out(run).drop("fold"), "y_pred", "y_std")


@query("m8_residual_hybrid")
def m8_residual_hybrid(spark, sf):
    """Teacher out-of-bag predictions, a second model on what they miss, re-added by row key."""
    out = learn.residual_hybrid(feature_rows(spark, sf), FOLDS, lambda: learn.forest("n_value", trees=ITERATIONS, depth=5),
                                lambda: learn.boosted("_res", ITERATIONS, 4), target="n_value", key="row_key", seed=9)
    return rounded(out.drop("fold"), "base_pred", "y_pred")


@query("m9_hurdle")
def m9_hurdle(spark, sf):
    """Hurdle against single regressor on every fold, with marginal and bucketed radii."""
    rows = all_folds(spark, sf)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    parts = []
    for i in range(FOLDS):
        cells = folds.cell_counts(rows.where((F.col("fold") == i) & (F.col("role") != "test")))
        cells = folds.split_cells_by_share(cells, {"iso": 0.15, "conf": 0.15}, seed=1042).select("mesh_row", "mesh_col", "part")
        parts.append(cells.withColumn("fold", F.lit(i)))
    split = cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))
    rows = rows.join(folds.checked_broadcast(split, FOLDS * folds.MAX_LEVEL2_CELLS), ["fold", "mesh_row", "mesh_col"], "left")
    # a cell may hold test rows of the fold next to others: the role decides, not the cell
    rows = rows.withColumn("part", F.when(F.col("role") == "test", "test").otherwise(F.col("part")))
    out = cut_lineage(learn.hurdle(rows, FOLDS, iterations=ITERATIONS).select("fold", "part", "p_stiff", "y_true", "y_pred", "y_std", "y_single"))
    edges = quantiles(out.where("part = 'conf'"), ["fold"], "p_stiff", {f"q{i}": i / 5 for i in range(6)})
    # inner edges with duplicates dropped, as in N15
    edge = F.array_distinct(F.array(*[f"q{i}" for i in range(6)]))
    edges = edges.select("fold", F.when(F.size(edge) > 2, F.slice(edge, F.lit(2), F.size(edge) - 2)).otherwise(F.array().cast("array<double>")).alias("_e"))
    out = out.join(folds.checked_broadcast(edges, folds.MAX_FOLDS), "fold").withColumn("bucket", F.size(F.filter("_e", lambda e: e <= F.col("p_stiff"))))
    conf = cal.with_score(out.where("part = 'conf'"), relative=False)
    radii = cal.mondrian_radii(conf, "bucket", [0.95], ["fold"], min_group=50)
    test = cal.with_group_radius(out.where("part = 'test'"), radii, "bucket", ["fold"])
    marginal = order_statistics(conf, ["fold"], "score", [0.95]).select("fold", F.col("q").alias("_m"))
    test = test.join(folds.checked_broadcast(marginal, folds.MAX_FOLDS), "fold")
    r, stiff = F.abs(errors.residual()), F.col("y_true") >= 30
    out = test.groupBy("part", "fold").agg(
        F.count(F.lit(1)).alias("n_test"), errors.rmse(errors.residual()).alias("rmse_hurdle"), errors.rmse(F.col("y_true") - F.col("y_single")).alias("rmse_single"),
        errors.rmse(F.when(stiff, errors.residual())).alias("rmse_stiff_hurdle"), share(r <= F.col("_m")).alias("coverage_marginal"),
        share(r <= F.col("radii")[0]["q"]).alias("coverage_bucket"), F.avg(F.when(stiff, F.when(r <= F.col("radii")[0]["q"], 1.0).otherwise(0.0))).alias("coverage_bucket_stiff"),
        F.avg("y_std").alias("std_mean"))
    out = out.select(*[c for c in out.columns if c != "fold"], "fold")
    return rounded(out, *[c for c in out.columns if c not in ("part", "n_test", "fold")])


def borehole_rows(spark, sf):
    ep = pr.survival_table(pr.endpoints(inputs.measurements(spark, sf)))
    ep = with_mesh(ep).withColumn("fold", ((F.col("mesh_row") + 2 * F.col("mesh_col")) % 3).cast("int"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = quality.require_complete(cut_lineage(ep.withColumn("hole", F.xxhash64(*pr.LOC))), [*learn.BOREHOLE, "regime_code"])
    return learn.assemble(rows.repartition(n, "hole"), learn.BOREHOLE)


ENDPOINTS = ("depth_to_first_n30", "soft_thickness_lt5_0_to_10m", "mean_n_upper_10m", "min_n_upper_10m")


@query("m10_endpoint_models")
def m10_endpoint_models(spark, sf):
    """Depth to stiff, soft thickness, upper-10 m mean and minimum N on every fold: censored rows excluded, P10/P50/P90
    envelope, AUC of -prediction."""
    rows = borehole_rows(spark, sf).persist()
    taus = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    specs = [learn.boosted("_y", ITERATIONS, 3).spec, *[trees.Spec("pinball", QUANTILE_STAGES, 3, 0.5, tau=tau) for tau in taus.values()]]
    groups = [trees.Group(F.col(target).isNotNull() & (F.col("fold") != i), [F.col(target)], specs) for target in ENDPOINTS for i in range(FOLDS)]
    found = trees.fit(rows, groups, hot=learn.REGIMES)
    models = {i: [m for j in range(len(ENDPOINTS)) for m in found[j * FOLDS + i]] for i in range(FOLDS)}
    wide = rows.withColumn("_m", trees.outputs(models, by=F.col("fold")))
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("_y"),
                              *[F.col("_m")[j * len(specs) + m].alias(n) for m, n in enumerate(["prediction", *taus])]) for j, t in enumerate(ENDPOINTS)])
    test, by = cut_lineage(wide.select("fold", F.col("has_n30_within_30m").alias("y"), F.inline(each))), ["target", "fold"]
    r = F.col("_y") - F.col("prediction")
    m = test.where("_y is not null").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(r)).alias("mae"), errors.rmse(r).alias("rmse"),
        F.avg(F.when(F.col("_y").between(F.col("p10"), F.col("p90")), 1.0).otherwise(0.0)).alias("coverage_80"))
    auc = th.roc_auc(test.select(*by, (-F.col("prediction")).alias("p"), "y"), by).withColumnRenamed("auc", "auc_within_30m")
    out = m.join(folds.checked_broadcast(auc), by).select("n", "mae", "rmse", "coverage_80", *by, "auc_within_30m")
    return rounded(out, "mae", "rmse", "coverage_80", "auc_within_30m")


@query("k11_out_of_bag")
def k11_out_of_bag(spark, sf):
    oob = learn.out_of_bag(feature_rows(spark, sf), lambda: learn.boosted("n_value", ITERATIONS, 4), 3, seed=42)
    return rounded(oob.select("row_key", "base_pred"), "base_pred")


@query("e12_permutation_importance")
def e12_permutation_importance(spark, sf):
    """Every fold's rows permuted under the model of the other folds."""
    rows = feature_rows(spark, sf)
    groups = [["depth_from_surface"], ["regime_code"], ["river_distance_km"], ["latitude_deg", "longitude_deg"]]
    models = learn.fit_folds(rows, learn.boosted("n_value", ITERATIONS, 4), [F.col("fold") != i for i in range(FOLDS)])
    return rounded(learn.permutation_importance(models, rows, groups, "row_key", learn.assemble), "rmse", "rise")


SCORED = ["fold", "role", "regime_code", "y_true", "y_pred"]


def scored(pred):
    """Held-out predictions, written once without the features, as an evaluation reads them several times."""
    return cut_lineage(pred.select(*SCORED)).withColumn("y_std", F.lit(1.0))


@query("m18_leave_group_out")
def m18_leave_group_out(spark, sf):
    """Folds, calibration split, fit, group radii, errors, aggregate and gate in one runner."""
    roles = folds.fold_roles(cut_lineage(cell_folds(spark, sf)), 3, 0.2, 142)
    rows = folds.with_roles(feature_rows(spark, sf), roles)
    pred = learn.cross_predict(rows, 3, lambda: learn.boosted("n_value", ITERATIONS))
    per = learn.evaluate(scored(pred))
    out = errors.gate(errors.over_folds(per, ["rmse", "mae", "coverage", "coverage_stiff"]), rmse_ref=10.0, rmse_tol=0.1, coverage_tol=0.03)
    return rounded(out, *[c for c in out.columns if c.split("_")[-1] in ("mean", "std", "min", "max")])


@query("m19_region_transfer")
def m19_region_transfer(spark, sf):
    """Train west of 139.7 E, test east of it."""
    rows = feature_rows(spark, sf).drop("fold", "role").withColumn("fold", F.lit(0))
    west = F.col("longitude_deg") < 139.7
    role = F.when(~west, "test").when((F.col("mesh_row") * 3 + F.col("mesh_col") * 7) % 5 == 0, "cal").otherwise("fit")
    pred = learn.cross_predict(rows.withColumn("role", role), 1, lambda: learn.boosted("n_value", ITERATIONS))
    out = learn.evaluate(scored(pred))
    return rounded(out, "rmse", "mae", "target_sd", "coverage", "coverage_stiff")


@query("m20_correction_sensitivity")
def m20_correction_sensitivity(spark, sf):
    """Raw, overburden- and rod-corrected N; boosted trees and forest; every dispersed fold and contiguous block held out once."""
    p = inputs.predictions(spark, sf, inputs.spread(spark, sf)).where("groundwater_depth_m is not null")
    s = numeric.effective_overburden(F.col("depth_from_surface"), F.col("groundwater_depth_m"))
    cn = numeric.overburden_factor(s)
    rows = p.withColumns({"n_cn": F.col("n_value") * cn, "n_cn_cr": F.col("n_value") * cn * numeric.rod_factor(F.col("depth_from_surface")),
                          "block": (F.col("longitude_deg") > 139.7).cast("int")})
    rows = learn.assemble(rows.select("row_key", *learn.NUMERIC, "regime_code", "fold", "block", *TARGETS), learn.NUMERIC)
    parts = [("dispersed", "fold", i) for i in range(FOLDS)] + [("contiguous", "block", i) for i in range(2)]
    made = [(m, i) for m in ("boosted", "forest") for i in range(len(TARGETS))]
    specs = [(learn.boosted(TARGETS[i], ITERATIONS, 4) if m == "boosted" else learn.forest(TARGETS[i], trees=ITERATIONS, depth=5)).spec._replace(label=i) for m, i in made]
    found = trees.fit(rows, [trees.Group(F.col(column) != part, [F.col(t) for t in TARGETS], specs) for _, column, part in parts], hot=learn.REGIMES)
    at = np.cumsum([0, *[m.width for m in found[0]]])
    each = []
    for geometry, column in (("dispersed", "fold"), ("contiguous", "block")):
        own = {part: found[p] for p, (g, _, part) in enumerate(parts) if g == geometry}
        each.append((geometry, column, trees.outputs(own, by=F.col(column))))
    wide = rows.select("fold", "block", *TARGETS, *[c.alias(g) for g, _, c in each])
    long = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(TARGETS[i]).alias("target"), F.lit(g).alias("geometry"), F.col(column).cast("int").alias("fold"),
                              F.col(TARGETS[i]).alias("y_true"), F.col(g)[int(at[j])].alias("y_pred")) for g, column, _ in each for j, (m, i) in enumerate(made)])
    out = errors.normalised_rmse(wide.select(F.inline(long)), ["model", "target", "geometry", "fold"])
    return rounded(out, "rmse", "target_sd", "nrmse")


@query("m21_buffer_sweep")
def m21_buffer_sweep(spark, sf):
    """Contiguous folds without and with a one-cell ring: shrinkage, error, coverage."""
    cells = cut_lineage(folds.contiguous_folds(folds.cell_counts(inputs.measurements(spark, sf)), 2, iterations=None))
    rows = feature_rows(spark, sf).drop("fold", "role")
    layouts, shrink = [], []
    for ring in (0, 1):
        usable = folds.usable_folds(cells, 2, ring).select("mesh_row", "mesh_col", F.col("fold").alias("_own"), "usable")
        r = rows.join(folds.checked_broadcast(usable, folds.MAX_LEVEL2_CELLS), ["mesh_row", "mesh_col"])
        r = r.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))
        role = (F.when(F.col("_own") == F.col("fold"), "test").when(~F.array_contains("usable", F.col("fold")), "buffer")
                .when((F.col("mesh_row") * 3 + F.col("mesh_col") * 7) % 5 == 0, "cal").otherwise("fit"))
        layouts.append(r.withColumn("role", role).where("role <> 'buffer'").drop("_own", "usable").withColumn("fold", F.col("fold") + 2 * ring))
        shrink.append(folds.train_shrinkage(cells, 2, ring).select((F.col("fold") + 2 * ring).alias("fold"), "n_train", "shrinkage_pct"))
    # both rings as four folds of one run
    pred = learn.cross_predict(layouts[0].unionByName(layouts[1]), 4, lambda: learn.boosted("n_value", ITERATIONS, 4))
    out = learn.evaluate(scored(pred)).join(shrink[0].unionByName(shrink[1]), "fold")
    out = out.withColumn("ring", F.floor(F.col("fold") / 2).cast("int")).withColumn("fold", F.col("fold") % 2)
    return rounded(out, "rmse", "mae", "target_sd", "coverage", "coverage_stiff")


@query("m22_local_update")
def m22_local_update(spark, sf):
    """Prior predictions of every row, shifted by the other folds' observations within 3 km."""
    p = inputs.predictions(spark, sf)
    x, y = geo.local_km(F.col("latitude_deg"), F.col("longitude_deg"), 36.0, 139.7)
    p = p.select("row_key", "fold", "y_true", "y_pred", "y_std", x.alias("x"), y.alias("y"), (F.col("depth_from_surface") / 10).alias("z"))
    out = kriging.residual_update(p, p, key="row_key", point_key="row_key", coords=["x", "y", "z"], radius=3.0, max_points=16, exclude="fold")
    return rounded(out, "mean", "std")

"""Spatially honest folds and splits: whole mesh cells move together.

Rows are only touched twice: once to count them per cell, once to look up their cell's fold.
Everything in between works on the cell table, whose size is bounded by the mesh.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundsieve.functions.mesh import MAX_LEVEL2_CELLS, pack, with_bounds
from groundsieve.operators.small import checked_broadcast
from groundsieve.session import cut_lineage

CELL = ["mesh_row", "mesh_col"]
MAX_FOLDS, MAX_LLOYD_STEPS = 100, 1000


def shuffle_key(seed: int | Column, code: Column) -> Column:
    """Pseudo-random but reproducible order of cells."""
    seed = seed if isinstance(seed, Column) else F.lit(int(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), code.cast("string")))


def cell_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per mesh cell (and per ``by`` group)."""
    return (df.groupBy(*by, *CELL).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("mesh_code", pack(F.col("mesh_row"), F.col("mesh_col"))))


def balanced_folds(cells: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Cells in shuffled order, each to the fold with the fewest rows so far (K1).

    Greedy packing is sequential by nature; it runs over the cell table, which a level-2 mesh
    bounds at 86,400 rows.
    """
    if k < 2:
        raise ValueError(f"need at least 2 folds, got {k}")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < k:
            raise ValueError(f"{len(pdf)} mesh cells cannot fill {k} folds")
        if len(pdf) > MAX_LEVEL2_CELLS:
            raise ValueError("more cells than a level-2 mesh holds")
        pdf = pdf.sort_values(["_h", "mesh_code"], kind="stable")
        load, folds = [0] * k, []
        for n in pdf["n_rows"]:
            f = load.index(min(load))
            load[f] += int(n)
            folds.append(f)
        return pdf.assign(fold=folds)[["mesh_row", "mesh_col", "mesh_code", "n_rows", "fold"]]

    return (cells.withColumns({"_h": shuffle_key(seed, F.col("mesh_code")), "_g": F.lit(0)})
            .groupBy("_g").applyInPandas(
                assign, "mesh_row long, mesh_col long, mesh_code long, n_rows long, fold int"))


def contiguous_folds(cells: DataFrame, k: int, seed: int = 42, iterations: int | None = 10) -> DataFrame:
    """Compact folds by weighted-free Lloyd steps on cell midpoints (K2).

    Start centres are the first ``k`` cells in shuffled order; every step is a fold-sized
    aggregate over the cell table. Ties go to the lowest fold. Without ``iterations``, steps go on
    until no cell moves: each cuts the lineage of the cell table and looks for a moved cell.
    """
    if k < 2:
        raise ValueError(f"need at least 2 folds, got {k}")
    pts = with_bounds(cells).select(*CELL, "mesh_code", "n_rows", "lat_mid", "lon_mid")
    pts = cut_lineage(pts) if iterations is None else pts
    order = W.orderBy(shuffle_key(seed, F.col("mesh_code")), "mesh_code")
    centres = (pts.withColumn("fold", F.row_number().over(order) - 1).where(F.col("fold") < k)
               .agg(F.sort_array(F.collect_list(F.struct("fold", F.col("lat_mid").alias("y"), F.col("lon_mid").alias("x")))).alias("centres")))
    before = None
    for _ in range(MAX_LLOYD_STEPS if iterations is None else iterations):
        placed = _nearest_centre(pts, centres)
        if iterations is None:
            placed = cut_lineage(placed)
            if before is not None and not placed.join(before, CELL).where(F.col("fold") != F.col("_before")).limit(1).count():
                return placed.select(*CELL, "mesh_code", "n_rows", "fold")
            before = placed.select(*CELL, F.col("fold").alias("_before"))
        moved = placed.groupBy("fold").agg(F.avg("lat_mid").alias("y"), F.avg("lon_mid").alias("x"))
        centres = moved.agg(F.sort_array(F.collect_list(F.struct("fold", "y", "x"))).alias("centres"))
    if iterations is None:
        raise ValueError(f"cells still move after {MAX_LLOYD_STEPS} steps")
    return _nearest_centre(pts, centres).select(*CELL, "mesh_code", "n_rows", "fold")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the hash of the parts: 48 bits of their md5."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / F.lit(float(1 << 48))


def restarted_folds(cells: DataFrame, k: int, seed: int = 42, starts: int = 10, y: str = "lat_mid", x: str = "lon_mid") -> DataFrame:
    """Compact folds by k-means to a fixed point, the best of several starts (K2): the cells with ``fold``.

    ``cells`` has its positions ``y`` and ``x`` (midpoints of the cell or means of its data). Every start draws its centres by the k-means++
    rule, the next one with a probability in proportion to the squared distance from those before, as a race of hashed
    exponentials. All starts move together: a step is one aggregate over the cell table, of a row a start and fold, until no
    centre moves. The start with the least sum of squares wins; all ties go to the lower number.
    """
    if k < 2:
        raise ValueError(f"need at least 2 folds, got {k}")
    spark = cells.sparkSession
    pts = cut_lineage(cells.select(*CELL, "mesh_code", "n_rows", F.col(y).alias("_y"), F.col(x).alias("_x"),
                                   F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("_start")))

    def placed(centres: dict[int, list[tuple[int, float, float]]]) -> DataFrame:
        local = spark.createDataFrame(list(centres.items()), "_start int, _c array<struct<fold:int,y:double,x:double>>")
        near = F.array_min(F.transform("_c", lambda c: F.struct(
            F.round((F.col("_y") - c["y"]) * (F.col("_y") - c["y"]) + (F.col("_x") - c["x"]) * (F.col("_x") - c["x"]), 9).alias("d2"), c["fold"].alias("fold"))))
        return pts.join(F.broadcast(local), "_start").withColumn("_near", near).select(*pts.columns, "_near.d2", "_near.fold")

    centres: dict[int, list[tuple[int, float, float]]] = {}
    for j in range(k):
        draw = uniform(F.lit(seed), F.col("_start"), F.lit(j), F.col("mesh_code"))
        race = draw if j == 0 else F.when(F.col("d2") > 0, -F.log(draw) / F.col("d2"))
        frame = pts if j == 0 else placed(centres)
        for r in frame.groupBy("_start").agg(F.min_by(F.struct("_y", "_x"), F.struct(race.isNull(), race, F.col("mesh_code"))).alias("c")).collect():
            centres.setdefault(r["_start"], []).append((j, r["c"]["_y"], r["c"]["_x"]))
    for _ in range(MAX_LLOYD_STEPS):
        now = placed(centres)
        moved: dict[int, list[tuple[int, float, float]]] = {}
        inertia: dict[int, float] = {}
        sums = now.groupBy("_start", "fold").agg(F.round(F.avg("_y"), 12).alias("y"), F.round(F.avg("_x"), 12).alias("x"), F.sum("d2").alias("s")).collect()
        for r in sorted(sums, key=lambda r: (r["_start"], r["fold"])):
            moved.setdefault(r["_start"], []).append((r["fold"], r["y"], r["x"]))
            inertia[r["_start"]] = inertia.get(r["_start"], 0.0) + r["s"]
        if moved == centres:
            best = min(inertia, key=lambda i: (round(inertia[i], 6), i)) if inertia else 0
            return now.where(F.col("_start") == best).select(*CELL, "mesh_code", "n_rows", "fold")
        centres = moved
    raise ValueError(f"cells still move after {MAX_LLOYD_STEPS} steps")


def _nearest_centre(pts: DataFrame, centres: DataFrame) -> DataFrame:
    held = pts.withColumn("_c", centres.scalar())  # one row: the k centres
    scored = F.transform("_c", lambda c: F.struct(
        (F.round((F.col("lat_mid") - c["y"]) * (F.col("lat_mid") - c["y"])
                 + (F.col("lon_mid") - c["x"]) * (F.col("lon_mid") - c["x"]), 9)).alias("d2"),
        c["fold"].alias("fold")))
    return held.withColumn("fold", F.array_min(scored)["fold"]).drop("_c")


def with_fold(df: DataFrame, cell_folds: DataFrame) -> DataFrame:
    """Fold column on every row."""
    return df.join(checked_broadcast(cell_folds.select(*CELL, "fold"), MAX_LEVEL2_CELLS), CELL)


def usable_folds(cell_folds: DataFrame, k: int, radius: int) -> DataFrame:
    """Cells with ``usable``: the folds they may train, i.e. folds with no test cell in their ring.

    Every cell tells its ring which fold it tests; one shuffle of the cell table collects that.
    """
    span = F.sequence(F.lit(-radius), F.lit(radius))
    told = cell_folds.select(
        "mesh_row", "mesh_col", "n_rows", "fold", F.explode(F.transform(span, lambda d: d)).alias("_dr"))
    told = told.select("*", F.explode(span).alias("_dc"))
    home = (F.col("_dr") == 0) & (F.col("_dc") == 0)
    got = told.groupBy((F.col("mesh_row") + F.col("_dr")).alias("mesh_row"),
                       (F.col("mesh_col") + F.col("_dc")).alias("mesh_col")).agg(
        F.max(F.when(home, F.col("n_rows"))).alias("n_rows"), F.max(F.when(home, F.col("fold"))).alias("fold"),
        F.collect_set("fold").alias("_blocked"))
    every = F.array(*[F.lit(i) for i in range(k)])
    return (got.where("n_rows is not null")
            .withColumn("usable", F.array_except(every, F.col("_blocked"))).drop("_blocked"))


def buffered_train(df: DataFrame, cell_folds: DataFrame, k: int, radius: int) -> DataFrame:
    """Train rows per fold, without rows within ``radius`` cells of a test cell.

    A fold whose test cells leave no train cell is an error: one bounded look at the cell table.
    """
    usable = usable_folds(cell_folds, k, radius).select(*CELL, "usable")
    left = {r.fold for r in usable.select(F.explode("usable").alias("fold")).distinct().collect()}
    tested = {r.fold for r in cell_folds.select("fold").distinct().collect()}
    if empty := sorted(tested - left):
        raise ValueError(f"no train cell is left for folds {empty} at radius {radius}")
    return (df.drop("fold").join(checked_broadcast(usable, MAX_LEVEL2_CELLS), CELL)
            .withColumn("fold", F.explode("usable")).drop("usable"))


def train_shrinkage(cell_folds: DataFrame, k: int, radius: int) -> DataFrame:
    """Train rows before and after buffering, and the loss in percent (K4)."""
    cells = usable_folds(cell_folds, k, radius)
    per = cells.select("n_rows", F.col("fold").alias("_own"), "usable",
                       F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("fold"))
    out = per.groupBy("fold").agg(
        F.sum(F.when(F.col("_own") != F.col("fold"), F.col("n_rows")).otherwise(0)).alias("n_base"),
        F.sum(F.when(F.array_contains("usable", F.col("fold")), F.col("n_rows")).otherwise(0)).alias("n_train"))
    return out.withColumn("shrinkage_pct", F.round(100.0 * (1 - F.col("n_train") / F.col("n_base")), 1))


def calibration_cells_by_rows(cells: DataFrame, fraction: float, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Shuffled whole cells until they hold at least ``fraction`` of the rows (K8)."""
    key = shuffle_key(F.lit(seed) + F.col(by[0]) if by else seed, F.col("mesh_code"))
    w = W.partitionBy(*by).orderBy(key, "mesh_code").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_rows").over(w), F.lit(0))
    target = F.sum("n_rows").over(W.partitionBy(*by)) * F.lit(float(fraction))
    return cells.withColumn("is_cal", (before < target))


def split_cells_by_share(cells: DataFrame, shares: Mapping[str, float], seed: int, rest: str = "train",
                         by: Sequence[str] = ()) -> DataFrame:
    """Shuffled whole cells by cell count: max(1, floor(cells * share)) for each named part."""
    key = shuffle_key(F.lit(seed) + F.col(by[0]) if by else seed, F.col("mesh_code"))
    rn = F.row_number().over(W.partitionBy(*by).orderBy(key, "mesh_code"))
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    out = cells.withColumns({"_rn": rn, "_n": n})
    label, edge = None, F.lit(0)
    for name, share in shares.items():
        edge = edge + F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(share))))
        label = F.when(F.col("_rn") <= edge, name) if label is None else label.when(F.col("_rn") <= edge, name)
    return out.withColumn("part", label.otherwise(rest)).drop("_rn", "_n")


def fold_roles(cell_folds: DataFrame, k: int, fraction: float, seed: int) -> DataFrame:
    """(cell, fold, role) with role test, cal or fit: the leave-one-fold-out layout."""
    pairs = cell_folds.withColumnRenamed("fold", "_own").withColumn(
        "fold", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    pairs = pairs.withColumn("_test", F.col("_own") == F.col("fold"))
    split = calibration_cells_by_rows(pairs, fraction, seed, by=["fold", "_test"])
    role = F.when(F.col("_test"), "test").when(F.col("is_cal"), "cal").otherwise("fit")
    return split.select(*CELL, "fold", role.alias("role"))


def with_roles(df: DataFrame, roles: DataFrame, keep: Sequence[str] = ("test", "cal", "fit")) -> DataFrame:
    """Rows once per fold they serve, with the role they play there."""
    packed = (roles.where(F.col("role").isin(list(keep))).groupBy(*CELL)
              .agg(F.collect_list(F.struct("fold", "role")).alias("_roles")))
    return (df.drop("fold", "role").join(checked_broadcast(packed, MAX_LEVEL2_CELLS), CELL)
            .select("*", F.inline("_roles")).drop("_roles"))


def fold_report(df: DataFrame, depth: str = "depth_from_surface", value: str = "n_value") -> DataFrame:
    """Rows, boreholes, cells, depth and N statistics per fold."""
    from groundsieve.functions.ordered import quantiles

    cells = df.groupBy("fold", *CELL).agg(F.lit(1).alias("_c")).groupBy("fold").agg(F.count(F.lit(1)).alias("n_cells"))
    holes = df.groupBy("fold", "latitude_deg", "longitude_deg").agg(F.lit(1).alias("_c"))
    holes = holes.groupBy("fold").agg(F.count(F.lit(1)).alias("n_boreholes"))
    base = df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("n_mean"), F.stddev_samp(value).alias("n_std"),
        *[F.avg(F.when(F.col("regime_code") == i, 1.0).otherwise(0.0)).alias(f"regime_{i}_share") for i in range(8)])
    d = quantiles(df, ["fold"], depth, {"depth_median": 0.5, "depth_p95": 0.95}).drop("n")
    v = quantiles(df, ["fold"], value, {"n_p95": 0.95}).drop("n")
    out = base
    for part in (cells, holes, d, v):
        out = out.join(checked_broadcast(part, MAX_FOLDS), "fold")
    return out

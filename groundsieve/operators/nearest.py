"""Exact nearest neighbours and kernel sums as a tiled Spark join.

Points are cut into tiles of roughly equal row count at percentiles of each axis in turn, so
crowded areas get small tiles. The tile table (bounds and counts) has at most ``MAX_TILES`` rows
whatever the data size; it is the only thing broadcast. For each tile of queries it gives

* an upper bound on the k-th distance: the nearest tiles that together hold k points,
* the candidate tiles: those not farther than that bound, or than a given radius.

A grid over the box of such a coarse tile cuts it into blocks of about ``rows_per_tile`` rows (one, where the tile table is large enough) and each
block into ``UNITS`` x ``UNITS`` cells. Their table grows with the data and stays a DataFrame: cells of queries are matched to cells of points in
tasks of their own, one per coarse tile of queries, among the cells of its coarse candidates. The k-th distance is so bounded by the
size of a cell, and a block takes the union of its cells' candidates: a row has few copies, and not more where there are more rows.

Query and candidate rows then meet by equi-join on block and cell. Crowded blocks are split by a
hash of the row key, and long candidate lists into several groups whose partial results are
merged, so no task sees an unbounded group. Inside a task numpy compares small blocks.

With ``exclude``, a column of both sides with few values (a fold), a query meets only points whose value differs: one tiling
serves all folds. Tiling and matching run jobs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, functions as F, types as T

from groundsieve.session import cut_lineage, qualified, shared_folder

MAX_TILES = 65_536
ROWS_PER_TILE = 4_000
ROWS_PER_GROUP = 200_000
LEAF = 64
BLOCK = 32
MAX_CLASSES = 64
MAX_SIDE = 1 << 10  # cells of a coarse tile along an axis
UNITS = 4  # cells of a block along an axis


class Cuts(NamedTuple):
    """Nested cuts, widest axis first; numbers of all levels together stay near MAX_TILES."""

    order: list[int]
    levels: list[dict[int, np.ndarray]]  # per level: strip -> cut positions
    widths: list[int]


class Tiling(NamedTuple):
    """The cuts and the coarse tile table: bounds, counts, counts by class, and cells along each of the two widest axes."""

    cuts: Cuts
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray
    ids: np.ndarray
    by: dict[int, np.ndarray]
    side: np.ndarray

    def others(self, x: int) -> np.ndarray:
        """Points of each tile that a query of class ``x`` may meet."""
        return self.n - self.by[x] if x in self.by else self.n

    def fine(self, tile: np.ndarray, at: np.ndarray, parts: int) -> np.ndarray:
        """Cell of each row inside its coarse tile, ``parts`` a side; rows outside the tile's box fall into its nearest cell."""
        k = np.minimum(np.searchsorted(self.ids, tile), len(self.ids) - 1)
        known = self.ids[k] == tile
        side = np.where(known, self.side[k] * parts, 1)
        out = np.zeros(len(tile), np.int64)
        for axis in self.cuts.order[:2]:
            low, high = self.lo[k, axis], self.hi[k, axis]
            span = np.where(high > low, high - low, 1.0)
            out = out * MAX_SIDE + np.clip(np.floor((at[:, axis] - low) / span * side), 0, side - 1).astype(np.int64)
        return out


def _percentiles(c: str, n: int):
    return F.percentile_approx(c, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n))


def _tile_of(x: np.ndarray, cuts: Cuts) -> np.ndarray:
    """Tile number of each row of coordinates: nested searches, one axis after the other."""
    out = np.zeros(len(x), dtype=np.int64)
    for axis, table, width in zip(cuts.order, cuts.levels, cuts.widths):
        nxt = np.zeros(len(x), dtype=np.int64)
        for s in np.unique(out):
            at = table.get(int(s))
            if at is not None and len(at):
                rows = out == s
                nxt[rows] = np.searchsorted(at, x[rows, axis], side="left")
        out = out * width + nxt
    return out


def _tag(df: DataFrame, coords: Sequence[str], cuts: Cuts, name: str) -> DataFrame:
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.LongType())])
    cols = list(coords)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[name] = _tile_of(pdf[cols].to_numpy(float), cuts)
            yield pdf

    return df.mapInPandas(run, schema)


def _thin(values, pieces: int) -> np.ndarray:
    """Cut positions for ``pieces`` parts out of a finer list of percentiles."""
    v = np.asarray(values or [], float)
    take = np.unique(np.round(np.arange(1, pieces) * (len(v) + 1) / pieces).astype(int) - 1)
    return np.unique(v[take[(take >= 0) & (take < len(v))]])


def tile_points(points: DataFrame, coords: Sequence[str], bounds: Sequence[tuple[str, str]],
                rows_per_tile: int) -> tuple[DataFrame, Tiling]:
    """Tag ``points`` with ``_tile`` and describe the tiles.

    The widest axis is cut into about sqrt(rows / rows_per_tile) strips. Every strip is then cut
    along the next axis into as many parts as its own row count asks for, so a crowded strip gets
    more and thinner tiles and a narrow axis (depth) is only cut where places are crowded.
    """
    spread = points.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(coords)]).first()
    size = max(rows_per_tile, int(np.ceil(spread["n"] / (MAX_TILES / 2))))
    order = sorted(range(len(coords)), key=lambda i: -(spread[f"s{i}"] or 0.0))
    wanted = spread["n"] / size
    strips = max(1, int(np.ceil(np.sqrt(wanted) if len(coords) > 1 else wanted)))
    cuts = Cuts(order, [], [])
    if wanted > 1:
        for level, axis in enumerate(order):
            fine = max(2, strips if level == 0 else min(512, 8 * strips))
            tagged = _tag(points.select(*coords), coords, cuts, "_s")
            rows = tagged.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), _percentiles(coords[axis], fine).alias("c")).collect()  # one row per strip
            pieces = {int(r["_s"]): (strips if level == 0 else int(np.ceil(r["n"] / size))) for r in rows}
            table = {int(r["_s"]): _thin(r["c"], min(fine, pieces[int(r["_s"])])) for r in rows if pieces[int(r["_s"])] > 1}
            cuts = Cuts(order, [*cuts.levels, table], [*cuts.widths, fine + 1])
    tagged = _tag(points, coords, cuts, "_tile")
    stats = tagged.groupBy("_tile", "_x").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"lo{i}") for i, (a, _) in enumerate(bounds)],
        *[F.max(b).alias(f"hi{i}") for i, (_, b) in enumerate(bounds)]).toPandas()
    d = len(bounds)
    if stats["_x"].nunique() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} values to exclude by")
    whole = stats.groupby("_tile").agg({"n": "sum"} | {f"lo{i}": "min" for i in range(d)} | {f"hi{i}": "max" for i in range(d)}).sort_index()
    by = {int(x): g.set_index("_tile")["n"].reindex(whole.index, fill_value=0).to_numpy(np.int64) for x, g in stats.groupby("_x")}
    n = whole["n"].to_numpy(np.int64)
    side = np.ceil(n / rows_per_tile) ** (1 / min(2, d)) if d else np.ones(len(n))
    return tagged, Tiling(cuts, whole[[f"lo{i}" for i in range(d)]].to_numpy(float), whole[[f"hi{i}" for i in range(d)]].to_numpy(float),
                          n, whole.index.to_numpy(np.int64), by, np.minimum(np.ceil(side - 1e-9).astype(np.int64), MAX_SIDE // UNITS))


def _box_distances(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared smallest and largest distance from one box to many."""
    gap = np.maximum(np.maximum(lo2 - hi, lo - hi2), 0.0)
    far = np.maximum(hi2 - lo, hi - lo2)
    return (gap * gap).sum(axis=1), (far * far).sum(axis=1)


def _candidates(lo, hi, lo2, hi2, n2, k: int, max_d2: float) -> tuple[np.ndarray, np.ndarray]:
    """Boxes that may hold one of the k nearest points of anything inside (lo, hi), near ones first."""
    near, far = _box_distances(lo, hi, lo2, hi2)
    order = np.argsort(far)
    enough = np.searchsorted(np.cumsum(n2[order]), k)
    bound = far[order[enough]] if enough < len(order) else np.inf
    keep = np.flatnonzero(near <= min(bound, max_d2) * (1 + 1e-9))
    return keep[np.argsort(near[keep], kind="stable")], near


def _halve(x: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Split rows at medians of the widest axis until blocks have at most ``size`` rows."""
    todo, done = [rows], []
    while todo:
        r = todo.pop()
        if len(r) <= size:
            done.append(r)
            continue
        sub = x[r]
        axis = int(np.argmax(sub.max(axis=0) - sub.min(axis=0)))
        mid = len(r) // 2
        part = np.argpartition(sub[:, axis], mid)
        todo += [r[part[:mid]], r[part[mid:]]]
    return done


def _point_d2(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    d2 = 0.0
    for j in range(q.shape[1]):
        d = q[:, j][:, None] - p[:, j][None, :]
        d2 = d2 + d * d
    return d2


def _segment_d2(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Squared distances from points to segments (x1, y1, x2, y2)."""
    px, py = q[:, 0][:, None], q[:, 1][:, None]
    x1, y1, x2, y2 = (s[:, j][None, :] for j in range(4))
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = np.clip(np.where(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / np.where(len2 > 0, len2, 1.0), 0.0), 0.0, 1.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def nearest_in_memory(q: np.ndarray, p: np.ndarray, keys: np.ndarray, k: int, max_d2: float = np.inf,
                      segments: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and squared distances of the k nearest, by distance then key; -1 where missing."""
    width = min(k, len(p))
    idx = np.full((len(q), k), -1, dtype=np.int64)
    d2 = np.full((len(q), k), np.inf)
    if segments:
        lo, hi = np.minimum(p[:, :2], p[:, 2:]), np.maximum(p[:, :2], p[:, 2:])
    else:
        lo = hi = p
    leaves = _halve((lo + hi) / 2, np.arange(len(p)), LEAF)
    leaf_lo = np.array([lo[r].min(axis=0) for r in leaves])
    leaf_hi = np.array([hi[r].max(axis=0) for r in leaves])
    leaf_n = np.array([len(r) for r in leaves])
    dist = _segment_d2 if segments else _point_d2
    for rows in _halve(q, np.arange(len(q)), BLOCK):
        near, _ = _candidates(q[rows].min(axis=0), q[rows].max(axis=0), leaf_lo, leaf_hi, leaf_n, width, max_d2)
        if not len(near):
            continue
        cand = np.concatenate([leaves[i] for i in near])
        dd = dist(q[rows], p[cand])
        m = min(width + 8, dd.shape[1])
        w = min(width, m)
        pick = np.argpartition(dd, m - 1, axis=1)[:, :m] if m < dd.shape[1] else np.broadcast_to(np.arange(m), dd.shape)
        sub = np.take_along_axis(dd, pick, axis=1)
        order = np.lexsort((keys[cand][pick], sub), axis=1)
        pick, sub = np.take_along_axis(pick, order, axis=1), np.take_along_axis(sub, order, axis=1)
        if m < dd.shape[1]:  # ties reaching past the picked rows are settled by key over all of them
            for t in np.flatnonzero(sub[:, w - 1] == sub[:, -1]):
                full = np.lexsort((keys[cand], dd[t]))[:m]
                pick[t], sub[t] = full, dd[t][full]
        idx[rows, :w], d2[rows, :w] = cand[pick[:, :w]], sub[:, :w]
    idx[d2 > max_d2] = -1
    d2[d2 > max_d2] = np.inf
    return idx, d2


def located(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose coordinates are all numbers."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


class Met(NamedTuple):
    """Both sides of a tiled join: rows that may meet share a block. ``_groups`` is the number of blocks of a query row."""

    left: DataFrame
    right: DataFrame
    axes: list[str]
    shape: list[str]
    merged: bool

    def solved(self, solve, schema: str) -> DataFrame:
        return (self.left.groupBy("_qt", "_qx", "_qs", "_group").cogroup(self.right.groupBy("_rt", "_rx", "_rs", "_rg")).applyInPandas(solve, schema))


def met(queries: DataFrame, points: DataFrame, k: int | None, *, query_key: str, point_key: str, coords: Sequence[str], payload: Sequence[str] = (),
        max_distance: float | None = None, segments: Sequence[str] | None = None, exclude: str | None = None,
        rows_per_tile: int = ROWS_PER_TILE, rows_per_group: int = ROWS_PER_GROUP) -> Met:
    """Blocks in which every query row meets all points that may be among its ``k`` nearest (all within ``max_distance`` if None)."""
    spark = queries.sparkSession
    coords, payload = list(coords), list(payload)
    shape = list(segments or coords)
    max_d2 = np.inf if max_distance is None else float(max_distance) ** 2
    x = F.coalesce(F.col(exclude).cast("int"), F.lit(-1)).alias("_x") if exclude else F.lit(-1).alias("_x")
    q = cut_lineage(queries.select(F.col(query_key).alias("_q"), x, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(coords)]))
    p = points.select(F.col(point_key).alias("_p"), x, *[F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(shape)],
                      *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(payload)])
    axes = [f"_c{i}" for i in range(len(coords))]
    shape = [f"_s{i}" for i in range(len(shape))]
    q, p = located(q, axes), located(p, shape)
    if segments:
        p = p.withColumns({"_c0": (F.col("_s0") + F.col("_s2")) / 2, "_c1": (F.col("_s1") + F.col("_s3")) / 2,
                           "_l0": F.least("_s0", "_s2"), "_h0": F.greatest("_s0", "_s2"),
                           "_l1": F.least("_s1", "_s3"), "_h1": F.greatest("_s1", "_s3")})
        bounds = [("_l0", "_h0"), ("_l1", "_h1")]
    else:
        p = p.withColumns({a: F.col(s) for a, s in zip(axes, shape)})
        bounds = [(a, a) for a in axes]
    p, tiles = tile_points(cut_lineage(p), axes, bounds, rows_per_tile)
    q = _tag(q, axes, tiles.cuts, "_tile")
    d = len(axes)
    # without ``exclude`` nobody is kept out: the class -1 of both sides is told apart by a query class of -2
    own = (lambda c: c) if exclude else (lambda c: -2)

    def reach(counts: np.ndarray) -> int:
        return int(counts.sum()) if k is None else min(k, int(counts.sum()))

    def lists(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
        """Rows (query block, class, salts, group, groups, point cell, salt, salts) of the query cells ``a``, of one class, and the point cells ``b``."""
        bounds_of = lambda f: (f[[f"lo{i}" for i in range(d)]].to_numpy(float), f[[f"hi{i}" for i in range(d)]].to_numpy(float))
        (lo, hi), (lo2, hi2), n2 = bounds_of(a), bounds_of(b), b["n2"].to_numpy(np.int64)
        salts2, names, enough, out = np.maximum(1, -(-b["n"].to_numpy(np.int64) // rows_per_group)), b["_tile"].to_numpy(), reach(n2), []
        for (tile, c), cells in a.groupby(["_tile", "_x"]).indices.items():
            keep = np.unique(np.concatenate([_candidates(lo[r], hi[r], lo2, hi2, n2, enough, max_d2)[0] for r in cells]))
            group, size, mine = 0, 0, []
            salts = max(1, -(-int(a["n"].to_numpy()[cells].sum()) // rows_per_tile))
            for t in keep:
                part = n2[t] / salts2[t]
                for s in range(salts2[t]):
                    if size and size + part > rows_per_group:
                        group, size = group + 1, 0
                    size += part
                    mine.append((tile, c, salts, group, names[t], s, salts2[t]))
            out += [(*m[:4], group + 1, *m[4:]) for m in mine]
        return out

    columns = ["_qt", "_qx", "_salts", "_group", "_groups", "_tile", "_ps", "_psalts"]
    block_schema = "_qt long, _qx int, _salts int, _group int, _groups int, _tile long, _ps int, _psalts int"

    def box(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"lo{i}") for i, a in enumerate(axes)],
                                   *[F.max(a).alias(f"hi{i}") for i, a in enumerate(axes)])

    q, p = _fine(q, axes, tiles, 1, unit=True), _fine(p, axes, tiles, UNITS)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lo, hi = pdf[[f"lo{i}" for i in range(d)]].to_numpy(), pdf[[f"hi{i}" for i in range(d)]].to_numpy()
            out = []
            for r, (tile, c) in enumerate(zip(pdf["_coarse"], pdf["_x"])):
                n2 = tiles.others(own(int(c)))
                keep, _ = _candidates(lo[r], hi[r], tiles.lo, tiles.hi, n2, reach(n2), max_d2)
                out += [(tile, c, tiles.ids[t]) for t in keep if n2[t] > 0]
            yield pd.DataFrame(out, columns=["_coarse", "_x", "_there"])

    near = box(q, ["_coarse", "_x"]).repartition("_coarse").mapInPandas(meet, "_coarse long, _x int, _there long")
    # cells of points: bounds and counts by class, as many as the points need; they are never gathered
    cells = p.groupBy("_coarse", "_tile", "_x").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"lo{i}") for i, (a, _) in enumerate(bounds)], *[F.max(b).alias(f"hi{i}") for i, (_, b) in enumerate(bounds)])
    cells = cells.groupBy("_coarse", "_tile").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_x", "n"))).alias("_by"),  # MAX_CLASSES entries
        *[F.min(f"lo{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(d)])
    own_n = F.coalesce(F.try_element_at("_by", F.col("_x")), F.lit(0)) if exclude else F.lit(0)
    there = near.join(cells.withColumnRenamed("_coarse", "_there"), "_there").select(
        "_coarse", F.col("_x").alias("_cx"), "_tile", (F.col("n") - own_n).alias("n2"), "n", *[f"lo{i}" for i in range(d)], *[f"hi{i}" for i in range(d)]).where("n2 > 0")

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(lists(a, b) if len(a) and len(b) else [], columns=columns)

    pairs = box(q, ["_coarse", "_tile", "_unit", "_x"]).groupBy("_coarse", "_x").cogroup(there.groupBy("_coarse", "_cx")).applyInPandas(match, block_schema)
    pairs = cut_lineage(pairs)
    shape_of = pairs.agg(F.max("_group").alias("g"), F.sum("_salts").alias("n")).first()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, min(4 * width, int(shape_of["n"] or 1)))  # the solve is heavy per row: keep small tasks
    fan = pairs.withColumn("_qs", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    heads = pairs.select("_qt", F.col("_qx").alias("_x"), "_salts", "_group", "_groups").distinct()
    left = q.withColumnRenamed("_tile", "_qt").join(heads, ["_qt", "_x"]).withColumnRenamed("_x", "_qx").withColumn(
        "_qs", F.pmod(F.xxhash64("_q"), F.col("_salts")).cast("int")).select("_qt", "_qx", "_qs", "_group", "_groups", "_q", *axes)
    right = p.join(fan, "_tile").where(F.pmod(F.xxhash64("_p"), F.col("_psalts")) == F.col("_ps"))
    if exclude:
        right = right.where(F.col("_x") != F.col("_qx"))
    right = right.select(F.col("_qt").alias("_rt"), F.col("_qx").alias("_rx"), F.col("_qs").alias("_rs"), F.col("_group").alias("_rg"), "_p", *shape,
                         *[f"_v{i}" for i in range(len(payload))])
    return Met(left.repartition(parts, "_qt", "_qx", "_qs", "_group"), right.repartition(parts, "_rt", "_rx", "_rs", "_rg"), axes, shape, (shape_of["g"] or 0) > 0)


def _fine(df: DataFrame, coords: Sequence[str], tiles: Tiling, parts: int, unit: bool = False) -> DataFrame:
    """``_tile`` becomes ``_coarse``; the new ``_tile`` numbers the block or cell in it, too, and ``_unit`` the cell."""
    schema = T.StructType(df.schema.fields + [T.StructField("_coarse", T.LongType())] + [T.StructField("_unit", T.LongType())] * unit)
    cols = list(coords)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, coarse = pdf[cols].to_numpy(float), pdf["_tile"].to_numpy(np.int64)
            pdf["_coarse"] = coarse
            pdf["_tile"] = coarse * (MAX_SIDE * MAX_SIDE) + tiles.fine(coarse, at, parts)
            if unit:
                pdf["_unit"] = tiles.fine(coarse, at, UNITS)
            yield pdf

    return df.mapInPandas(run, schema)


def knn_join(queries: DataFrame, points: DataFrame, k: int, *, query_key: str, point_key: str,
             coords: Sequence[str], payload: Sequence[str] = (), max_distance: float | None = None,
             segments: Sequence[str] | None = None, exclude: str | None = None, rows_per_tile: int = ROWS_PER_TILE,
             rows_per_group: int = ROWS_PER_GROUP, places: bool = False) -> DataFrame:
    """The k nearest points of every query: query_key, distances, neighbours (keys) and one array
    per numeric payload column, all nearest first; ties go to the lower key (J7).

    ``coords`` are Euclidean columns of both sides. With ``segments`` = (x1, y1, x2, y2) the
    points are segments and ``coords`` the two axes of the queries (J3). Queries with no
    neighbour within ``max_distance`` are left out, and so are rows of either side with a NULL or
    NaN coordinate. With ``exclude``, only points of another value of that column count. With ``places``
    the query's own coordinates come along, so that the arrays need not meet them in a join, and the points' as arrays ``_x0``, ...
    """
    payload = list(payload)
    max_d2 = np.inf if max_distance is None else float(max_distance) ** 2
    blocks = met(queries, points, k, query_key=query_key, point_key=point_key, coords=coords, payload=payload, max_distance=max_distance,
                 segments=segments, exclude=exclude, rows_per_tile=rows_per_tile, rows_per_group=rows_per_group)
    axes, shape = blocks.axes, blocks.shape
    q_type = queries.schema[query_key].dataType.simpleString()
    p_type = points.schema[point_key].dataType.simpleString()
    out_schema = f"_q {q_type}, distances array<double>, neighbours array<{p_type}>" + "".join(f", _v{i} array<double>" for i in range(len(payload)))
    own = axes if places else []
    theirs = {f"_x{i}": c for i, c in enumerate(shape)} if places else {}
    out_schema += "".join(f", {a} double" for a in own) + "".join(f", {c} array<double>" for c in theirs)

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        keys = b["_p"].to_numpy()
        idx, d2 = nearest_in_memory(a[axes].to_numpy(float), b[shape].to_numpy(float), keys, k, max_d2, bool(segments)) if len(a) and len(b) else (
            np.empty((0, k), int), np.empty((0, k)))
        hit = (idx >= 0).sum(axis=1) if len(idx) else np.empty(0, int)
        dist = np.sqrt(d2)
        vals = [b[f"_v{i}"].to_numpy(float) for i in range(len(payload))]
        rows = np.flatnonzero(hit)
        lists = {"distances": [dist[r, :hit[r]] for r in rows], "neighbours": [keys[idx[r, :hit[r]]] for r in rows]}
        lists |= {f"_v{i}": [v[idx[r, :hit[r]]] for r in rows] for i, v in enumerate(vals)}
        # a group without any hit still needs list-typed columns
        data = {"_q": a["_q"].to_numpy()[rows] if len(a) else []} | {c: pd.Series(v, dtype=object) for c, v in lists.items()}
        data |= {c: a[c].to_numpy(float)[rows] if len(a) else [] for c in own}
        for name, c in theirs.items():
            at = b[c].to_numpy(float) if len(b) else np.empty(0)
            data[name] = pd.Series([at[idx[r, :hit[r]]] for r in rows], dtype=object)
        return pd.DataFrame(data)

    found = blocks.solved(solve, out_schema)
    names = ["distances", "neighbours"] + [f"_v{i}" for i in range(len(payload))] + list(theirs)
    if blocks.merged:
        # every query has one bounded row per group: join the arrays, keep the k nearest
        zipped = found.select("_q", *own, F.arrays_zip(*names).alias("_z")).groupBy("_q").agg(F.flatten(F.collect_list("_z")).alias("_z"), *[F.first(c).alias(c) for c in own])
        best = zipped.withColumn("_z", F.slice(F.array_sort("_z"), 1, k))
        found = best.select("_q", *own, *[F.col("_z")[n].alias(n) for n in names])
    return found.select(F.col("_q").alias(query_key), "distances", "neighbours", *[F.col(f"_v{i}").alias(c) for i, c in enumerate(payload)],
                        *[F.col(a).alias(c) for a, c in zip(own, coords)], *theirs)


def stored(files: pyarrow.fs.FileSystem, folder: str, columns: Sequence[str], rows: int) -> Iterator[np.ndarray]:
    """Numeric columns of a folder of Parquet files, at most ``rows`` at a time."""
    for f in files.get_file_info(pyarrow.fs.FileSelector(folder)):
        if f.base_name.startswith((".", "_")):  # checksums
            continue
        with files.open_input_file(f.path) as source:
            for b in pyarrow.parquet.ParquetFile(source).iter_batches(rows, columns=list(columns)):
                yield np.column_stack([b[c].to_numpy(zero_copy_only=False) for c in columns])


RANGES = 256
LISTED = 4_000_000  # single values that a task lists at a time
POINTS_PER_LEAF, QUERIES_PER_BLOCK, WEIGHED = 32, 64, 2_048  # points are weighed for a block of queries at a time


def _leaves(p: np.ndarray, width: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A grid's cell of every row, and the bounds of the rows of each cell; as wide as leaves about ``most`` cells."""
    low = p.min(axis=0)
    width = max(width, float((p.max(axis=0) - low).max()) / 1024)
    while True:
        codes = ((p - low) / width).astype(np.int64)
        used = [np.bincount(c) > 0 for c in codes.T]
        if np.prod([float(u.sum()) for u in used]) <= max(most, 1.0):
            break
        width *= 1.4
    cell = np.zeros(len(p), np.int64)
    for c, u in zip(codes.T, used):
        cell = cell * int(u.sum()) + (np.cumsum(u) - 1)[c]
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    leaf = np.empty(len(p), np.int64)
    leaf[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(p))))
    return leaf, np.minimum.reduceat(p[order], starts), np.maximum.reduceat(p[order], starts)


def _kernel(cutoff: float):
    """Gaussian weights of points for queries, both in bandwidths: 0 beyond ``cutoff``, elsewhere to 12 digits.

    The exponent is a product of matrices about the queries' mean; its exponential is an entry of a table times a cubic of the rest.
    """
    low = cutoff * cutoff / 2 * (1 + 1e-12)
    n = int(np.ceil(low * 256))
    step = low / n
    table = np.append(np.exp(-(np.arange(n) + 0.5) * step), 0.0)

    def weights(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        mean = q.mean(axis=0)
        q, p = q - mean, p - mean
        left = np.column_stack([q, -0.5 * (q * q).sum(axis=1), np.ones(len(q))]) / -step
        y = left @ np.vstack([p.T, np.ones(len(p)), -0.5 * (p * p).sum(axis=1)])  # steps below 0
        np.minimum(y, n, out=y)
        k = y.astype(np.int32)
        np.subtract(k, y, out=y)
        y += 0.5
        y *= step
        w = y * (1 / 6)
        w += 0.5
        w *= y
        w += 1.0
        w *= y
        w += 1.0
        w *= table.take(k, mode="clip")
        return w

    return weights


def kernel_quantiles(queries: DataFrame, points: DataFrame, value: str, alpha: float, *, bandwidth: float, cutoff: float, query_key: str, point_key: str,
                     coords: Sequence[str], rows_per_tile: int = ROWS_PER_TILE, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """query_key, q: the smallest ``value`` at which the kernel weights of the points, in order of value, reach the share ``alpha``.

    Weights are exp(-d^2 / 2 h^2) up to ``cutoff`` bandwidths h and nothing beyond. Points are written once, by tile. A task has about
    ``rows_per_tile`` queries of one tile and reads the tiles in reach of them, ``rows_per_group`` points at a time. Where these are more, it
    adds up the weights per query and range of values first, and reads again for the single values of the one range in which the
    share is reached. Neither points nor sums are copied between tasks. Queries without a point in reach are left out.
    """
    spark, max_d2 = queries.sparkSession, (cutoff * bandwidth) ** 2
    reached = alpha * (1 - 1e-12)  # an exact share is not lost to rounding
    axes = [f"_c{i}" for i in range(len(coords))]
    numbers = [F.col(c).cast("double").alias(a) for c, a in zip(coords, axes)]
    p = cut_lineage(located(points.select(F.lit(-1).alias("_x"), *numbers, F.col(value).cast("double").alias("_v0")), axes))
    p, tiles = tile_points(p, axes, [(a, a) for a in axes], rows_per_tile)
    at = shared_folder(spark)
    # a crowded tile may be in several parts
    p.select("_tile", *axes, "_v0").repartitionByRange("_tile", *axes).sortWithinPartitions("_tile").write.partitionBy("_tile").parquet(at)
    uri = qualified(spark, at)
    points_at = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = np.unique(np.array(p.agg(F.percentile_approx("_v0", points_at, F.lit(20 * RANGES))).first()[0] or [], float))

    def read(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(coordinates, values) of all points of the tiles in reach of a box, ``rows_per_group`` at a time, by value."""
        files, folder = pyarrow.fs.FileSystem.from_uri(uri)
        held, n = [], 0

        def chunk() -> tuple[np.ndarray, np.ndarray]:
            x = np.concatenate(held)
            x = x[np.argsort(x[:, -1], kind="stable")]
            return x[:, :-1], x[:, -1]

        for t in tiles.ids[_box_distances(lo, hi, tiles.lo, tiles.hi)[0] <= max_d2 * (1 + 1e-9)]:
            for b in stored(files, f"{folder}/_tile={t}", [*axes, "_v0"], rows_per_group):
                if held and n + len(b) > rows_per_group:
                    yield chunk()
                    held, n = [], 0
                held.append(b)
                n += len(b)
        if held:
            yield chunk()

    weights = _kernel(cutoff)

    def weighed(q: np.ndarray, p: np.ndarray, r: np.ndarray, want: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query rows, rows of points in order of value, weights) block by block; with ``want``, a range a query, of points near these ranges only."""
        if not len(p):
            return
        leaf, lo, hi = _leaves(p, bandwidth / 2, len(p) / POINTS_PER_LEAF)
        for rows in _halve(q, np.arange(len(q)), QUERIES_PER_BLOCK):
            near, _ = _box_distances(q[rows].min(axis=0), q[rows].max(axis=0), lo, hi)
            cand = np.flatnonzero((near <= max_d2 * (1 + 1e-9))[leaf])
            if want is not None:
                cand = cand[(r[cand] >= want[rows].min()) & (r[cand] <= want[rows].max())]
            at = q[rows] / bandwidth
            for i in range(0, len(cand), WEIGHED):
                some = cand[i : i + WEIGHED]
                yield rows, some, weights(at, p[some] / bandwidth)

    def in_ranges(q: np.ndarray, chunks: Iterator) -> np.ndarray:
        """Of every query, the weights by range, and at most how many points have them."""
        out = np.zeros((2, len(q), len(cuts) + 1))
        for p, v in chunks:
            r = np.searchsorted(cuts, v, side="left")
            for rows, cand, w in weighed(q, p, r):
                first = np.flatnonzero(np.diff(r[cand], prepend=-1))
                at = np.ix_(rows, r[cand[first]])
                out[0][at] += np.add.reduceat(w, first, axis=1)
                out[1][at] += np.diff(np.append(first, len(cand)))
        return out

    def listed(q: np.ndarray, want: np.ndarray, before: np.ndarray, total: np.ndarray, chunks: Iterator) -> np.ndarray:
        """The value at which the share is reached, in the range ``want`` of every query."""
        parts = []
        for p, v in chunks:
            r = np.searchsorted(cuts, v, side="left")
            some = slice(*np.searchsorted(r, [want.min(), want.max() + 1]))  # in order of value
            p, v, r = p[some], v[some], r[some]
            for rows, cand, w in weighed(q, p, r, want):
                t, j = np.nonzero((w > 0) & (r[cand][None, :] == want[rows][:, None]))
                parts.append((rows[t], v[cand[j]], w[t, j]))
        t, v, w = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((v, t))
        t, v, w = t[order], v[order], w[order]
        starts = np.searchsorted(t, np.arange(len(q) + 1))
        out = np.empty(len(q))
        for k, (a, z) in enumerate(zip(starts, starts[1:])):
            share = (before[k] + np.cumsum(w[a:z])) / total[k]
            out[k] = v[a:z][min(int((share < reached).sum()), z - a - 1)]  # where rounding keeps the last value just below the share, it is that value
        return out

    def settle(a: pd.DataFrame) -> pd.DataFrame:
        q, keys = a[axes].to_numpy(float), a["_q"].to_numpy()
        first = list(islice(read(q.min(axis=0), q.max(axis=0)), 2))
        held = first if len(first) < 2 else None  # all points in reach are read once
        del first
        chunks = lambda x: held if held is not None else read(x.min(axis=0), x.max(axis=0))
        sums, counts = in_ranges(q, chunks(q))
        cum = np.cumsum(sums, axis=1)
        total = cum[:, -1]
        some = total > 0
        every = np.arange(len(q))
        share = cum / np.where(some, total, 1.0)[:, None]
        want = np.minimum((share < reached).sum(axis=1), len(cuts) - (sums[:, ::-1] > 0).argmax(axis=1))  # at most the last range with a point
        before = cum[every, want] - sums[every, want]
        size = np.where(some, counts[every, want], 0)
        out = np.full(len(q), np.nan)
        rest = np.flatnonzero(some)
        while len(rest):
            take = rest[: max(1, int(np.searchsorted(np.cumsum(size[rest]), LISTED, side="right")))]
            out[take] = listed(q[take], want[take], before[take], total[take], chunks(q[take]))
            rest = rest[len(take):]
        return pd.DataFrame({"_q": keys[some], "q": out[some]})

    q = _tag(located(queries.select(F.col(query_key).alias("_q"), *numbers), axes), axes, tiles.cuts, "_tile")
    q = cut_lineage(q)
    salts = q.groupBy("_tile").agg(F.ceil(F.count(F.lit(1)) / rows_per_tile).cast("int").alias("_salts"))  # a row per tile
    q = q.join(F.broadcast(salts), "_tile").withColumn("_salt", F.pmod(F.xxhash64("_q"), F.col("_salts")))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_type = queries.schema[query_key].dataType.simpleString()
    found = q.repartition(4 * width, "_tile", "_salt").groupBy("_tile", "_salt").applyInPandas(settle, f"_q {q_type}, q double")  # heavy per row: small tasks
    return found.withColumnRenamed("_q", query_key)


def within_radius(points: DataFrame, queries: DataFrame, radius: float, *, point_key: str, coords: Sequence[str]) -> DataFrame:
    """Points within ``radius`` of any query (J8): a nearest-query search with a cut-off."""
    q = queries.select(*coords).distinct().withColumn("_id", F.xxhash64(*coords))
    near = knn_join(points, q, 1, query_key=point_key, point_key="_id", coords=coords, max_distance=radius)
    return points.join(near.select(point_key), point_key, "left_semi")


def weighted_mean(values: str, distances: str = "distances", power: float = 2.0, eps: float = 1e-12):
    """Inverse-distance weighted mean of a neighbour array (M1)."""
    w = F.transform(distances, lambda d: 1.0 / F.pow(F.greatest(d, F.lit(eps)), F.lit(power)))
    num = F.aggregate(F.zip_with(w, values, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return num / F.aggregate(w, F.lit(0.0), lambda s, x: s + x)

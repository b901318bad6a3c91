"""Exact ranks, running totals and quantiles without a single-task window.

Values are cut into ranges per group at approximate percentiles. The cuts only balance the
load: whatever they are, ranges are ordered, so a running total inside a range plus the totals
of the ranges before it is exact. Equal values are summed before ranking, so one value that
holds a third of all rows is one row by then.

Sketches are mergeable, so a group is summed up per task, then per salt, then as a whole, and a
marginal sketch is the merge of its strata: rows are neither doubled nor shuffled by group for it.
What comes out of the sketches is one row per group. It is read by the driver behind a check of its
rows and goes back to the tasks as constants, so that every later pass sees the same cuts. These jobs run
while a plan is built.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F, types as T

from groundsieve.operators.small import checked_broadcast
from groundsieve.session import cut_lineage

_ALL = "__all"
MAX_GROUPS = 10_000  # groups whose cuts are read; more fail the job
MAX_RANGES = 1_000_000
ROWS_PER_RANGE = 20_000
SALTS = 64  # partial sketches of a group that are merged in a step of their own


def range_count(spark: SparkSession) -> int:
    """Most ranges per group: twice the shuffle width, so that they follow the cluster."""
    return max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def value_counts(df: DataFrame, groups: Sequence[str], value: str,
                 measures: Mapping[str, Column] | None = None, complete: bool = False) -> DataFrame:
    """One row per distinct value with its row count ``n`` and summed ``measures``.

    NULL values are dropped unless the caller knows there are none (``complete``); for a long
    computed value that saves pushing a copy of its formula down as a filter.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(name) for name, c in (measures or {}).items()]
    rows = df if complete else df.where(F.col(value).isNotNull())
    return rows.groupBy(*groups, value).agg(*aggs)


def sketched(df: DataFrame, groups: Sequence[str], values: Mapping[str, tuple[str, int]], aggs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per group: a quantile sketch per entry of ``values`` (name -> column, size) and the
    ``aggs`` (name -> sum, min or max, column), merged per salt first.

    No task then merges more than its share of the tasks' sketches.
    """
    salted = df.groupBy(*groups, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("__salt")).agg(
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), size).alias(name) for name, (c, size) in values.items()],
        *[getattr(F, how)(c).alias(name) for name, (how, c) in aggs.items()])
    return merged(salted, groups, values, aggs)


def merged(df: DataFrame, groups: Sequence[str], values: Mapping, aggs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Sketches and sums of finer groups as those of coarser ones."""
    return df.groupBy(*groups).agg(*[F.kll_merge_agg_double(name).alias(name) for name in values],
                                   *[getattr(F, how)(name).alias(name) for name, (how, _) in aggs.items()])


def _points(sketch: str, ranks: Sequence[float]) -> Column:
    """Approximate quantiles; an empty array where the sketch saw no value."""
    found = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(r)) for r in ranks]))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, found).otherwise(F.array().cast("array<double>"))


def gathered(df: DataFrame, bound: int) -> list[Row]:
    """The rows of a table that must not have more than ``bound``."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} groups")
    return rows


def _thinned(points: Sequence[float], pieces: int) -> list[float]:
    """Cuts for about ``pieces`` parts out of finer ones, distinct and ascending."""
    n = len(points) + 1
    return sorted({points[i - 1] for i in range(1, n) if i * pieces // n > (i - 1) * pieces // n})


def index_of(cuts: Column | str, v: Column, most: int) -> Column:
    """Number of ascending cuts below ``v``, by binary search; ``most`` bounds their number."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))])
    cuts = F.col(cuts) if isinstance(cuts, str) else cuts
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) < v, at + s).otherwise(at))


def running_totals(df: DataFrame, groups: Sequence[str], value: str, measures: Sequence[str], *,
                   tiebreak: str | None = None, descending: bool = False,
                   ranges: int | None = None, many_groups: bool = False, settle: bool = True) -> DataFrame:
    """Add ``cum_<m>`` (up to and including the row) and ``tot_<m>`` (whole group) per measure.

    Rows must be unique in ``groups + value`` (see :func:`value_counts`), or a numeric
    ``tiebreak`` must order equal values; ties are then spread over ranges of the tiebreak.
    Values are numbers. Cuts and range totals are broadcast behind a check, so rows are shuffled once, by group and range.
    ``settle`` writes ``df`` once, as it is read three times: for the cuts, the range totals and the result; leave it out for a plain scan.
    ``many_groups`` is for more than ``MAX_GROUPS`` of them: cuts then meet rows by a join on the group.
    """
    spark, n = df.sparkSession, ranges or range_count(df.sparkSession)
    g = list(groups)
    df = cut_lineage(df) if settle and not many_groups else df
    base = df.withColumn("__v", -F.col(value) if descending else F.col(value))
    if not g:
        base = base.withColumn(_ALL, F.lit(0))
        g = [_ALL]
    ranks = [i / n for i in range(1, n)]
    if many_groups:
        points = F.array(*[F.lit(r) for r in ranks])
        cuts = [F.array_distinct(F.percentile_approx(c, points, F.lit(20 * n))).alias(name) for c, name in (("__v", "__cuts"), (tiebreak, "__tcuts")) if c]
        tagged = base.join(base.groupBy(*g).agg(*cuts, *[F.sum(m).alias(f"tot_{m}") for m in measures]), g)
    else:
        size = min(65_535, max(200, 8 * n))
        sketches = {"__s": ("__v", size)} | ({"__t": (tiebreak, size)} if tiebreak else {})
        sums = {f"tot_{m}": ("sum", m) for m in measures} | {"__rows": ("sum", "__one")}
        stats = sketched(base.withColumn("__one", F.lit(1).cast("long")), g, sketches, sums)
        totals = [f"tot_{m}" for m in measures]
        stats = stats.select(*g, *totals, "__rows", *[_points(s, ranks).alias(s) for s in sketches])
        local = []
        for r in gathered(stats, MAX_GROUPS):
            pieces = n if ranges else min(n, -(-r["__rows"] // ROWS_PER_RANGE))
            local.append((*[r[c] for c in g + totals], *[_thinned(r[s], pieces) for s in sketches]))
        fields = [stats.schema[c] for c in g + totals] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("__cuts", "__tcuts")[: len(sketches)]]
        tagged = base.join(F.broadcast(spark.createDataFrame(local, T.StructType(fields))), g)
    tagged = tagged.withColumn("__range", index_of("__cuts", F.col("__v"), n))
    order = [F.col("__v")]
    if tiebreak:
        order.append(F.col(tiebreak))
        tagged = tagged.withColumn("__sub", F.when(F.get("__cuts", F.col("__range")) == F.col("__v"),
                                                   index_of("__tcuts", F.col(tiebreak), n) + 1).otherwise(0))
    else:
        tagged = tagged.withColumn("__sub", F.lit(0))
    tagged = tagged.drop("__cuts", "__tcuts")
    key = g + ["__range", "__sub"]
    before = W.partitionBy(*g).orderBy("__range", "__sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = tagged.groupBy(*key).agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    offsets = offsets.select(
        *key,
        *[F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures])
    inside = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = tagged.join(offsets if many_groups else checked_broadcast(offsets, MAX_RANGES), key)
    out = out.withColumns({f"cum_{m}": F.col(f"__o_{m}") + F.sum(m).over(inside) for m in measures})
    return out.drop(_ALL, "__v", "__range", "__sub", *[f"__o_{m}" for m in measures])


def row_numbers(df: DataFrame, groups: Sequence[str], value: str, tiebreak: str, *,
                descending: bool = False, name: str = "rn", total: str | None = None) -> DataFrame:
    """Exact 1-based position of every row by ``value`` then ``tiebreak``, per group."""
    out = running_totals(df.withColumn("__unit", F.lit(1).cast("long")), groups, value, ["__unit"],
                         tiebreak=tiebreak, descending=descending, settle=False)
    out = out.withColumnRenamed("cum___unit", name).drop("__unit")
    return out.withColumnRenamed("tot___unit", total) if total else out.drop("tot___unit")


SKETCH = 4_096  # a sketch of this size misses a rank by about 0.13 % of the rows in one case of a hundred
MARGIN = 0.004  # so this is three times that; a bracket that misses its rank all the same is widened
HELD = 1_000_000  # values inside brackets that the driver reads; larger brackets are refined first
CELLS = 4_096


class Wanted(NamedTuple):
    """A target: the share of its rank, and the 1-based ranks to read of n values."""

    share: float
    ranks: Callable[[int], Sequence[int]]


class _Request(NamedTuple):
    """One target of one group: members are the strata it consists of."""

    group: int
    target: str
    ranks: list[int]
    low: float
    high: float


def selected(df: DataFrame, groups: Sequence[str], value: str, wanted: Mapping[str, Wanted], rollup: str | None = None,
             held: int | None = None, margin: float = MARGIN) -> list[tuple[tuple, int, dict[str, list[float]]]]:
    """(group, rows, target -> values at its ranks) of every group; exact, without sorting.

    A sketch per group brackets the wanted rank. A second pass reduces every row, in its task, to a count: below, between or
    beyond the brackets by cell, or by its value inside one. Only these counts are shuffled, and written once. The cells' sums
    give the rank inside the bracket. Brackets with more than ``held`` values are refined by histograms of ``CELLS`` cells
    until the rest is small, so what the driver reads is bounded whatever the table's size.

    With ``rollup`` rows are counted once per stratum of that column. A marginal group, its stratum None in a list of its own, has its
    sketch merged and its counts added up from its strata; its key is (*groups,), a stratum's is (*groups, stratum).
    """
    held = HELD if held is None else held
    spark, g = df.sparkSession, list(groups)
    fine = [*g, rollup] if rollup else g
    ranks = [r for w in wanted.values() for r in (max(0.0, w.share - margin), min(1.0, w.share + margin))]
    rows = df.select(*fine, F.col(value).cast("double").alias("__v"), F.lit(1).cast("long").alias("__one")).where(F.col("__v").isNotNull())
    sketches, aggs = {"__k": ("__v", SKETCH)}, {"__n": ("sum", "__one"), "__min": ("min", "__v"), "__max": ("max", "__v")}
    own = sketched(rows, fine, sketches, aggs)
    levels = [(own, fine)]
    if rollup:
        own = cut_lineage(own)  # a row per stratum
        levels = [(own, fine), (merged(own, g, sketches, aggs), g)]
    keys, sizes, boxes = [], [], []  # per group, strata first
    for stats, by in levels:
        for r in gathered(stats.select(*by, "__n", "__min", "__max", _points("__k", ranks).alias("__at")), MAX_GROUPS):
            if not r["__n"]:
                continue
            small, at = r["__n"] <= SKETCH // 4, r["__at"]
            keys.append(tuple(r[c] for c in by))
            sizes.append(r["__n"])
            boxes.append([(r["__min"] if small or ranks[2 * i] <= 0 or not at else at[2 * i],
                           r["__max"] if small or ranks[2 * i + 1] >= 1 or not at else at[2 * i + 1]) for i in range(len(wanted))])
    strata = [k for k, key in enumerate(keys) if len(key) == len(fine)]
    whole = {key: k for k, key in enumerate(keys) if len(key) == len(g)} if rollup else {}
    members: dict[int, list[int]] = {k: [k] for k in strata} | {k: [] for k in whole.values()}
    edges: dict[int, np.ndarray] = {}
    for k in strata:
        mine = list(boxes[k])
        if rollup:
            parent = whole[keys[k][: len(g)]]
            members[parent].append(k)
            mine += boxes[parent]
        edges[k] = np.unique(np.array(mine, float))

    def cell(k: int, v: float) -> int:
        """Of a value: even between edges, odd on one."""
        at = int(np.searchsorted(edges[k], v))
        return 2 * at + (at < len(edges[k]) and edges[k][at] == v)

    local = []
    for k in strata:
        inside = np.zeros(2 * len(edges[k]) + 1, bool)
        for low, high in [*boxes[k], *(boxes[whole[keys[k][: len(g)]]] if rollup else [])]:
            inside[cell(k, low) : cell(k, high) + 1] = True
        local.append((*keys[k], k, edges[k].tolist(), inside.tolist()))
    fields = [rows.schema[c] for c in fine] + [T.StructField("__g", T.IntegerType()), T.StructField("__edges", T.ArrayType(T.DoubleType())),
                                               T.StructField("__inside", T.ArrayType(T.BooleanType()))]
    if not local:
        return []
    table = F.broadcast(spark.createDataFrame(local, T.StructType(fields)))
    v = F.col("__v")
    if fine:
        same = [rows[c].eqNullSafe(table[c]) for c in fine]
        met = rows.join(table, _all(same)).select("__g", "__edges", "__inside", "__v")
    else:
        k, e, i = local[0]
        met = rows.select("__v", F.lit(k).alias("__g"), F.array(*[F.lit(x) for x in e]).alias("__edges"), F.array(*[F.lit(x) for x in i]).alias("__inside"))
    most = max(len(e) for e in edges.values())
    met = met.select("__g", "__v", "__edges", "__inside", index_of("__edges", v, most).alias("__i"))
    met = met.select("__g", "__v", "__inside", (2 * F.col("__i") + F.coalesce((F.get("__edges", F.col("__i")) == v).cast("int"), F.lit(0))).alias("__cell"))
    counted = cut_lineage(met.groupBy("__g", "__cell", F.when(F.get("__inside", F.col("__cell")), v).alias("__v")).agg(F.count(F.lit(1)).alias("n")))
    sums: dict[tuple[int, int], int] = {}
    values = 0
    for r in gathered(counted.groupBy("__g", "__cell").agg(F.sum("n").alias("n"), F.count("__v").alias("values")), MAX_GROUPS * (2 * most + 1)):
        sums[r["__g"], r["__cell"]] = r["n"]
        values += r["values"]
    requests = []
    for k, below in members.items():
        for (name, w), (low, high) in zip(wanted.items(), boxes[k]):
            less = sum(n for (m, c), n in sums.items() if m in below and c < cell(m, low))
            upto = sum(n for (m, c), n in sums.items() if m in below and c <= cell(m, high))
            need = list(w.ranks(sizes[k]))
            if min(need) <= less or max(need) > upto:
                return selected(df, groups, value, wanted, rollup, held, min(1.0, 8 * margin))
            requests.append(_Request(k, name, [r - less for r in need], low, high))
    inside = counted.where("__v is not null").select("__g", "__v", "n")
    if values > held:
        requests, inside = _refined(inside, requests, members, held)
    found = inside.toPandas()
    gid, val, cnt = found["__g"].to_numpy(), found["__v"].to_numpy(float), found["n"].to_numpy(np.int64)
    order = np.argsort(val, kind="stable")
    gid, val, cnt = gid[order], val[order], cnt[order]
    of = {k: np.flatnonzero(np.isin(gid, members[k])) for k in members}
    out = {k: {} for k in members}
    for q in requests:
        at = of[q.group]
        at = at[(val[at] >= q.low) & (val[at] <= q.high)]
        cum = np.cumsum(cnt[at])
        out[q.group][q.target] = [float(val[at[np.searchsorted(cum, r)]]) for r in q.ranks]
    return [(keys[k], sizes[k], out[k]) for k in members]


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _refined(values: DataFrame, requests: list[_Request], members: Mapping[int, list[int]], held: int) -> tuple[list[_Request], DataFrame]:
    """Narrower brackets of the same ranks, and the values inside any of them, ``held`` at most unless a rank's cell cannot shrink."""
    spark = values.sparkSession
    while True:
        local = [(m, i, q.low, q.high) for i, q in enumerate(requests) for m in members[q.group]]
        table = F.broadcast(spark.createDataFrame(local, "__g int, r int, low double, high double"))
        met = values.join(table, "__g").where(F.col("__v").between(F.col("low"), F.col("high")))
        span = F.col("high") - F.col("low")
        bin_ = F.when(span > 0, F.floor((F.col("__v") - F.col("low")) / span * CELLS)).otherwise(0)
        cells = met.groupBy("r", bin_.alias("bin")).agg(F.sum("n").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"), F.count(F.lit(1)).alias("k"))
        by: dict[int, list[Row]] = {}
        for c in gathered(cells, len(requests) * (CELLS + 1)):
            by.setdefault(c["r"], []).append(c)
        fresh, left, moved = [], 0, False
        for i, q in enumerate(requests):
            cum = 0
            kept = []
            for c in sorted(by[i], key=lambda c: c["bin"]):
                if cum < max(q.ranks) and cum + c["n"] >= min(q.ranks):
                    kept.append((cum, c))
                cum += c["n"]
            low, high, before = kept[0][1]["low"], kept[-1][1]["high"], kept[0][0]
            moved |= (low, high) != (q.low, q.high)
            left += sum(c["k"] for _, c in kept)
            fresh.append(q._replace(ranks=[r - before for r in q.ranks], low=low, high=high))
        requests = fresh
        if left <= held or not moved:
            local = [(m, q.low, q.high) for q in requests for m in members[q.group]]
            table = F.broadcast(spark.createDataFrame(local, "__g int, low double, high double"))
            return requests, values.join(table, "__g").where(F.col("__v").between(F.col("low"), F.col("high"))).select("__g", "__v", "n").distinct()


def _frame(df: DataFrame, groups: Sequence[str], rows: list[tuple], more: str) -> DataFrame:
    """A result of one row per group (and target) as a DataFrame: the groups' own types, then ``more``."""
    fields = [T.StructField(c, df.schema[c].dataType) for c in groups] + T._parse_datatype_string(more).fields
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles, one column per name, plus the row count ``n``."""
    at = lambda p: lambda n: (math.floor((n - 1) * p) + 1, math.ceil((n - 1) * p) + 1)
    rows = []
    for key, n, found in selected(df, groups, value, {name: Wanted(p, at(p)) for name, p in probs.items()}):
        share = [(n - 1) * p - math.floor((n - 1) * p) for p in probs.values()]
        rows.append((*key, n, *[lo + (hi - lo) * s for (lo, hi), s in zip((found[name] for name in probs), share)]))
    return _frame(df, groups, rows, "n long, " + ", ".join(f"`{name}` double" for name in probs))


def conformal_rank(n: int, alpha: float) -> int:
    """k = clip(ceil((n + 1) * alpha), 1, n)."""
    return min(max(math.ceil((n + 1) * alpha), 1), n)


def order_statistics(df: DataFrame, groups: Sequence[str], score: str, alphas: Sequence[float], rollup: str | None = None, whole: str = "*") -> DataFrame:
    """Finite-sample conformal quantile of ``score``: one row per group and alpha; with ``rollup`` per stratum too, and ``whole``."""
    wanted = {f"a{i}": Wanted(a, lambda n, a=a: (conformal_rank(n, a),)) for i, a in enumerate(alphas)}
    rows = []
    for key, n, found in selected(df, groups, score, wanted, rollup):
        if rollup:
            last = whole if len(key) == len(groups) else key[-1]
            key = (*key[: len(groups)], None if last is None else str(last))
        rows += [(*key, n, float(a), found[f"a{i}"][0]) for i, a in enumerate(alphas)]
    return _frame(df, groups, rows, ("stratum string, " if rollup else "") + "n_cal long, alpha double, q double")

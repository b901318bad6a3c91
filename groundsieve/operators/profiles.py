"""Borehole profiles to endpoints. A borehole is the rows of one (lat, lon)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundsieve.functions.numeric import bin_index, DEPTH_EDGES
from groundsieve.functions.ordered import quantiles

LOC = ["latitude_deg", "longitude_deg"]
UPPER_DEPTH_M = 10.0
STIFF_N = 30.0
SOFT_N = 5.0
STIFF_WITHIN_M = 30.0
BAND_M = 0.5
PROFILE_BAND_M = 5.0


def profile_order(df: DataFrame, depth: str = "depth_from_surface", key: str = "row_key") -> DataFrame:
    """Rows with their position ``seq`` in the profile, shallowest first, ties by key (A1).

    Boreholes grow in number with the data, so nothing is kept per borehole on the driver: rows are
    ranked inside bands of depth, after the counts of the bands above. No depth (NaN, then NULL) is last.
    """
    d = F.col(depth).cast("double")
    last = F.lit(2**63 - 1)
    rows = df.withColumn("_band", F.when(d.isNull() | F.isnan(d), last).otherwise(F.floor(d / PROFILE_BAND_M)))
    sizes = rows.groupBy(*LOC, "_band").agg(F.count(F.lit(1)).alias("_n"))
    hole = W.partitionBy(*LOC)
    above = hole.orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in LOC], F.col("_band").alias("__band"),
                         F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"), F.sum("_n").over(hole).alias("n_in_profile"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*LOC, "_band"]])
    inside = W.partitionBy(*LOC, "_band").orderBy(F.col(depth).asc_nulls_last(), F.col(key).asc_nulls_last())
    out = rows.withColumn("_at", F.row_number().over(inside)).join(sizes, same)
    return out.select(*df.columns, (F.col("_above") + F.col("_at")).alias("seq"), "n_in_profile")


def first_crossing(threshold: float, mode: str = "above", depth: str = "depth_from_surface", n: str = "n_value") -> Column:
    """Aggregate: first depth with N >= threshold (above) or N < threshold (below); NULL is censored (A2)."""
    if mode not in ("above", "below"):
        raise ValueError(f"mode must be above or below, got {mode!r}")
    hit = F.col(n) >= threshold if mode == "above" else F.col(n) < threshold
    return F.min(F.when(hit, F.col(depth)))


def in_depth_range(value: Column, z0: float = 0.0, z1: float = UPPER_DEPTH_M, depth: str = "depth_from_surface") -> Column:
    """``value`` where depth is in [z0, z1], for any aggregate around it (A4)."""
    return F.when(F.col(depth).between(z0, z1), value)


def soft_thickness(df: DataFrame, threshold: float = SOFT_N, z0: float = 0.0, z1: float = UPPER_DEPTH_M,
                   depth: str = "depth_from_surface", n: str = "n_value") -> DataFrame:
    """Per borehole: summed gaps between neighbouring readings that are both in [z0, z1] and soft (A3).

    Only in-band rows can be neighbours of interest, so the band filter comes first. Readings of
    one depth collapse to their softest and hardest before any window (order is depth, then N),
    and neighbours are then sought inside half-metre bands; a second step over at most
    (z1 - z0) / 0.5 rows per borehole links each band's last reading to the next band's first.
    """
    d = F.col(depth)
    levels = (df.where(d.between(z0, z1)).groupBy(*LOC, d.alias("_z"))
              .agg(F.min(n).alias("_lo"), F.max(n).alias("_hi")))
    levels = levels.select(*LOC, "_z", F.floor(F.col("_z") / BAND_M).alias("_band"),
                           (F.col("_lo") < threshold).alias("_in"), (F.col("_hi") < threshold).alias("_out"))
    w = W.partitionBy(*LOC, "_band").orderBy("_z")
    gap = F.when(F.lag("_out").over(w) & F.col("_in"), F.col("_z") - F.lag("_z").over(w)).otherwise(0.0)
    bands = levels.withColumn("_gap", gap).groupBy(*LOC, "_band").agg(
        F.sum("_gap").alias("_t"), F.min(F.struct("_z", "_in")).alias("_first"), F.max(F.struct("_z", "_out")).alias("_last"))
    v = W.partitionBy(*LOC).orderBy("_band")
    link = F.when(F.lag("_last").over(v)["_out"] & F.col("_first._in"),
                  F.col("_first._z") - F.lag("_last").over(v)["_z"]).otherwise(0.0)
    return (bands.withColumn("_l", link).groupBy(*LOC)
            .agg((F.sum("_t") + F.sum("_l")).alias("soft_thickness_lt5_0_to_10m")))


def endpoints(df: DataFrame, statics: Sequence[str] = ("regime_code", "river_distance_km", "coast_distance_km", "absolute_elevation"),
              depth: str = "depth_from_surface", n: str = "n_value") -> DataFrame:
    """One row per borehole (A5) with static covariates of the shallowest row."""
    d30 = first_crossing(STIFF_N, "above", depth, n)
    base = df.groupBy(*LOC).agg(
        d30.alias("depth_to_first_n30"),
        F.avg(in_depth_range(F.col(n), depth=depth)).alias("mean_n_upper_10m"),
        F.min(in_depth_range(F.col(n), depth=depth)).alias("min_n_upper_10m"),
        F.count(F.lit(1)).alias("n_rows_in_boring"), F.max(depth).alias("max_depth_observed"),
        F.min(F.struct(F.col(depth), F.col(n), *[F.col(c) for c in statics])).alias("_top"))
    soft = soft_thickness(df, depth=depth, n=n)
    out = base.join(soft, LOC, "left")
    return out.select(
        *LOC, "depth_to_first_n30",
        F.when(F.col("depth_to_first_n30") <= STIFF_WITHIN_M, 1).otherwise(0).alias("has_n30_within_30m"),
        F.coalesce("soft_thickness_lt5_0_to_10m", F.lit(0.0)).alias("soft_thickness_lt5_0_to_10m"),
        "mean_n_upper_10m", "min_n_upper_10m", "n_rows_in_boring", "max_depth_observed",
        *[F.col(f"_top.{c}").alias(c) for c in statics])


def location_summary(df: DataFrame, means: Sequence[str], code: str = "regime_code") -> DataFrame:
    """Per location: means of covariates and the mode of a code, lowest on a tie."""
    return df.groupBy(*LOC).agg(*[F.avg(c).alias(c) for c in means], F.mode(code, deterministic=True).alias(code))


def histogram(df: DataFrame, n: str = "n_value") -> DataFrame:
    """2-wide histogram over 0..100; 100 joins the last bin."""
    b = F.least(F.floor(F.col(n) / 2), F.lit(49)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def depth_quartiles(df: DataFrame, depth: str = "depth_from_surface", n: str = "n_value") -> DataFrame:
    """Exact quartiles of N per depth bin."""
    binned = df.select(bin_index(F.col(depth), DEPTH_EDGES).alias("depth_bin"), n)
    return quantiles(binned, ["depth_bin"], n, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def spikes(df: DataFrame, n: str = "n_value") -> DataFrame:
    """Rows exactly at 0, 50 and 100."""
    return df.agg(*[F.sum((F.col(n) == v).cast("long")).alias(f"n_at_{v}") for v in (0, 50, 100)])


def survival_table(ep: DataFrame) -> DataFrame:
    """Time to first stiff reading, or the deepest reading if censored; floor 0.1 m."""
    return ep.withColumns({
        "surv_time": F.greatest(F.coalesce("depth_to_first_n30", "max_depth_observed"), F.lit(0.1)),
        "surv_event": F.col("depth_to_first_n30").isNotNull().cast("int")})


def aggregate_profile(df: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
    """Any aggregates per borehole."""
    return df.groupBy(*LOC).agg(*[c.alias(k) for k, c in aggregates.items()])

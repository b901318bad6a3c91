"""Row quality control, samples and completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.functions.ordered import row_numbers
from groundsieve.operators.small import checked_broadcast
from groundsieve.sources.measurements import KEYS

# Accepted ranges and region presets (lat_min, lon_min, lat_max, lon_max).
LAT_RANGE, LON_RANGE, ELEVATION_RANGE, N_RANGE = (20.0, 50.0), (120.0, 150.0), (-1000.0, 5000.0), (0.0, 100.0)
REGIONS = {
    "japan": (24.0, 122.0, 46.0, 146.5),
    "kanto": (35.0, 138.5, 37.5, 141.0),
    "tohoku": (37.0, 139.0, 41.5, 142.5),
    "abukuma": (36.7, 140.0, 37.6, 140.7),
    "kinki": (33.5, 134.0, 35.5, 137.0),
}
CORRECTION_BOX = (34.85, 138.40, 37.20, 141.00)


def has_keys(keys: Sequence[str] = KEYS) -> Column:
    """All key columns are present and not NaN (F1)."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull() & ~F.isnan(k)
    return out


def coordinates_ok() -> Column:
    lat, lon = F.col("latitude_deg"), F.col("longitude_deg")
    return (lat > LAT_RANGE[0]) & (lat < LAT_RANGE[1]) & (lon > LON_RANGE[0]) & (lon < LON_RANGE[1])


def elevation_ok() -> Column:
    return (F.col("mouth_elevation") > ELEVATION_RANGE[0]) & (F.col("mouth_elevation") < ELEVATION_RANGE[1])


def n_ok() -> Column:
    return F.col("n_value").between(*N_RANGE)


def clean(df: DataFrame) -> DataFrame:
    """Null and range checks (F1, F2)."""
    return df.where(has_keys() & coordinates_ok() & elevation_ok() & n_ok())


def in_box(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Bounding-box filter, inclusive on all sides."""
    lat0, lon0, lat1, lon1 = box
    return df.where(F.col("latitude_deg").between(lat0, lat1) & F.col("longitude_deg").between(lon0, lon1))


def derive(df: DataFrame) -> DataFrame:
    """Depth and absolute elevation."""
    return df.withColumns({"depth_from_surface": F.col("spt_start_depth"),
                           "absolute_elevation": F.col("mouth_elevation") - F.col("spt_start_depth")})


def funnel(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows and boreholes left after each check, and rows at the cap of 100.

    One pass counts per location how far its rows get; distinct locations are then plain counts.
    """
    lat0, lon0, lat1, lon1 = box
    inside = F.col("latitude_deg").between(lat0, lat1) & F.col("longitude_deg").between(lon0, lon1)
    names = ("raw", "keys", "coordinates", "elevation", "n_range", "box")
    stage = F.lit(0)
    ok = F.lit(True)
    for check in (has_keys(), coordinates_ok(), elevation_ok(), n_ok(), inside):
        ok = ok & F.coalesce(check, F.lit(False))
        stage = stage + ok.cast("int")
    per = df.withColumn("_s", stage).groupBy("latitude_deg", "longitude_deg").agg(
        *[F.sum((F.col("_s") >= i).cast("long")).alias(f"r{i}") for i in range(len(names))],
        F.sum(((F.col("_s") == len(names) - 1) & (F.col("n_value") == 100)).cast("long")).alias("cap"))
    wide = per.agg(*[F.sum(f"r{i}").alias(f"rows{i}") for i in range(len(names))],
                   *[F.sum((F.col(f"r{i}") > 0).cast("long")).alias(f"holes{i}") for i in range(len(names))],
                   F.sum("cap").alias("n_at_cap"))
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("check"), F.col(f"rows{i}").alias("n_rows"),
                 F.col(f"holes{i}").alias("n_boreholes"), F.col("n_at_cap").alias("n_at_cap"))
        for i, n in enumerate(names)])))


def exact_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows without replacement, reproducible: smallest hashes first."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def fraction_sample(df: DataFrame, fraction: float, key: str, seed: int) -> DataFrame:
    """Every row with the same chance, reproducible and without a shuffle: hashes below the fraction."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10)
    return df.where((digits.cast("double") + 0.5) / F.lit(float(1 << 48)) < F.lit(float(fraction)))


def tempered_budgets(counts: DataFrame, group: str, total: int) -> DataFrame:
    """Per-group budgets proportional to sqrt(count), clamped to the group size; what is missing
    to ``total`` goes to the largest group as far as it has rows (F7). Columns: group, n, budget."""
    c = checked_broadcast(counts, 10_000)
    sums = counts.agg(F.sum(F.sqrt("n"))).scalar()
    b = c.withColumn("_b", F.least(F.col("n"), F.floor(F.lit(total) * F.sqrt("n") / sums)))
    state = b.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg_n"), F.col(group).alias("g"), F.col("_b").alias("b")))).alias("s"))
    s = state.select(F.explode("s").alias("x"), (F.lit(total) - F.aggregate(
        "s", F.lit(0).cast("long"), lambda acc, x: acc + x["b"])).alias("deficit"), F.col("s")[0]["g"].alias("top"))
    extra = F.when(F.col("x.g") == F.col("top"), F.greatest(F.col("deficit"), F.lit(0))).otherwise(0)
    return s.select(F.col("x.g").alias(group), (-F.col("x.neg_n")).alias("n"),
                    F.least(-F.col("x.neg_n"), F.col("x.b") + extra).alias("budget"))


def stratified_sample(df: DataFrame, group: str, key: str, order: Column, total: int) -> DataFrame:
    """Rows of each group up to its tempered budget, in ``order`` (a numeric hash), ties by key."""
    budgets = tempered_budgets(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group, total)
    ranked = row_numbers(df.withColumn("_o", order), [group], "_o", key)
    return (ranked.join(checked_broadcast(budgets.select(group, "budget"), 10_000), group)
            .where("rn <= budget").drop("_o", "rn", "budget"))


def missing_guard(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), warn: float = 0.05, fail: float = 0.20) -> DataFrame:
    """Share of rows lost to nulls, with a verdict ok, warn or fail (F8)."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    share = F.avg(F.when(complete, 0.0).otherwise(1.0))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), share.alias("dropped_share"))
    return out.withColumn("verdict", F.when(F.col("dropped_share") > fail, "fail")
                          .when(F.col("dropped_share") > warn, "warn").otherwise("ok"))


def require_complete(df: DataFrame, columns: Sequence[str], fail: float = 0.20) -> DataFrame:
    """Rows without nulls; an error before any fit if more than ``fail`` would be lost (F8)."""
    row = missing_guard(df, columns, fail=fail).first()
    if row and row["dropped_share"] is not None and row["dropped_share"] > fail:
        raise ValueError(f"{row['dropped_share']:.1%} of rows have missing covariates")
    return df.dropna(subset=list(columns))


def completeness(df: DataFrame, inputs: Mapping[str, Column]) -> DataFrame:
    """Share of rows that carry each correction input."""
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(F.when(c.isNotNull(), 1.0).otherwise(0.0)).alias(k) for k, c in inputs.items()])
    return wide.select("n_rows", F.inline(F.array(*[
        F.struct(F.lit(k).alias("input"), F.col(k).alias("share")) for k in inputs])))

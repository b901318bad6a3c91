"""Legend payloads and code lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.operators.small import checked_broadcast

LEGEND_FIELDS = ("symbol", "formation_age_ja", "group_ja", "lithology_ja")
MAX_CODES = 100_000


def rounded_key(c: str) -> Column:
    """Coordinate at 4 decimals, half to even on the scaled value."""
    return F.rint(F.col(c) * 1e4) / 1e4


def parse_legend(df: DataFrame, payload: str) -> DataFrame:
    """Legend JSON to its four fields, null to '' (S6)."""
    schema = ", ".join(f"{f} string" for f in LEGEND_FIELDS)
    parsed = df.withColumn("_j", F.from_json(payload, schema))
    return parsed.withColumns({f: F.coalesce(F.col(f"_j.{f}"), F.lit("")) for f in LEGEND_FIELDS}).drop("_j", payload)


def regime_of_code(df: DataFrame, lookup: DataFrame, code: str = "code", default: int = 7) -> DataFrame:
    """Code list lookup with a default regime."""
    table = checked_broadcast(lookup.select(F.col("code").alias("_code"), F.col("regime").alias("_regime")), MAX_CODES)
    return (df.join(table, F.col(code) == F.col("_code"), "left")
            .withColumn("regime", F.coalesce("_regime", F.lit(default))).drop("_code", "_regime"))


def normalise_age(df: DataFrame, age: str = "age_code", default: int = 4) -> DataFrame:
    """Missing column or null becomes the default age code."""
    return df.withColumn(age, F.coalesce(F.col(age), F.lit(default)) if age in df.columns else F.lit(default))


def distinct_codes(df: DataFrame, code: str) -> DataFrame:
    """Sidecar of all codes seen."""
    return df.select(code).distinct()


def upsert_cache(cache: DataFrame, points: DataFrame, legend: DataFrame) -> DataFrame:
    """Add rounded coordinates not yet cached; a miss in the legend is stored as empty."""
    key = ["lat", "lon"]
    wanted = points.select(rounded_key("latitude_deg").alias("lat"), rounded_key("longitude_deg").alias("lon")).distinct()
    fresh = wanted.join(cache, key, "left_anti").join(legend.select(*key, *LEGEND_FIELDS).dropDuplicates(key), key, "left")
    return cache.select(*key, *LEGEND_FIELDS).unionByName(
        fresh.select(*key, *[F.coalesce(f, F.lit("")).alias(f) for f in LEGEND_FIELDS]))


def with_legend(points: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join on 4-decimal coordinates, same rounding on both sides."""
    c = cache.select(rounded_key("lat").alias("_lat"), rounded_key("lon").alias("_lon"), *LEGEND_FIELDS)
    p = points.withColumns({"_lat": rounded_key("latitude_deg"), "_lon": rounded_key("longitude_deg")})
    return p.join(c, ["_lat", "_lon"], "left").drop("_lat", "_lon")

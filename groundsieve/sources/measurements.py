"""Measurement readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RAW_SCHEMA = T.StructType([
    T.StructField("latitude_deg", T.DoubleType()),
    T.StructField("longitude_deg", T.DoubleType()),
    T.StructField("spt_start_depth", T.DoubleType()),
    T.StructField("n_value", T.DoubleType()),
    T.StructField("mouth_elevation", T.DoubleType()),
])
REQUIRED = ("longitude_deg", "latitude_deg", "spt_start_depth", "n_value")
KEYS = ("latitude_deg", "longitude_deg", "n_value", "spt_start_depth", "mouth_elevation")
ENRICHED = {
    "latitude_deg": "float", "longitude_deg": "float", "depth_from_surface": "float",
    "absolute_elevation": "float", "n_value": "float", "river_distance_km": "float",
    "coast_distance_km": "float", "regime_code": "smallint",
}


def require_columns(df: DataFrame, required=REQUIRED) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Raw measurements (S1). Columns are matched to the file's header by name; types are never
    inferred; a missing ``mouth_elevation`` is 0.0."""
    names = header or spark.read.option("header", True).csv(path).columns
    types = {f.name: f.dataType for f in RAW_SCHEMA}
    schema = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    require_columns(df)
    if "mouth_elevation" not in df.columns:
        df = df.withColumn("mouth_elevation", F.lit(0.0))
    return df.select(*[f.name for f in RAW_SCHEMA])


def read_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns only (S2); the scan reads nothing else."""
    return require_columns(spark.read.parquet(path), columns).select(*columns)


def final_schema(df: DataFrame) -> DataFrame:
    """The eight enriched columns in their storage types (S3)."""
    require_columns(df, tuple(ENRICHED))
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in ENRICHED.items()])


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write the enriched table (S3). Partitioning by primary mesh clusters rows for box scans;
    rows are spread by cell and depth first, so a crowded cell does not become one file."""
    out = df
    if partition_by:
        out = df.repartition(*partition_by, F.pmod(F.xxhash64("depth_from_surface"), F.lit(16)))
        out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        out.write.mode("overwrite").parquet(path)

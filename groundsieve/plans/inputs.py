"""Borehole views over the benchmark tables.

One part is one borehole and one line item is one depth reading. Every column is computed from
its own row, so the views add no shuffle. The same expressions run in Spark (``selectExpr``) and
in the check SQL (``raw_cte``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_BASE = [
    "l_partkey as boring_key",
    "l_orderkey as ok",
    "cast(l_linenumber as bigint) as ln",
    "(l_orderkey * 8 + l_linenumber) * 10000000 + cast(round(l_extendedprice * 100e0) as bigint) as row_key",
    "35e0 + cast((l_partkey * 7919117) % 2500003 as double) / 1000000e0 as latitude_deg",
    "138.5e0 + cast((l_partkey * 104729213) % 2477003 as double) / 1000000e0 as longitude_deg",
    "cast((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 6000 as double) / 100e0 as spt_start_depth",
    "cast((l_partkey * 13) % 400 - 5 as double) as mouth_elevation",
    "l_quantity * l_quantity * l_quantity * l_quantity / 62500e0 as q4",
    "cast(case when (l_partkey*31)%100 < 67 then 0 when (l_partkey*31)%100 < 85 then 1 "
    "when (l_partkey*31)%100 < 86 then 2 when (l_partkey*31)%100 < 90 then 3 "
    "when (l_partkey*31)%100 < 93 then 4 when (l_partkey*31)%100 < 94 then 5 "
    "when (l_partkey*31)%100 < 95 then 6 else 7 end as int) as regime_code",
    "cast((l_partkey * 17) % 300 as double) / 10e0 as river_distance_km",
    "cast((l_partkey * 29) % 900 as double) / 10e0 as coast_distance_km",
    "case when l_partkey % 5 = 0 then null else cast((l_partkey * 7) % 20 as double) end as groundwater_depth_m",
    "cast((l_partkey * 11) % 15 as int) as litho_macro_code",
]
_VALUE = [
    "*",
    "spt_start_depth as depth_from_surface",
    "mouth_elevation - spt_start_depth as absolute_elevation",
    "cast(floor(latitude_deg * 12e0) as bigint) as mesh_row",
    "cast(floor((longitude_deg - 100e0) * 8e0) as bigint) as mesh_col",
    "case when boring_key % 3 = 0 then least(floor(q4 * (0.3e0 + spt_start_depth / 40e0)), 100e0) "
    "else least(floor(q4 * (0.3e0 + spt_start_depth / 40e0)), 29e0) end as n0",
]
_FINAL = [
    "boring_key", "ok", "ln", "row_key", "latitude_deg", "longitude_deg", "spt_start_depth",
    "mouth_elevation", "regime_code", "river_distance_km", "coast_distance_km", "groundwater_depth_m",
    "litho_macro_code", "depth_from_surface", "absolute_elevation", "mesh_row", "mesh_col",
    "cast(n0 as double) as n_value",
]
# Predictions: folds and calibration cells are whole mesh cells.
_PRED = [
    "*",
    "n_value as y_true",
    "0.6e0 * n_value + 0.2e0 * depth_from_surface + 0.5e0 * cast((ok * 37 + ln * 11) % 13 - 6 as double) as y_pred",
    "2e0 + 0.08e0 * n_value + 0.3e0 * cast(regime_code as double) as y_std",
    "cast((mesh_row + 2 * mesh_col) % 3 as int) as fold",
    "case when (mesh_row * 3 + mesh_col * 7) % 5 < 2 then 'cal' else 'test' end as role",
    "cast(case when depth_from_surface >= 50e0 then 5 when depth_from_surface >= 20e0 then 4 "
    "when depth_from_surface >= 10e0 then 3 when depth_from_surface >= 5e0 then 2 "
    "when depth_from_surface >= 2e0 then 1 else 0 end as int) as depth_bin",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_READ = ["l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
_ROW_KEY = next(e for e in _BASE if e.endswith(" as row_key")).removesuffix(" as row_key")


def spread(spark: SparkSession, sf: str) -> DataFrame:
    """The five columns that all others are computed from, spread evenly by row key and kept."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf, "lineitem").select(*_READ).repartition(n, F.expr(_ROW_KEY)).persist()


def measurements(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """The view over the table, or over ``rows`` of it."""
    rows = table(spark, sf, "lineitem") if rows is None else rows
    return rows.selectExpr(*_BASE).selectExpr(*_VALUE).selectExpr(*_FINAL)


def predictions(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return measurements(spark, sf, rows).selectExpr(*_PRED)


def _list(exprs: list[str]) -> str:
    return ", ".join(exprs)


RAW_CTE = (
    f"fx_raw as (select {_list(_FINAL)} from (select {_list(_VALUE)} from (select {_list(_BASE)} from lineitem)))"
)
PRED_CTE = f"fx_pred as (select {_list(_PRED)} from fx_raw)"


def check_sql(body: str, *ctes: str, recursive: bool = False) -> str:
    """Check SQL: the views, further named views, then the query."""
    head = "with recursive " if recursive else "with "
    return head + ",\n".join([RAW_CTE, PRED_CTE, *ctes]) + "\n" + body

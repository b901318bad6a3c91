"""Standard grid-square keys (JIS X 0410 steps) as column maths.

Level 1 cells are 2/3 deg x 1 deg, level 2 are an eighth of that each way and level 4 a tenth
of level 2. A cell is the pair (mesh_row, mesh_col). Inside the quality-control box (20-50 N,
120-150 E) level 2 has at most 86,400 cells, which is the size bound for broadcasting cell
tables of that level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rows per degree of latitude, columns per degree of longitude, by level.
ROWS_PER_DEG = {1: 1.5, 2: 12.0, 4: 120.0}
COLS_PER_DEG = {1: 1.0, 2: 8.0, 4: 80.0}
MAX_LEVEL2_CELLS = 86_400


def mesh_row(lat: Column, level: int = 2) -> Column:
    return F.floor(lat.cast("double") * F.lit(ROWS_PER_DEG[level]))


def mesh_col(lon: Column, level: int = 2) -> Column:
    return F.floor((lon.cast("double") - F.lit(100.0)) * F.lit(COLS_PER_DEG[level]))


def pack(row: Column, col: Column, level: int = 2) -> Column:
    """Digits of the standard code as one integer: 4, 6 or 8 digits."""
    if level == 1:
        return row * 100 + col
    if level == 2:
        return (F.floor(row / 8) * 100 + F.floor(col / 8)) * 100 + F.pmod(row, F.lit(8)) * 10 + F.pmod(col, F.lit(8))
    second = pack(F.floor(row / 10), F.floor(col / 10), 2)
    return second * 100 + F.pmod(row, F.lit(10)) * 10 + F.pmod(col, F.lit(10))


def with_mesh(df: DataFrame, level: int = 2, lat: str = "latitude_deg", lon: str = "longitude_deg") -> DataFrame:
    """Add ``mesh_row``, ``mesh_col`` and the packed ``mesh_code``."""
    df = df.withColumns({"mesh_row": mesh_row(F.col(lat), level), "mesh_col": mesh_col(F.col(lon), level)})
    return df.withColumn("mesh_code", pack(F.col("mesh_row"), F.col("mesh_col"), level))


def with_bounds(df: DataFrame, level: int = 2) -> DataFrame:
    """Add the cell's bounds and midpoint from (mesh_row, mesh_col)."""
    r, c = F.lit(ROWS_PER_DEG[level]), F.lit(COLS_PER_DEG[level])
    df = df.withColumns({
        "lat_min": F.col("mesh_row") / r, "lat_max": (F.col("mesh_row") + 1) / r,
        "lon_min": F.col("mesh_col") / c + 100.0, "lon_max": (F.col("mesh_col") + 1) / c + 100.0})
    return df.withColumns({"lat_mid": 0.5 * (F.col("lat_min") + F.col("lat_max")),
                           "lon_mid": 0.5 * (F.col("lon_min") + F.col("lon_max"))})


def ring(df: DataFrame, radius: int, keep: list[str] | None = None) -> DataFrame:
    """All cells within ``radius`` rows and columns of the given cells, each once."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    rows = df.select(*(keep or []), F.explode(F.transform(span, lambda d: F.col("mesh_row") + d)).alias("mesh_row"), "mesh_col")
    both = rows.select(*(keep or []), "mesh_row", F.explode(F.transform(span, lambda d: F.col("mesh_col") + d)).alias("mesh_col"))
    return both.distinct()

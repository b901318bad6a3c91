"""Vector and raster layers as plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

LINE_FEATURE = "line_id int, pref string, coordinates array<array<double>>"
POLYGON_SCHEMA = "type string, coordinates array<array<array<double>>>"
MULTI_SCHEMA = "type string, coordinates array<array<array<array<double>>>>"
FEATURE_SCHEMA = "type string, geometry string"


def segments_from_lines(lines: DataFrame) -> DataFrame:
    """Line features (coordinates in lon, lat order) to one row per segment."""
    n = F.size("coordinates")
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    seg = lines.select("line_id", "coordinates", F.explode(steps).alias("seq"))
    a = F.element_at("coordinates", F.col("seq"))
    b = F.element_at("coordinates", F.col("seq") + 1)
    return seg.select("line_id", (F.col("seq") - 1).alias("seq"),
                      a[1].alias("lat1"), a[0].alias("lon1"), b[1].alias("lat2"), b[0].alias("lon2"))


def read_line_layers(spark: SparkSession, paths: Sequence[str], prefectures: Sequence[str] | None = None) -> DataFrame:
    """Merge line files (one JSON feature per row), keep the given prefectures, cut into segments."""
    lines = spark.read.schema(LINE_FEATURE).json(list(paths))
    if prefectures is not None:
        lines = lines.where(F.col("pref").isin(list(prefectures)))
    return segments_from_lines(lines)


def polygon_vertices(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """Feature, Polygon or MultiPolygon text to vertices: key, part, ring, seq, x, y.

    A text of another type, or a ring with fewer than four positions, fails the job.
    """
    geometry = F.coalesce(F.get_json_object(json_col, "$.geometry"), F.col(json_col))
    kind = F.get_json_object(geometry, "$.type")
    single = F.array(F.from_json(geometry, POLYGON_SCHEMA)["coordinates"])
    multi = F.from_json(geometry, MULTI_SCHEMA)["coordinates"]
    parts = (F.when(kind == "Polygon", single).when(kind == "MultiPolygon", multi)
             .otherwise(F.raise_error(F.lit("geometry must be a Polygon or MultiPolygon")).cast("array<array<array<array<double>>>>")))
    rings = df.select(key, F.posexplode(parts).alias("part", "_rings")).select(key, "part", F.posexplode("_rings").alias("ring", "_pts"))
    ok = F.when(F.size("_pts") >= 4, F.col("_pts")).otherwise(
        F.raise_error(F.lit("polygon ring needs at least four positions")).cast("array<array<double>>"))
    verts = rings.select(key, "part", "ring", F.posexplode(ok).alias("seq", "_p"))
    return verts.select(key, "part", "ring", "seq", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))


def edges_from_vertices(verts: DataFrame, key: str) -> DataFrame:
    """Ring vertices to edges by shifting each vertex onto its predecessor; one shuffle, no window."""
    both = verts.select(key, "part", "ring", F.explode(F.array(
        F.struct(F.col("seq").alias("seq"), F.struct("x", "y").alias("a"), F.lit(None).cast("struct<x:double,y:double>").alias("b")),
        F.struct((F.col("seq") - 1).alias("seq"), F.lit(None).cast("struct<x:double,y:double>").alias("a"), F.struct("x", "y").alias("b")),
    )).alias("_e")).select(key, "part", "ring", "_e.*")
    e = both.groupBy(key, "part", "ring", "seq").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return e.where("a is not null and b is not null").select(
        key, "part", "ring", "seq", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"),
        F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """Raster tiles to one mosaic; the lowest tile_seq with a value wins a cell."""
    return tiles.groupBy("row", "col").agg(F.min_by("value", "tile_seq").alias("value"))


def slope_aspect(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """Slope and compass aspect in degrees from elevation cells.

    Each cell sends its elevation to its four neighbours, so the gradient is one grouped sum.
    A missing neighbour (the edge) makes that gradient 0; flat cells have aspect -1.
    """
    v = F.col("value")

    def sent(dr: int, dc: int, wx: float, wy: float, home: bool = False):
        return F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"),
                        (v * wx).alias("gx"), (v * wy).alias("gy"),
                        F.lit(int(wx != 0)).alias("nx"), F.lit(int(wy != 0)).alias("ny"),
                        F.when(F.lit(home), v).alias("value"))

    msgs = cells.select(F.inline(F.array(
        sent(0, 0, 0.0, 0.0, True), sent(0, -1, 1.0, 0.0), sent(0, 1, -1.0, 0.0),
        sent(-1, 0, 0.0, 1.0), sent(1, 0, 0.0, -1.0))))
    g = msgs.groupBy("row", "col").agg(F.max("value").alias("value"), F.sum("gx").alias("gx"), F.sum("gy").alias("gy"),
                                      F.sum("nx").alias("nx"), F.sum("ny").alias("ny")).where("value is not null")
    zx = F.when(F.col("nx") == 2, F.col("gx") / (2 * dx)).otherwise(0.0)
    zy = F.when(F.col("ny") == 2, F.col("gy") / (2 * dy)).otherwise(0.0)
    g = g.withColumns({"_zx": zx, "_zy": zy})
    slope = F.degrees(F.atan(F.sqrt(F.col("_zx") * F.col("_zx") + F.col("_zy") * F.col("_zy"))))
    turn = F.degrees(F.atan2(-F.col("_zy"), F.col("_zx")))
    aspect = F.pmod(90.0 - turn, F.lit(360.0))
    return g.select("row", "col", "value", slope.alias("slope_deg"),
                    F.when(slope < 0.5, F.lit(-1.0)).otherwise(aspect).alias("aspect_deg"))

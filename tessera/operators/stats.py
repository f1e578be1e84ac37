"""Minimum and maximum scans over tiles and long pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distance from nodata below which a sample is skipped: by the main reader, and by the reader of LZW files.
NODATA_TOLERANCE = 0.001
LZW_TOLERANCE = 1.1920929e-07


def counts(v: Column, nodata: float | None, tolerance: float) -> Column:
    ok = v.isNotNull() & ~F.isnan(v)
    return ok if nodata is None else ok & ~(F.abs(v - F.lit(float(nodata))) < tolerance)


def range_of(values: DataFrame, nodata: float | None = None, tolerance: float = NODATA_TOLERANCE, empty: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(min_value, max_value) of values (v) without NaN and nodata; `empty` if nothing is left."""
    v = F.col("v").cast("double")
    kept = values.where(counts(v, nodata, tolerance))
    return kept.agg(F.coalesce(F.min(v), F.lit(empty[0])).alias("min_value"), F.coalesce(F.max(v), F.lit(empty[1])).alias("max_value"))


def tile_values(tiles: DataFrame) -> DataFrame:
    return tiles.select(F.explode("pixels").alias("v"))


def estimate_min_max(tiles: DataFrame, nodata: float | None = None, stats: tuple[float, float] | None = None) -> DataFrame:
    """The file's own statistics, or all tiles of the coarsest level in tiles (level, tile_index, pixels); edge padding counts."""
    spark = tiles.sparkSession
    if stats is not None:
        return spark.range(1).select(F.lit(float(stats[0])).alias("min_value"), F.lit(float(stats[1])).alias("max_value"))
    coarsest = tiles.agg(F.max("level").alias("level"))
    return range_of(tile_values(tiles.join(coarsest, "level")), nodata)


def fast_tiles(across: int, down: int) -> list[int]:
    """The corners and the tile half-way through, each once; all of up to five."""
    n = across * down
    return list(range(n)) if n <= 5 else sorted({0, across - 1, n // 2, n - across, n - 1})


def estimate_min_max_fast(tiles: DataFrame, across: int, down: int, nodata: float | None = None, stats: tuple[float, float] | None = None) -> DataFrame:
    if stats is not None:
        return estimate_min_max(tiles, nodata, stats)
    return range_of(tile_values(tiles.where(F.col("tile_index").isin(fast_tiles(across, down)))), nodata)


def min_max_chunked(values: DataFrame) -> DataFrame:
    """The chunked reader's: NaN is skipped, nodata is not known."""
    return range_of(values, None, empty=(0.0, 0.0))


def min_max_lzw(values: DataFrame, nodata: float | None) -> DataFrame:
    return range_of(values, nodata, LZW_TOLERANCE, (0.0, 0.0))


def min_max_without_padding(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """Over (x, y, v) rows inside the raster only, an extra beside the scans above."""
    return range_of(pixels.select("v"), nodata)

"""Reprojection of whole rasters and its chunked form."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import crs
from tessera.functions.geo import Level

from .catalog import auto_resolution, grid_size
from .kernel import REQUEST, Request, extract_tiles

#: Largest raster that is put together in one piece, in samples.
MOST_SAMPLES = 512_000_000


@dataclass(frozen=True)
class Reprojection:
    """An output raster: its CRS, bounds, size and method."""

    crs: int
    box: tuple[float, float, float, float]
    width: int
    height: int
    method: str = "nearest"
    bands: tuple[int, ...] | None = None
    transform_error: float = 0.01

    @property
    def resolution(self) -> tuple[float, float]:
        return (self.box[2] - self.box[0]) / self.width, (self.box[3] - self.box[1]) / self.height

    def world_to_pixel(self, x: float, y: float) -> tuple[float, float]:
        rx, ry = self.resolution
        return (x - self.box[0]) / rx, (self.box[3] - y) / ry

    def pixel_to_world(self, px: float, py: float) -> tuple[float, float]:
        rx, ry = self.resolution
        return self.box[0] + (px + 0.5) * rx, self.box[3] - (py + 0.5) * ry

    def geo_transform(self) -> tuple[float, float, float, float, float, float]:
        rx, ry = self.resolution
        return self.box[0], rx, 0.0, self.box[3], 0.0, -ry


def plan(level: Level, source_crs: int, target_crs: int, bounds: tuple[float, float, float, float] | None = None, bounds_crs: int | None = None, resolution: tuple[float, float] | None = None, size: tuple[int, int] | None = None, method: str = "nearest", bands: tuple[int, ...] | None = None, transform_error: float = 0.01) -> Reprojection:
    """The output grid.  bounds: of the target CRS, or of bounds_crs; else the raster's own.  size outranks resolution."""
    if bounds is None:
        own = level.origin_x, level.origin_y - level.height * level.scale_y, level.origin_x + level.width * level.scale_x, level.origin_y
        box = crs.transform_bounds(own, source_crs, target_crs) if source_crs != target_crs else own
    else:
        box = crs.transform_bounds(bounds, bounds_crs, target_crs) if bounds_crs not in (None, target_crs) else bounds
    if size is None:
        res = resolution or auto_resolution((level.scale_x, level.scale_y), crs.is_geographic(source_crs), crs.is_geographic(target_crs))
        size = (max(1, math.ceil((box[2] - box[0]) / res[0])), max(1, math.ceil((box[3] - box[1]) / res[1]))) if resolution else grid_size(box, res)
    return Reprojection(target_crs, box, size[0], size[1], method, bands, transform_error)


def request_of(p: Reprojection) -> Request:
    return Request(p.box, p.crs, p.width, p.height, p.method, p.bands, p.transform_error)


def reproject(spark: SparkSession, tiles: DataFrame, level: Level, source_crs: int, p: Reprojection, most: int = 1 << 24) -> DataFrame:
    """The whole raster as one row; refused above `most` samples, which one task would hold: use extract_chunks there."""
    samples = p.width * p.height * (len(p.bands) if p.bands is not None else level.bands)
    if samples > most:
        raise ValueError(f"{p.width} x {p.height} is {samples} samples, over {most} for one row; extract_chunks gives it in pieces")
    return extract_tiles(spark, [request_of(p)], tiles, level, source_crs)


def chunk_grid(spark: SparkSession, p: Reprojection, chunk: int) -> DataFrame:
    """(chunk, chunk_x, chunk_y, x0, y0, width, height, minx, miny, maxx, maxy) in row-major order; edge chunks are smaller."""
    across, down = -(-p.width // chunk), -(-p.height // chunk)
    rx, ry = p.resolution
    g = spark.range(across * down).select(F.col("id").alias("chunk"), (F.col("id") % across).alias("chunk_x"), F.floor(F.col("id") / across).alias("chunk_y"))
    g = g.withColumns({"x0": F.col("chunk_x") * chunk, "y0": F.col("chunk_y") * chunk})
    g = g.withColumns({"width": F.least(F.lit(chunk), F.lit(p.width) - F.col("x0")).cast("long"), "height": F.least(F.lit(chunk), F.lit(p.height) - F.col("y0")).cast("long")})
    return g.withColumns({
        "minx": F.lit(p.box[0]) + F.col("x0") * rx,
        "maxx": F.lit(p.box[0]) + (F.col("x0") + F.col("width")) * rx,
        "maxy": F.lit(p.box[3]) - F.col("y0") * ry,
        "miny": F.lit(p.box[3]) - (F.col("y0") + F.col("height")) * ry,
    })


def chunk_requests(p: Reprojection, chunk: int) -> list[Request]:
    """The chunks as extractions of their own, row by row."""
    rx, ry = p.resolution
    out = []
    for y in range(0, p.height, chunk):
        for x in range(0, p.width, chunk):
            w, h = min(chunk, p.width - x), min(chunk, p.height - y)
            box = p.box[0] + x * rx, p.box[3] - (y + h) * ry, p.box[0] + (x + w) * rx, p.box[3] - y * ry
            out.append(replace(request_of(p), box=box, width=w, height=h))
    return out


def extract_chunks(spark: SparkSession, tiles: DataFrame, level: Level, source_crs: int, p: Reprojection, chunk: int) -> DataFrame:
    """A row for each chunk, in no order; `request` is the chunk's number.  The chunks are a table from the start."""
    return extract_tiles(spark, chunk_table(spark, p, chunk), tiles, level, source_crs)


def chunk_table(spark: SparkSession, p: Reprojection, chunk: int) -> DataFrame:
    """The chunks as a table of requests."""
    g = chunk_grid(spark, p, chunk)
    bands = F.array(*[F.lit(b) for b in p.bands]) if p.bands is not None else F.lit(None)
    named = {"request": F.col("chunk"), "crs": F.lit(p.crs), "method": F.lit(p.method), "bands": bands, "transform_error": F.lit(float(p.transform_error))}
    g = g.withColumns(named)
    return g.select(*[F.col(c).cast(k).alias(c) for c, k in (x.strip().split(" ") for x in REQUEST.split(","))])


def for_each_chunk(chunks: DataFrame, p: Reprojection, chunk: int, call: Callable[[tuple[int, int], np.ndarray], None]) -> int:
    """call((chunk_x, chunk_y), (height, width, bands) pixels) on the driver, one chunk at a time in row-major order."""
    across, n = -(-p.width // chunk), 0
    for row in chunks.orderBy("request").toLocalIterator():
        pixels = np.array(row["pixels"], np.float32).reshape(row["height"], row["width"], row["bands"])
        call((row["request"] % across, row["request"] // across), pixels)
        n += 1
    return n


def assemble(chunks: DataFrame, p: Reprojection, chunk: int, bands: int) -> np.ndarray:
    """All chunks as one raster on the driver; refused above MOST_SAMPLES."""
    if p.width * p.height * bands > MOST_SAMPLES:
        raise ValueError(f"{p.width} x {p.height} x {bands} samples are more than {MOST_SAMPLES}; use smaller bounds or chunks")
    out = np.full((p.height, p.width, bands), np.nan, np.float32)

    def put(at: tuple[int, int], pixels: np.ndarray) -> None:
        out[at[1] * chunk : at[1] * chunk + pixels.shape[0], at[0] * chunk : at[0] * chunk + pixels.shape[1]] = pixels

    for_each_chunk(chunks, p, chunk, put)
    return out

"""Extraction as a join: output pixels, their taps, the tiles, a weighted aggregate.

Nothing here knows a tile's content before the join, and no output pixel is lost:
taps join tiles by key from the left.  Sums are of doubles; the numpy path in
`kernel` follows the 32-bit arithmetic where every tap is valid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.geo import KERNELS, Level, axis_scale, clamp, is_valid, round_away, within

METHODS = ("nearest", "bilinear", "cubic", "bicubic")


@dataclass(frozen=True)
class OutputGrid:
    """Output pixels of a box.  c and r: source column and row of output pixel (0, 0), and their steps."""

    width: int
    height: int
    c0: float
    dc: float
    r0: float
    dr: float

    @classmethod
    def of_box(cls, box: tuple[float, float, float, float], width: int, height: int, level: Level) -> "OutputGrid":
        """A grid over a box in the level's own CRS."""
        rx, ry = (box[2] - box[0]) / width, (box[3] - box[1]) / height
        c0 = (box[0] + 0.5 * rx - level.origin_x) / level.scale_x - 0.5
        r0 = (level.origin_y - (box[3] - 0.5 * ry)) / level.scale_y - 0.5
        return cls(width, height, c0, rx / level.scale_x, r0, ry / level.scale_y)

    @property
    def ratio(self) -> tuple[float, float]:
        """Source pixels per output pixel on each axis; a single row counts as 1."""
        return abs(self.dc), abs(self.dr) if self.height > 1 else 1.0


def output_pixels(spark: SparkSession, grid: OutputGrid) -> DataFrame:
    """(oy, ox, r, c): every output pixel and its pixel-centre based source position."""
    p = spark.range(grid.width * grid.height).select(F.floor(F.col("id") / grid.width).cast("int").alias("oy"), (F.col("id") % grid.width).cast("int").alias("ox"))
    return p.select("oy", "ox", (F.lit(grid.r0) + F.col("oy") * F.lit(grid.dr)).alias("r"), (F.lit(grid.c0) + F.col("ox") * F.lit(grid.dc)).alias("c"))


def kernel_scale(method: str, ratio: tuple[float, float]) -> tuple[float, float] | None:
    """The scaled kernel's scales, None where the fixed footprint does."""
    if method == "nearest":
        return None
    scales = axis_scale(ratio[0]), axis_scale(ratio[1])
    return None if min(scales) >= 0.95 else scales


def axis_taps(v: Column, method: str, scale: float | None) -> Column:
    """The kernel's pixels along an axis, before the level's edges are looked at."""
    if method == "nearest":
        return F.array(round_away(v))
    reach = math.ceil(KERNELS[method][1] / (scale or 1.0) - 1e-9)
    base = F.floor(v).cast("long")
    return F.sequence(base + 1 - reach, base + reach)


def taps(pixels: DataFrame, level: Level, method: str, scales: tuple[float, float] | None) -> DataFrame:
    """A row for each output pixel inside the level and tap: px, py, weight w, core (2 x 2) weight b, and whether it is the centre."""
    inside = pixels.where(within(F.col("c"), level.width) & within(F.col("r"), level.height))
    sx, sy = scales or (None, None)
    t = inside.select("*", F.explode(axis_taps(F.col("c"), method, sx)).alias("tx")).select("*", F.explode(axis_taps(F.col("r"), method, sy)).alias("ty"))
    near_x, near_y = clamp(round_away(F.col("c")), 0, level.width - 1), clamp(round_away(F.col("r")), 0, level.height - 1)
    px, py = clamp(F.col("tx"), 0, level.width - 1), clamp(F.col("ty"), 0, level.height - 1)
    if method == "nearest":
        return t.select("oy", "ox", px.alias("px"), py.alias("py"), F.lit(1.0).alias("w"), F.lit(1.0).alias("b"), F.lit(True).alias("centre"), F.lit(True).alias("whole"))
    kernel = KERNELS[method][0]
    wx, wy = (kernel((F.col(v) - F.col(p)) * F.lit(s or 1.0)) for v, p, s in (("c", "tx", sx), ("r", "ty", sy)))
    in_level = (F.col("tx") == px) & (F.col("ty") == py)
    if scales:
        # taps outside the level are dropped; the centre is one of the taps
        return t.where(in_level).select("oy", "ox", px.alias("px"), py.alias("py"), (wx * wy).alias("w"), F.lit(0.0).alias("b"), ((px == near_x) & (py == near_y)).alias("centre"), F.lit(False).alias("whole"))
    bx, by = geo.tent(F.col("c") - F.col("tx")), geo.tent(F.col("r") - F.col("ty"))
    whole = in_level if method == "cubic" else F.lit(True)
    return t.select("oy", "ox", px.alias("px"), py.alias("py"), (wx * wy).alias("w"), (bx * by).alias("b"), ((px == near_x) & (py == near_y)).alias("centre"), whole.alias("whole"))


def tap_values(tapped: DataFrame, tiles: DataFrame, level: Level, bands: list[int]) -> DataFrame:
    """The taps with band and v: the sample there, NaN in a sparse tile (one without pixels), null where there is no tile."""
    keyed = tapped.withColumn("tile_index", geo.tile_index(F.col("px"), F.col("py"), level))
    at = geo.pixel_in_tile(F.col("px"), F.col("py"), level)
    joined = keyed.join(tiles.select("tile_index", "pixels", F.lit(True).alias("found")), "tile_index", "left")
    nan = F.when(F.col("found") & F.col("pixels").isNull(), float("nan"))
    picks = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(b).alias("band"), F.coalesce(F.try_element_at("pixels", (at + b + 1).cast("int")).cast("double"), nan).alias("v")) for i, b in enumerate(bands)])
    return joined.select("oy", "ox", "w", "b", "centre", "whole", F.inline(picks))


def check_bands(bands: list[int] | None, level: Level) -> list[int]:
    if bands is None:
        return list(range(level.bands))
    if not bands:
        raise ValueError("At least one band must be selected")
    for b in bands:
        if not 0 <= b < level.bands:
            raise ValueError(f"Band index {b} out of range (COG has {level.bands} bands)")
    return list(bands)


def extract(tiles: DataFrame, level: Level, grid: OutputGrid, method: str = "nearest", bands: list[int] | None = None, pixels: DataFrame | None = None) -> DataFrame:
    """(oy, ox, ordinal, band, value) of every output pixel; value is the nodata value, or null, where
    there is nothing, and null for the NaN of sparse tiles.

    tiles: (tile_index, pixels), pixel-interleaved.  pixels: other positions than the
    grid's own, as from a projection; the grid then gives only the ratio.
    """
    if method not in METHODS:
        raise ValueError(f"unknown resampling method {method!r}")
    chosen = check_bands(bands, level)
    out = pixels if pixels is not None else output_pixels(tiles.sparkSession, grid)
    scales = kernel_scale(method, grid.ratio)
    v = tap_values(taps(out, level, method, scales), tiles, level, chosen)
    ok = is_valid(F.col("v"), level.nodata)
    on = lambda x: F.when(ok, x)
    sums = v.groupBy("oy", "ox", "ordinal", "band").agg(
        F.count("*").alias("n"),
        F.count_if(ok & F.col("whole")).alias("n_ok"),
        F.sum("w").alias("w_all"),
        F.sum(on(F.col("w"))).alias("w_ok"),
        F.sum(on(F.col("w") * F.col("v"))).alias("wv"),
        F.sum(on(F.col("b"))).alias("b_ok"),
        F.sum(on(F.col("b") * F.col("v"))).alias("bv"),
        F.max(F.when(F.col("centre"), F.col("v"))).alias("near"),
        F.max(F.when(F.col("centre"), ok)).alias("near_ok"),
    )
    fill = F.lit(level.nodata).cast("float").cast("double")
    nearest = F.coalesce("near", fill)
    if method == "nearest":
        value = nearest
        sums = sums.withColumn("any_near", F.lit(True))
    else:
        # the nearest pixel must be invalid in every selected band for its sample to stand
        per_pixel = sums.groupBy("oy", "ox").agg(F.bool_or("near_ok").alias("any_near"))
        sums = sums.join(per_pixel, ["oy", "ox"]) if len(chosen) > 1 else sums.withColumn("any_near", F.col("near_ok"))
        if scales:
            blend = F.when(F.col("w_ok") > 1e-6, F.col("wv") / F.col("w_ok")).otherwise(fill)
            value = F.when(F.col("any_near"), blend).otherwise(nearest)
        else:
            whole = F.col("n_ok") == (4 if method == "bilinear" else 16)
            straight = F.when(F.col("w_all") > 0, F.col("wv") / F.col("w_all")).otherwise(fill)
            partial = F.when(F.col("b_ok") >= 1e-5, F.col("bv") / F.col("b_ok")).otherwise(fill)
            value = F.when(whole, straight).when(F.col("any_near"), partial).otherwise(nearest)
    found = sums.select("oy", "ox", "ordinal", "band", F.nullif(value, F.lit(float("nan"))).alias("value"))
    # every pixel inside the level has a tap; those outside need no join
    outside = out.where(~(within(F.col("c"), level.width) & within(F.col("r"), level.height)) | F.col("c").isNull() | F.col("r").isNull())
    rest = outside.select("oy", "ox", F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(b).alias("band")) for i, b in enumerate(chosen)])), fill.alias("value"))
    return found.unionByName(rest)


def needed_tiles(spark: SparkSession, level: Level, grid: OutputGrid, method: str) -> DataFrame:
    """The different tiles that an extraction reads, in order."""
    t = taps(output_pixels(spark, grid), level, method, kernel_scale(method, grid.ratio))
    return t.select(geo.tile_index(F.col("px"), F.col("py"), level).alias("tile_index")).distinct().orderBy("tile_index")


def only_needed(tiles: DataFrame, level: Level, grid: OutputGrid, method: str) -> DataFrame:
    """tiles without those that the extraction does not read: a semi-join on the key."""
    return tiles.join(needed_tiles(tiles.sparkSession, level, grid, method), "tile_index", "left_semi")

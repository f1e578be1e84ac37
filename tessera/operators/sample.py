"""Point queries: locate the pixel, equi-join its tile, pick the sample.

Always full resolution.  A raster without a CRS counts as EPSG:4326 here.  Points
outside have no values and are not valid; a sparse tile gives NaN and is; nodata
comes back as it is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import crs, geo
from tessera.functions.geo import GeoTransform, Level

POINT_CRS = 4326


def locate(points: DataFrame, level: Level, transform: GeoTransform, point_crs: int = POINT_CRS, raster_crs: int | None = None) -> DataFrame:
    """points (x, y, ...) with px, py and tile_index, null outside the raster."""
    wx, wy = crs.transform_xy(F.col("x"), F.col("y"), point_crs, raster_crs or POINT_CRS)
    fx, fy = transform.world_to_pixel(wx, wy)
    at = points.withColumns({"__fx": fx, "__fy": fy})
    inside = (F.col("__fx") >= 0) & (F.col("__fx") < level.width) & (F.col("__fy") >= 0) & (F.col("__fy") < level.height)
    at = at.withColumns({"px": F.when(inside, F.floor("__fx")), "py": F.when(inside, F.floor("__fy"))}).drop("__fx", "__fy")
    return at.withColumn("tile_index", geo.tile_index(F.col("px"), F.col("py"), level))


def picked(level: Level, band: int | Column) -> Column:
    """The sample of a located point in its tile's pixels; null where the tile has none."""
    return F.try_element_at("pixels", (geo.pixel_in_tile(F.col("px"), F.col("py"), level) + band + 1).cast("int"))


def sample_points(points: DataFrame, tiles: DataFrame, level: Level, transform: GeoTransform, point_crs: int = POINT_CRS, raster_crs: int | None = None) -> DataFrame:
    """points with px, py, is_valid and values: a map of band to sample, empty outside.

    A tile that many points share is read once: it is one row of the join.  The
    points' columns, an ordinal among them, pass through, so that order can be restored.
    """
    at = locate(points, level, transform, point_crs, raster_crs).join(tiles.select("tile_index", "pixels"), "tile_index", "left")
    nan = F.lit(float("nan")).cast("float")
    values = F.map_from_arrays(F.array(*[F.lit(b) for b in range(level.bands)]), F.array(*[F.coalesce(picked(level, b), nan) for b in range(level.bands)]))
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<float>"))
    valid = F.col("px").isNotNull()
    return at.withColumns({"is_valid": valid, "values": F.when(valid, values).otherwise(empty)}).drop("pixels", "tile_index")


def sample_band(points: DataFrame, tiles: DataFrame, level: Level, transform: GeoTransform, band: int, point_crs: int = POINT_CRS, raster_crs: int | None = None) -> DataFrame:
    """points with value: one band's sample, null outside the raster or where the band does not exist."""
    at = locate(points, level, transform, point_crs, raster_crs).join(tiles.select("tile_index", "pixels"), "tile_index", "left")
    value = picked(level, band).cast("float") if 0 <= band < level.bands else F.lit(None).cast("float")
    nan = F.lit(float("nan")).cast("float")
    return at.withColumn("value", F.when(F.col("px").isNotNull() & F.lit(0 <= band < level.bands), F.coalesce(value, nan))).drop("pixels", "tile_index")


def sample_rasters(points: DataFrame, tiles: DataFrame, rasters: DataFrame, point_crs: int = POINT_CRS) -> DataFrame:
    """points (raster_id, x, y, ...) with px, py and values (by band): each at its own raster, any number of them in one job.

    rasters: the `rasters` table of the cog source, which gives each raster's geometry as columns; tiles: (raster_id,
    tile_index, pixels).  Joins are on raster_id and on (raster_id, tile_index).  Rasters in degrees or spherical Mercator.
    """
    nan = F.lit(float("nan")).cast("float")
    g = rasters.select("raster_id", *[F.col(c).alias(f"__{c}") for c in ("width", "height", "tile_width", "tile_height", "bands", "crs", "scale_x", "scale_y", "tie_px", "tie_py", "tie_x", "tie_y", "is_point")])
    at = points.join(g, "raster_id")
    mercator = F.coalesce("__crs", F.lit(POINT_CRS)).isin(3857, 900913)
    there, back = crs.transform_xy(F.col("x"), F.col("y"), point_crs, 3857), crs.transform_xy(F.col("x"), F.col("y"), point_crs, 4326)
    wx, wy = (F.when(mercator, m).otherwise(d) for m, d in zip(there, back, strict=True))
    half = F.when(F.col("__is_point"), 0.5).otherwise(0.0)
    at = at.withColumns({"__fx": F.col("__tie_px") + (wx - F.col("__tie_x")) / F.col("__scale_x") + half, "__fy": F.col("__tie_py") + (F.col("__tie_y") - wy) / F.col("__scale_y") + half})
    inside = (F.col("__fx") >= 0) & (F.col("__fx") < F.col("__width")) & (F.col("__fy") >= 0) & (F.col("__fy") < F.col("__height"))
    at = at.withColumns({"px": F.when(inside, F.floor("__fx")), "py": F.when(inside, F.floor("__fy"))})
    across = F.ceil(F.col("__width") / F.col("__tile_width"))
    at = at.withColumn("tile_index", (F.floor(F.col("py") / F.col("__tile_height")) * across + F.floor(F.col("px") / F.col("__tile_width"))).cast("long"))
    joined = at.join(tiles.select("raster_id", "tile_index", "pixels"), ["raster_id", "tile_index"], "left")
    first = ((F.col("py") % F.col("__tile_height")) * F.col("__tile_width") + F.col("px") % F.col("__tile_width")) * F.col("__bands") + 1
    bands = F.transform(F.sequence(F.lit(0), F.col("__bands") - 1), lambda b: F.coalesce(F.try_element_at("pixels", (first + b).cast("int")), nan))
    out = joined.withColumn("values", F.when(F.col("px").isNotNull(), bands))
    return out.select(*points.columns, "px", "py", "values")


def sample_pixels(pixels: DataFrame, tiles: DataFrame, level: Level) -> DataFrame:
    """pixels (band, x, y, ...) with value; null outside the raster and for bands it does not have."""
    inside = F.col("x").between(0, level.width - 1) & F.col("y").between(0, level.height - 1) & F.col("band").between(0, level.bands - 1)
    at = pixels.withColumns({"px": F.when(inside, F.col("x")), "py": F.when(inside, F.col("y"))}).withColumn("tile_index", geo.tile_index(F.col("px"), F.col("py"), level))
    joined = at.join(tiles.select("tile_index", "pixels"), "tile_index", "left")
    nan = F.lit(float("nan")).cast("float")
    return joined.withColumn("value", F.when(F.col("px").isNotNull(), F.coalesce(picked(level, F.col("band")), nan))).drop("pixels", "tile_index", "px", "py")


def get(values: Column, band: int) -> Column:
    return F.try_element_at(values, F.lit(band))


def to_vec(values: Column, bands: int) -> Column:
    """Samples by band, NaN where there is none."""
    nan = F.lit(float("nan")).cast("float")
    return F.array(*[F.coalesce(get(values, b), nan) for b in range(bands)])


def valid_band_count(values: Column) -> Column:
    return F.size(F.filter(F.map_values(values), lambda v: ~F.isnan(v)))


def has_valid_data(values: Column) -> Column:
    return F.exists(F.map_values(values), lambda v: ~F.isnan(v))

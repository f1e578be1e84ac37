"""Overview (pyramid level) selection and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Output size that a level's resolution is judged by, whatever the real output size.
REFERENCE_PIXELS = 256
#: Least share of valid samples of a usable overview.
LEAST_DENSITY = 0.05


def best_overview(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """requests (id, w, h, min_usable) with overview: the index of the level to read, null for full resolution.

    levels: (overview, scale_x, scale_y) of the overviews in file order.  A null
    min_usable with overviews means full resolution.
    """
    need = F.greatest("w", "h") / F.lit(float(REFERENCE_PIXELS))
    asked = requests.withColumn("needed", need)
    fits = asked.where((F.col("needed") >= 1.5) & F.col("min_usable").isNotNull()).join(levels.withColumn("scale", F.greatest("scale_x", "scale_y")), (F.col("scale") <= F.col("needed")) & (F.col("overview") <= F.col("min_usable")))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("scale"), "overview"))
    best = fits.withColumn("k", first).where("k = 1").select("id", "overview")
    return asked.drop("needed").join(best, "id", "left")


def density(pixels: Column) -> Column:
    """Share of samples that are neither NaN nor 0; nodata is not asked."""
    return F.size(F.filter(pixels, lambda v: ~F.isnan(v) & (v != 0))) / F.size(pixels)


def tile_density(tiles: DataFrame) -> DataFrame:
    return tiles.select("tile_index", F.size(F.filter("pixels", lambda v: ~F.isnan(v) & (v != 0))).cast("long").alias("valid"), F.size("pixels").cast("long").alias("samples"))


def quality_hint(tiles: DataFrame) -> DataFrame:
    """(level, valid, samples, usable) from the first, middle and last tile of each overview (level >= 1)."""
    own = tiles.where("level >= 1")
    n = F.max("tile_index") + 1
    # three keys a level: a level's tiles are counted by partial aggregates and never meet in one task
    asked = own.groupBy("level").agg(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(n / 2), (n - 1).cast("long"))).alias("t"))
    asked = F.broadcast(asked.select("level", F.explode("t").alias("tile_index")))
    probe = own.join(asked, ["level", "tile_index"], "left_semi")
    # a tile that could not be read, or is sparse, counts as no data
    held = F.coalesce("pixels", F.array().cast("array<float>"))
    counted = probe.select("level", F.size(F.filter(held, lambda v: ~F.isnan(v) & (v != 0))).alias("v"), F.size(held).alias("s"))
    return counted.groupBy("level").agg(F.sum("v").cast("long").alias("valid"), F.sum("s").cast("long").alias("samples")).withColumn("usable", F.col("valid") >= F.lit(LEAST_DENSITY) * F.col("samples"))


def min_usable(quality: DataFrame) -> DataFrame:
    """One row: the index of the coarsest usable overview, null if none is."""
    return quality.agg(F.max(F.when(F.col("usable"), F.col("level") - 1)).alias("min_usable"))


def hint_from_db(value: Column) -> Column:
    """The stored hint by name: null, -1, -2 or an index."""
    return F.when(value.isNull(), "compute_at_runtime").when(value == -1, "all_usable").when(value == -2, "none_usable").otherwise(F.concat(F.lit("min_usable:"), value.cast("string")))


def hint_to_db(name: Column) -> Column:
    return F.when(name == "all_usable", -1).when(name == "none_usable", -2).when(name.startswith("min_usable:"), F.regexp_extract(name, r":(\d+)$", 1).try_cast("int"))


def usable_from_hint(value: Column, overviews: int) -> Column:
    """Coarsest usable overview that a stored hint gives; null: none."""
    last = F.lit(overviews - 1 if overviews else None).cast("int")
    return F.when(value.isNull() | (value == -2), F.lit(None)).when(value == -1, last).otherwise(F.least(value, last))

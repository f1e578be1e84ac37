"""Raster queries over the driver's tables, and their DuckDB forms.

`embeddings` serve as a raster: each row is a tile of 8 x 8 samples, 25 tiles
across, tiles of label 0 being sparse.  `events` give points, `part` gives
footprints, `orders` byte ranges.  Every query reads its whole tables.
"""

from __future__ import annotations

import datetime
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import casting, crs, geo
from tessera.functions.geo import GeoTransform, Level
from tessera.operators import catalog, kernel, levels, reproject, resample, rgba, sample, stats
from tessera.operators.resample import OutputGrid
from tessera.sources import cog, tiff, webp

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its DuckDB form if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


# the raster


def tiles_of(spark: SparkSession, sf_dir: str, steps: int | None = None) -> DataFrame:
    """(tile_index, pixels); steps: samples rounded to that part of 1."""
    pixels = F.col("embedding")
    if steps:
        pixels = F.transform(pixels, lambda x: (F.floor(x.cast("double") * steps + 0.5) / steps).cast("float"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_index"), F.when(F.col("label") != 0, pixels).alias("pixels"))


def level_of(spark: SparkSession, sf_dir: str, tile_height: int = 8, bands: int = 1, nodata: float | None = None) -> Level:
    n = table(spark, sf_dir, "embeddings").count()
    return Level(200, tile_height * math.ceil(n / 25), 8, tile_height, bands, nodata)


def grid_over(level: Level, width: int, c0: float, dc: float, r0: float, dr: float) -> OutputGrid:
    return OutputGrid(width, math.floor(level.height / dr), c0, dc, r0, dr)


FINE = (335, -0.3712347, 0.6100713, 0.2103959, 0.5700377)
COARSE = (80, 0.73, 2.5, 0.41, 3.02)
EXACT = (320, 0.25, 0.625, 0.125, 0.75)

TENT = "greatest(0.0, 1.0 - abs({x}))"
MITCHELL = "CASE WHEN abs({x}) < 1 THEN 7.0::DOUBLE/6*abs({x})**3 - 2*abs({x})**2 + 16.0::DOUBLE/18 WHEN abs({x}) < 2 THEN -7.0::DOUBLE/18*abs({x})**3 + 2*abs({x})**2 - 10.0::DOUBLE/3*abs({x}) + 16.0::DOUBLE/9 ELSE 0 END"
CATMULL = "CASE WHEN abs({x}) <= 1 THEN abs({x})**2*(1.5*abs({x}) - 2.5) + 1 WHEN abs({x}) <= 2 THEN abs({x})*(abs({x})*(-0.5*abs({x}) + 2.5) - 4) + 2 ELSE 0 END"


def extract_sql(method: str, grid: tuple, nodata: float | None = None, steps: int | None = None, tile_height: int = 8, bands: tuple[int, ...] = (0,), n_bands: int = 1, digits: int = 6, positions: tuple[int, str, str] | None = None) -> str:
    """The rules of extraction, written out for DuckDB.  positions: output height, and source row and column in SQL, in place of the grid's own.

    The samples are unnested once to (py, px, band, v); taps and weights depend on one axis each, so sums go along x first and then along y.
    """
    width, c0, dc, r0, dr = grid
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    own = {"nearest": TENT, "bilinear": TENT, "bicubic": MITCHELL, "cubic": CATMULL}[method]
    scales = None
    if method != "nearest":
        s = tuple(1 / round(x) if abs(x - round(x)) <= 0.05 else 1 / x for x in (max(dc, 1), max(dr, 1)))
        scales = s if min(s) < 0.95 else None
    sx, sy = scales or (1.0, 1.0)
    support = 1 if method in ("nearest", "bilinear") else 2
    fill = "NULL" if nodata is None else d(nodata)
    value = f"floor(s::DOUBLE * {steps} + 0.5) / {steps}" if steps else "s::DOUBLE"
    ok = "v IS NOT NULL AND NOT isnan(v)" + (f" AND v <> {d(nodata)}" if nodata is not None else "")
    picks = ", ".join(f"({i}, {b})" for i, b in enumerate(bands))
    near = f"CASE WHEN NOT isnan(coalesce(near, 0)) THEN coalesce(near, {fill}) END"
    if method == "nearest":
        final = near
    elif scales:
        final = f"CASE WHEN any_near THEN CASE WHEN w_ok > 1e-6 THEN wv / w_ok ELSE {fill} END ELSE {near} END"
    else:
        final = f"CASE WHEN n_ok = {4 * support * support} THEN wv / w_all WHEN any_near THEN CASE WHEN b_ok >= 1e-5 THEN bv / b_ok ELSE {fill} END ELSE {near} END"
    rows, r_sql, c_sql = positions or (f"CAST(floor(hh / {d(dr)}) AS BIGINT)", f"{d(r0)} + oy * {d(dr)}", f"{d(c0)} + ox * {d(dc)}")

    def taps(axis: str, at: str, top: str, scale: float) -> str:
        n = math.ceil(support / scale - 1e-9)
        return f"""
  SELECT o{axis}, least(greatest(t, 0), {top}) AS p{axis}, (t BETWEEN 0 AND {top})::INTEGER AS i{axis}, {own.format(x=f"(({at} - t) * {d(scale)})")} AS w{axis}, {TENT.format(x=f"({at} - t)")} AS l{axis}
  FROM (SELECT *, unnest(range(CAST(floor({at}) AS BIGINT) + 1 - {n}, CAST(floor({at}) AS BIGINT) + 1 + {n})) AS t FROM {axis}s WHERE in{axis}) {f"WHERE t BETWEEN 0 AND {top}" if scales else ""}"""

    inside = "ix" if method == "cubic" else "1"
    return f"""
WITH g AS (SELECT {tile_height} * CAST(ceil(count(*) / 25.0) AS BIGINT) AS hh FROM embeddings),
e AS MATERIALIZED (
  SELECT (vec_id // 25) * {tile_height} + (k // {n_bands}) // 8 AS py, (vec_id % 25) * 8 + (k // {n_bands}) % 8 AS px, (k % {n_bands})::INTEGER AS band, CASE WHEN label <> 0 THEN {value} WHEN label = 0 THEN 'nan'::DOUBLE END AS v
  FROM (SELECT vec_id, label, unnest(embedding) AS s, unnest(range(len(embedding))) AS k FROM embeddings)
), ys AS MATERIALIZED (
  SELECT oy, hh, r, r >= -0.5 AND r <= hh - 0.5 AS iny, least(greatest(CAST(round(r) AS BIGINT), 0), hh - 1) AS ny FROM (SELECT oy, hh, {r_sql} AS r FROM (SELECT hh, unnest(range({rows})) AS oy FROM g))
), xs AS MATERIALIZED (
  SELECT ox, c, c >= -0.5 AND c <= 199.5 AS inx, least(greatest(CAST(round(c) AS BIGINT), 0), 199) AS nx FROM (SELECT ox, {c_sql} AS c FROM range({width}) t(ox))
), ty AS MATERIALIZED ({taps("y", "r", "hh - 1", sy)}
), tx AS MATERIALIZED ({taps("x", "c", "199", sx)}
), a AS MATERIALIZED (
  SELECT py, ox, band, sum({inside}) FILTER ({ok}) AS n, sum(wx) FILTER ({ok}) AS w, sum(wx * v) FILTER ({ok}) AS wv, sum(lx) FILTER ({ok}) AS b, sum(lx * v) FILTER ({ok}) AS bv
  FROM e JOIN tx USING (px) GROUP BY py, ox, band
), s AS MATERIALIZED (
  SELECT oy, ox, band, sum(n{" * iy" if method == "cubic" else ""}) AS n_ok, sum(wy * w) AS w_ok, sum(wy * wv) AS wv, sum(ly * b) AS b_ok, sum(ly * bv) AS bv
  FROM a JOIN ty USING (py) GROUP BY oy, ox, band
), o AS (
  SELECT oy, ox, ordinal, ys.iny AND xs.inx AS inside, p.band, ny, nx FROM ys CROSS JOIN xs CROSS JOIN (VALUES {picks}) p(ordinal, band)
), n AS (
  SELECT o.*, n_ok, w_ok, wv, b_ok, bv, e.v AS near, wy * wx AS w_all, bool_or({ok}) OVER (PARTITION BY o.oy, o.ox) AS any_near
  FROM o LEFT JOIN s ON s.oy = o.oy AND s.ox = o.ox AND s.band = o.band LEFT JOIN e ON e.py = ny AND e.px = nx AND e.band = o.band
  LEFT JOIN (SELECT oy, sum(wy) AS wy FROM ty GROUP BY oy) y ON y.oy = o.oy LEFT JOIN (SELECT ox, sum(wx) AS wx FROM tx GROUP BY ox) x ON x.ox = o.ox
)
SELECT CAST(oy AS INTEGER) AS oy, CAST(ox AS INTEGER) AS ox, ordinal, band, round(CASE WHEN NOT inside THEN {fill} ELSE {final} END, {digits}) + 0.0 AS value FROM n
"""


def add_extraction(name: str, method: str, grid: tuple, nodata: float | None = None, steps: int | None = None, tile_height: int = 8, n_bands: int = 1, bands: tuple[int, ...] = (0,)) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        level = level_of(spark, sf_dir, tile_height, n_bands, nodata)
        out = resample.extract(tiles_of(spark, sf_dir, steps), level, grid_over(level, *grid), method, list(bands))
        return out.withColumn("value", rounded(F.col("value"), 6))

    QUERIES[name] = run
    ORACLES[name] = extract_sql(method, grid, nodata, steps, tile_height, bands, n_bands)


add_extraction("extract_nearest", "nearest", FINE)
add_extraction("extract_bilinear", "bilinear", FINE)
add_extraction("extract_bilinear_nodata", "bilinear", FINE, nodata=0.125, steps=8)
add_extraction("extract_cubic", "cubic", FINE)
add_extraction("extract_mitchell", "bicubic", FINE)
add_extraction("extract_cubic_nodata", "cubic", FINE, nodata=0.125, steps=8)
add_extraction("extract_scaled_bilinear", "bilinear", COARSE)
add_extraction("extract_scaled_cubic", "cubic", COARSE)
add_extraction("extract_scaled_nodata", "bicubic", COARSE, nodata=0.125, steps=8)
add_extraction("extract_band_subset", "nearest", FINE, tile_height=4, n_bands=2, bands=(1, 0, 1))
add_extraction("extract_bands_nodata", "bilinear", FINE, nodata=0.125, steps=8, tile_height=4, n_bands=2, bands=(0, 1))
add_extraction("extract_outside_fill", "bilinear", (120, -80.37, 0.71, 0.21, 0.57), nodata=-9999.0)


#: A slippy-map tile over the raster, which here lies at 10 degrees east, 60 north, 0.05 degrees a pixel.
XYZ, XYZ_SIZE = (6, 34, 19), 192
XYZ_BOX = geo.xyz_bbox(*XYZ)
XYZ_STEP = (XYZ_BOX[2] - XYZ_BOX[0]) / XYZ_SIZE


@query(
    extract_sql(
        "cubic",
        (XYZ_SIZE, 0.0, 0.5, 0.0, 0.5),
        positions=(
            XYZ_SIZE,
            f"(60 - degrees(2 * atan(exp(({XYZ_BOX[3]!r}::DOUBLE - (oy + 0.5::DOUBLE) * {XYZ_STEP!r}::DOUBLE) / 6378137)) - pi() / 2)) / 0.05::DOUBLE - 0.5",
            f"(degrees(({XYZ_BOX[0]!r}::DOUBLE + (ox + 0.5::DOUBLE) * {XYZ_STEP!r}::DOUBLE) / 6378137) - 10) / 0.05::DOUBLE - 0.5",
        ),
    )
)
def extract_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Mercator tile of a raster in degrees."""
    flat = level_of(spark, sf_dir)
    level = Level(flat.width, flat.height, 8, 8, 1, None, 10.0, 60.0, 0.05, 0.05)
    n = spark.range(XYZ_SIZE * XYZ_SIZE).select(F.floor(F.col("id") / XYZ_SIZE).cast("int").alias("oy"), (F.col("id") % XYZ_SIZE).cast("int").alias("ox"))
    lon, lat = crs.transform_xy(XYZ_BOX[0] + (F.col("ox") + 0.5) * XYZ_STEP, XYZ_BOX[3] - (F.col("oy") + 0.5) * XYZ_STEP, 3857, 4326)
    pixels = n.select("oy", "ox", level.source_y(lat).alias("r"), level.source_x(lon).alias("c"))
    out = resample.extract(tiles_of(spark, sf_dir), level, OutputGrid(XYZ_SIZE, XYZ_SIZE, 0.0, 0.5, 0.0, 0.5), "cubic", [0], pixels)
    return out.withColumn("value", rounded(F.col("value"), 6))


def one_request(level: Level, grid: tuple, method: str, bands: tuple[int, ...] | None = None) -> kernel.Request:
    """A request, in pixels of the level as world units, whose positions are those of the grid."""
    g = grid_over(level, *grid)
    left, top = g.c0 + 0.5 - 0.5 * g.dc, -(g.r0 + 0.5 - 0.5 * g.dr)
    return kernel.Request((left, top - g.height * g.dr, left + g.width * g.dc, top), 3857, g.width, g.height, method, bands)


@query(extract_sql("bilinear", EXACT, steps=8))
def arrow_extract_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = level_of(spark, sf_dir)
    out = kernel.extract_tiles(spark, [one_request(level, EXACT, "bilinear")], tiles_of(spark, sf_dir, 8), level)
    return kernel.long_pixels(out).select("oy", "ox", "ordinal", F.lit(0).alias("band"), rounded(F.col("value"), 6).alias("value"))


@query(extract_sql("nearest", FINE))
def chunked_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = level_of(spark, sf_dir)
    q = one_request(level, FINE, "nearest")
    p = reproject.Reprojection(3857, q.box, q.width, q.height, "nearest")
    across = -(-q.width // 64)
    out = kernel.long_pixels(reproject.extract_chunks(spark, tiles_of(spark, sf_dir), level, 3857, p, 64))
    oy = (F.floor(F.col("request") / across) * 64 + F.col("oy")).cast("int")
    ox = ((F.col("request") % across) * 64 + F.col("ox")).cast("int")
    return out.select(oy.alias("oy"), ox.alias("ox"), "ordinal", F.lit(0).alias("band"), rounded(F.col("value"), 6).alias("value"))


@query(f"""
WITH g AS (SELECT 8 * CAST(ceil(count(*) / 25.0) AS BIGINT) AS hh FROM embeddings),
c AS (SELECT DISTINCT least(greatest(CAST(floor({FINE[1]}::DOUBLE + ox * {FINE[2]}::DOUBLE) AS BIGINT) + k, 0), 199) // 8 AS tx
      FROM range(335) t(ox), range(2) s(k) WHERE {FINE[1]}::DOUBLE + ox * {FINE[2]}::DOUBLE BETWEEN -0.5 AND 199.5),
r AS (SELECT DISTINCT least(greatest(CAST(floor({FINE[3]}::DOUBLE + oy * {FINE[4]}::DOUBLE) AS BIGINT) + k, 0), hh - 1) // 8 AS ty
      FROM (SELECT hh, unnest(range(CAST(floor(hh / {FINE[4]}::DOUBLE) AS BIGINT))) AS oy FROM g), range(2) s(k) WHERE {FINE[3]}::DOUBLE + oy * {FINE[4]}::DOUBLE BETWEEN -0.5 AND hh - 0.5)
SELECT ty * 25 + tx AS tile_index FROM c, r
""")
def needed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = level_of(spark, sf_dir)
    return resample.needed_tiles(spark, level, grid_over(level, *FINE), "bilinear")


# projection and grids


@query("""
WITH p AS (SELECT event_id, (event_id % 12) AS z, user_id % (1 << (event_id % 12)::INTEGER) AS x, (event_id * 7) % (1 << (event_id % 12)::INTEGER) AS y FROM events),
s AS (SELECT *, 40075016.68557849::DOUBLE / (2.0::DOUBLE ** z) AS s FROM p)
SELECT event_id, round(s * x - 20037508.342789244::DOUBLE, 3) AS minx, round(20037508.342789244::DOUBLE - s * y - s, 3) AS miny,
       round(s * x - 20037508.342789244::DOUBLE + s, 3) AS maxx, round(20037508.342789244::DOUBLE - s * y, 3) AS maxy FROM s
""")
def xyz_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("z", F.col("event_id") % 12)
    n = F.expr("shiftleft(1L, cast(z as int))")
    box = geo.xyz_bounds(F.col("z"), F.col("user_id") % n, (F.col("event_id") * 7) % n)
    return e.select("event_id", *[rounded(c, 3).alias(k) for k, c in box.items()])


LON, LAT = "((event_id * 37) % 36000) / 100.0::DOUBLE - 180", "((event_id * 91 + user_id) % 17000) / 100.0::DOUBLE - 85"


def lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumns({"lon": (F.col("event_id") * 37) % 36000 / 100.0 - 180, "lat": (F.col("event_id") * 91 + F.col("user_id")) % 17000 / 100.0 - 85})


@query(f"SELECT event_id, round(radians({LON}) * 6378137, 3) + 0.0 AS x, round(ln(tan(pi() / 4 + radians({LAT}) / 2)) * 6378137, 3) + 0.0 AS y FROM events")
def mercator_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = crs.transform_xy(F.col("lon"), F.col("lat"), 4326, 3857)
    return lonlat(spark, sf_dir).select("event_id", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"))


@query(f"SELECT event_id, round(degrees(({LON}) * 100000 / 6378137), 9) + 0.0 AS lon, round(degrees(2 * atan(exp(({LAT}) * 100000 / 6378137)) - pi() / 2), 9) + 0.0 AS lat FROM events")
def mercator_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = crs.transform_xy(F.col("lon") * 100000, F.col("lat") * 100000, 3857, 4326)
    return lonlat(spark, sf_dir).select("event_id", rounded(x, 9).alias("lon"), rounded(y, 9).alias("lat"))


@query()
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions near zone 10 to metres and back."""
    p = lonlat(spark, sf_dir).select("event_id", (F.lit(-123.0) + F.col("lon") / 100).alias("lon"), (F.col("lat") * 0.9).alias("lat"))
    x, y = crs.transform_xy(F.col("lon"), F.col("lat"), 4326, 32610)
    p = p.withColumns({"x": x, "y": y})
    lon, lat = crs.transform_xy(F.col("x"), F.col("y"), 32610, 4326)
    return p.select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), (F.abs(lon - F.col("lon")) < 1e-9).alias("lon_back"), (F.abs(lat - F.col("lat")) < 1e-9).alias("lat_back"))


BOX = {"minx": "p_partkey % 300 - 150.0::DOUBLE", "miny": "p_partkey % 140 - 70.0::DOUBLE", "maxx": "p_partkey % 300 - 150.0::DOUBLE + p_size / 10.0::DOUBLE", "maxy": "p_partkey % 140 - 70.0::DOUBLE + p_size / 20.0::DOUBLE"}
BOX_SQL = ", ".join(f"{v} AS {k}" for k, v in BOX.items())


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rasters of a catalog."""
    p = table(spark, sf_dir, "part")
    minx, miny = F.col("p_partkey") % 300 - 150.0, F.col("p_partkey") % 140 - 70.0
    return p.select("*", minx.alias("minx"), miny.alias("miny"), (minx + F.col("p_size") / 10.0).alias("maxx"), (miny + F.col("p_size") / 20.0).alias("maxy"))


@query(f"""
WITH p AS (SELECT p_partkey, {BOX_SQL} FROM part),
q AS (SELECT p_partkey, unnest([minx, maxx, minx, maxx, (minx + maxx) / 2, (minx + maxx) / 2, minx, maxx]) AS x, unnest([miny, miny, maxy, maxy, miny, maxy, (miny + maxy) / 2, (miny + maxy) / 2]) AS y FROM p),
m AS (SELECT p_partkey, radians(x) * 6378137 AS x, ln(tan(pi() / 4 + radians(y) / 2)) * 6378137 AS y FROM q)
SELECT p_partkey, round(min(x), 3) + 0.0 AS minx, round(min(y), 3) + 0.0 AS miny, round(max(x), 3) + 0.0 AS maxx, round(max(y), 3) + 0.0 AS maxy FROM m GROUP BY p_partkey
""")
def bounds_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    spots = F.transform(crs.bounds_points(*box), lambda p: F.struct(crs.mercator_x(p["x"]).alias("x"), crs.mercator_y(p["y"]).alias("y")))
    p = footprints(spark, sf_dir).select("p_partkey", spots.alias("s"))
    side = lambda f, c: rounded(f(F.transform("s", lambda p: p[c])), 3)
    return p.select("p_partkey", side(F.array_min, "x").alias("minx"), side(F.array_min, "y").alias("miny"), side(F.array_max, "x").alias("maxx"), side(F.array_max, "y").alias("maxy"))


@query(f"""
WITH p AS (SELECT p_partkey, {BOX_SQL}, (p_size + 1) / 1000.0::DOUBLE AS scale FROM part),
b AS (SELECT p_partkey, scale, radians(minx) * 6378137 AS minx, radians(maxx) * 6378137 AS maxx, ln(tan(pi() / 4 + radians(miny) / 2)) * 6378137 AS miny, ln(tan(pi() / 4 + radians(maxy) / 2)) * 6378137 AS maxy FROM p),
r AS (SELECT *, greatest(scale * 111000, 1.0) AS res FROM b)
SELECT p_partkey, round(res, 6) AS resolution, least(greatest(ceil((maxx - minx) / res), 1), 16384)::BIGINT AS width, least(greatest(ceil((maxy - miny) / res), 1), 16384)::BIGINT AS height FROM r
""")
def reproject_auto_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output grids of footprints in degrees, taken to Mercator metres."""
    scale = (F.col("p_size") + 1) / 1000.0
    res = catalog.auto_resolution((scale, scale), True, False)
    box = tuple(f(F.col(c)) for f, c in ((crs.mercator_x, "minx"), (crs.mercator_y, "miny"), (crs.mercator_x, "maxx"), (crs.mercator_y, "maxy")))
    width, height = catalog.grid_size(box, res)
    return footprints(spark, sf_dir).select("p_partkey", F.round(res[0], 6).alias("resolution"), width.alias("width"), height.alias("height"))


@query("""
WITH c AS (SELECT cy * 8 + cx AS chunk, cx AS chunk_x, cy AS chunk_y, cx * 128 AS x0, cy * 128 AS y0 FROM range(8) a(cx), range(6) b(cy)),
d AS (SELECT *, least(128, 1000 - x0) AS width, least(128, 700 - y0) AS height FROM c)
SELECT chunk, chunk_x, chunk_y, x0, y0, width, height, round(-10 + x0 * 0.02::DOUBLE, 6) AS minx, round(50 - (y0 + height) * 0.02::DOUBLE, 6) AS miny,
       round(-10 + (x0 + width) * 0.02::DOUBLE, 6) AS maxx, round(50 - y0 * 0.02::DOUBLE, 6) AS maxy FROM d
""")
def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reproject.Reprojection(4326, (-10.0, 36.0, 10.0, 50.0), 1000, 700)
    return reproject.chunk_grid(spark, p, 128).withColumns({c: rounded(F.col(c), 6) for c in ("minx", "miny", "maxx", "maxy")})


def affine_sql(point: bool) -> str:
    h = 0.5 if point else 0.0
    return f"""SELECT event_id, round(10 + ({LON} - 3.5) / 0.25 + {h}, 6) + 0.0 AS px, round(20 + (48.5 - ({LAT})) / 0.5 + {h}, 6) + 0.0 AS py,
    round(3.5 + (({LON}) - 10 + {h}) * 0.25, 6) + 0.0 AS wx, round(48.5 - (({LAT}) - 20 + {h}) * 0.5, 6) + 0.0 AS wy FROM events"""


def affine(spark: SparkSession, sf_dir: str, point: bool) -> DataFrame:
    t = GeoTransform(0.25, 0.5, 10, 20, 3.5, 48.5, point)
    px, py = t.world_to_pixel(F.col("lon"), F.col("lat"))
    wx, wy = t.pixel_to_world(F.col("lon"), F.col("lat"))
    return lonlat(spark, sf_dir).select("event_id", *[rounded(c, 6).alias(n) for n, c in (("px", px), ("py", py), ("wx", wx), ("wy", wy))])


@query(affine_sql(False))
def affine_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affine(spark, sf_dir, False)


@query(affine_sql(True))
def affine_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affine(spark, sf_dir, True)


@query("""
WITH p AS (SELECT event_id, (event_id * 13) % 1000 AS px, (user_id * 17 + event_id) % 700 AS py FROM events),
t AS (SELECT *, (py // 48) * 16 + px // 64 AS tile_index FROM p)
SELECT event_id, tile_index, (py % 48) * 64 + px % 64 AS pixel, (tile_index % 16) * 64 AS x0, (tile_index // 16) * 48 AS y0,
       least((tile_index % 16 + 1) * 64, 1000) AS x1, least((tile_index // 16 + 1) * 48, 700) AS y1 FROM t
""")
def tile_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = Level(1000, 700, 64, 48)
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 13 % 1000).alias("px"), ((F.col("user_id") * 17 + F.col("event_id")) % 700).alias("py"))
    e = e.withColumn("tile_index", geo.tile_index(F.col("px"), F.col("py"), level))
    return e.select("event_id", "tile_index", geo.pixel_in_tile(F.col("px"), F.col("py"), level).alias("pixel"), *[c.alias(n) for n, c in geo.tile_pixel_range(F.col("tile_index"), level).items()])


# point queries

#: The raster at 10 degrees east, 60 north, 0.05 degrees a pixel.
PLACE = GeoTransform(0.05, 0.05, 0, 0, 10.0, 60.0)
POINTS = "SELECT event_id, 9.513::DOUBLE + (event_id * 7 % 2200) / 200.0::DOUBLE AS x, 60.317::DOUBLE - (event_id * 13 % 1800) / 200.0::DOUBLE AS y FROM events"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", (F.lit(9.513) + F.col("event_id") * 7 % 2200 / 200.0).alias("x"), (F.lit(60.317) - F.col("event_id") * 13 % 1800 / 200.0).alias("y"))


def sample_sql(select: str, tile_height: int = 8, n_bands: int = 1) -> str:
    return f"""
WITH g AS (SELECT {tile_height} * CAST(ceil(count(*) / 25.0) AS BIGINT) AS hh FROM embeddings), p AS ({POINTS}),
q AS (SELECT event_id, hh, (x - 10.0) / 0.05::DOUBLE AS fx, (60.0 - y) / 0.05::DOUBLE AS fy FROM p, g),
l AS (SELECT event_id, CASE WHEN fx >= 0 AND fx < 200 AND fy >= 0 AND fy < hh THEN floor(fx)::BIGINT END AS px, CASE WHEN fx >= 0 AND fx < 200 AND fy >= 0 AND fy < hh THEN floor(fy)::BIGINT END AS py FROM q),
s AS (SELECT l.*, CASE WHEN label <> 0 THEN embedding END AS t, ((py % {tile_height}) * 8 + px % 8) * {n_bands} + 1 AS k0 FROM l LEFT JOIN embeddings e ON e.vec_id = (py // {tile_height}) * 25 + px // 8)
{select}"""


def clean(c: Column, digits: int = 6) -> Column:
    return F.when(~F.isnan(c), rounded(c.cast("double"), digits))


@query(sample_sql("SELECT event_id, px, py, px IS NOT NULL AS inside, round(t[k0]::DOUBLE, 6) + 0.0 AS value, px IS NOT NULL AND t IS NULL AS is_nan FROM s"))
def sample_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = level_of(spark, sf_dir)
    out = sample.sample_band(points(spark, sf_dir), tiles_of(spark, sf_dir), level, PLACE, 0)
    return out.select("event_id", "px", "py", F.col("px").isNotNull().alias("inside"), clean(F.col("value")).alias("value"), F.coalesce(F.isnan("value"), F.lit(False)).alias("is_nan"))


@query(sample_sql("SELECT event_id, px IS NOT NULL AS is_valid, CASE WHEN px IS NULL THEN 0 ELSE 2 END AS values, CASE WHEN t IS NULL THEN 0 ELSE 2 END AS valid_bands, t IS NOT NULL AS has_data, round(t[k0]::DOUBLE, 6) + 0.0 AS b0, round(t[k0 + 1]::DOUBLE, 6) + 0.0 AS b1 FROM s", 4, 2))
def sample_all_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = level_of(spark, sf_dir, 4, 2)
    out = sample.sample_points(points(spark, sf_dir), tiles_of(spark, sf_dir), level, PLACE)
    v = F.col("values")
    vec = sample.to_vec(v, 2)
    return out.select("event_id", "is_valid", F.size(v).alias("values"), sample.valid_band_count(v).alias("valid_bands"), sample.has_valid_data(v).alias("has_data"), clean(vec[0]).alias("b0"), clean(vec[1]).alias("b1"))


@query(sample_sql("SELECT event_id, round(t[k0]::DOUBLE, 6) + 0.0 AS value FROM s WHERE px IS NOT NULL"))
def sample_batch_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points in Mercator metres against the raster in degrees; those inside."""
    p = points(spark, sf_dir)
    p = p.select("event_id", crs.mercator_x(F.col("x")).alias("x"), crs.mercator_y(F.col("y")).alias("y"))
    out = sample.sample_band(p, tiles_of(spark, sf_dir), level_of(spark, sf_dir), PLACE, 0, 3857, 4326)
    return out.where(F.col("px").isNotNull()).select("event_id", clean(F.col("value")).alias("value"))


def one_of_two(which: int, sql: str) -> str:
    return sql.replace("FROM s", f"FROM s WHERE event_id % 2 = {which}")


@query(
    "SELECT * FROM ("
    + one_of_two(0, sample_sql("SELECT event_id, 'tall' AS raster_id, px, py, round(t[k0]::DOUBLE, 6) + 0.0 AS first, NULL::DOUBLE AS second FROM s"))
    + ") UNION ALL SELECT * FROM ("
    + one_of_two(1, sample_sql("SELECT event_id, 'flat' AS raster_id, px, py, round(t[k0]::DOUBLE, 6) + 0.0 AS first, round(t[k0 + 1]::DOUBLE, 6) + 0.0 AS second FROM s", 4, 2))
    + ")"
)
def sample_two_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of two rasters of different shape in one job, joined by raster and tile."""
    rows = []
    for name, level in (("tall", level_of(spark, sf_dir)), ("flat", level_of(spark, sf_dir, 4, 2))):
        rows.append((name, level.width, level.height, level.tile_width, level.tile_height, level.bands, None, PLACE.scale_x, PLACE.scale_y, 0.0, 0.0, PLACE.tie_x, PLACE.tie_y, False))
    rasters = spark.createDataFrame(rows, "raster_id string, width int, height int, tile_width int, tile_height int, bands int, crs int, scale_x double, scale_y double, tie_px double, tie_py double, tie_x double, tie_y double, is_point boolean")
    tiles = tiles_of(spark, sf_dir).select(F.explode(F.array(F.lit("tall"), F.lit("flat"))).alias("raster_id"), "tile_index", "pixels")
    p = points(spark, sf_dir).withColumn("raster_id", F.when(F.col("event_id") % 2 == 0, "tall").otherwise("flat"))
    out = sample.sample_rasters(p, tiles, rasters)
    at = lambda i: clean(F.try_element_at("values", F.lit(i)))
    return out.select("event_id", "raster_id", "px", "py", at(1).alias("first"), at(2).alias("second"))


@query(sample_sql("SELECT event_id, px IS NULL AS outside FROM s WHERE px IS NULL"))
def sample_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample.sample_points(points(spark, sf_dir), tiles_of(spark, sf_dir), level_of(spark, sf_dir), PLACE)
    return out.where(~F.col("is_valid")).select("event_id", (F.size("values") == 0).alias("outside"))


@query("""
WITH g AS (SELECT 4 * CAST(ceil(count(*) / 25.0) AS BIGINT) AS hh FROM embeddings),
p AS (SELECT event_id, (event_id % 4 - 1)::BIGINT AS band, (event_id * 3) % 210 AS x, (event_id * 5 + user_id) % (hh + 10) AS y, hh FROM events, g),
s AS (SELECT p.*, band BETWEEN 0 AND 1 AND x < 200 AND y < hh AS ok, CASE WHEN label <> 0 THEN embedding END AS t FROM p LEFT JOIN embeddings e ON e.vec_id = (y // 4) * 25 + x // 8 AND x < 200 AND y < hh)
SELECT event_id, ok AS inside, CASE WHEN ok THEN round(t[((y % 4) * 8 + x % 8) * 2 + band + 1]::DOUBLE, 6) + 0.0 END AS value FROM s
""")
def sample_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = level_of(spark, sf_dir, 4, 2)
    p = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4 - 1).alias("band"), (F.col("event_id") * 3 % 210).alias("x"), ((F.col("event_id") * 5 + F.col("user_id")) % (level.height + 10)).alias("y"))
    out = sample.sample_pixels(p, tiles_of(spark, sf_dir), level)
    return out.select("event_id", F.col("value").isNotNull().alias("inside"), clean(F.col("value")).alias("value"))


@query(sample_sql("SELECT event_id, round(t[k0]::DOUBLE, 6) + 0.0 AS value FROM s"))
def stream_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as a stream of files over the static raster."""
    from tessera.streaming import points as stream

    source = table(spark, sf_dir, "events")
    e = stream.read_points(spark, f"{sf_dir}/event[s].parquet", source.schema)
    e = e.select("event_id", (F.lit(9.513) + F.col("event_id") * 7 % 2200 / 200.0).alias("x"), (F.lit(60.317) - F.col("event_id") * 13 % 1800 / 200.0).alias("y"))
    out = stream.sampled(e, tiles_of(spark, sf_dir), level_of(spark, sf_dir), PLACE)
    return stream.drain_files(out.select("event_id", clean(F.col("value")).alias("value")))


# levels and statistics


@query("""
WITH r AS (SELECT event_id AS id, (event_id * 37) % 9000 + 1 AS w, (user_id * 101 + event_id) % 5000 + 1 AS h, CASE WHEN event_id % 5 < 4 THEN (event_id % 5)::INTEGER END AS min_usable FROM events),
l(overview, scale) AS (VALUES (0, 2.0), (1, 4.0), (2, 8.2), (3, 16.0)),
m AS (SELECT r.*, greatest(w, h) / 256.0::DOUBLE AS needed FROM r)
SELECT id, w, h, min_usable, CASE WHEN needed >= 1.5 THEN (SELECT arg_max(overview, scale) FROM l WHERE scale <= needed AND overview <= min_usable) END AS overview FROM m
""")
def best_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("event_id").alias("id"), (F.col("event_id") * 37 % 9000 + 1).alias("w"), ((F.col("user_id") * 101 + F.col("event_id")) % 5000 + 1).alias("h"), F.when(F.col("event_id") % 5 < 4, F.col("event_id") % 5).cast("int").alias("min_usable"))
    # a file has at most eleven overviews
    levels_ = F.broadcast(spark.createDataFrame([(0, 2.0, 2.0), (1, 4.0, 4.0), (2, 8.2, 8.0), (3, 16.0, 16.0)], "overview int, scale_x double, scale_y double"))
    return levels.best_overview(r, levels_)


@query("SELECT vec_id AS tile_index, len(list_filter(embedding, lambda x: x > 0.5 AND x <> 0))::BIGINT AS valid, len(embedding)::BIGINT AS samples FROM embeddings")
def tile_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples above a half as data, the others as zero."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_index"), F.transform("embedding", lambda x: F.when(x > 0.5, x).otherwise(F.lit(0.0).cast("float"))).alias("pixels"))
    return levels.tile_density(t)


@query("""
WITH t AS (SELECT (vec_id % 4) AS level, vec_id // 4 AS i, list_transform(embedding, lambda x: CASE WHEN x > 0.1 AND label <> 0 THEN x ELSE 0 END) AS p FROM embeddings),
n AS (SELECT level, max(i) + 1 AS n FROM t GROUP BY level),
c AS (SELECT t.level, len(list_filter(p, lambda x: x <> 0)) AS v, len(p) AS s FROM t JOIN n USING (level) WHERE t.level >= 1 AND (i = 0 OR i = n // 2 OR i = n - 1))
SELECT level, sum(v)::BIGINT AS valid, sum(s)::BIGINT AS samples, sum(v) >= 0.05 * sum(s) AS usable FROM c GROUP BY level
""")
def overview_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0).cast("float")
    t = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("level"), F.floor(F.col("vec_id") / 4).alias("tile_index"), F.transform("embedding", lambda x: F.when((x > F.lit(0.1)) & (F.col("label") != 0), x).otherwise(zero)).alias("pixels"))
    return levels.quality_hint(t)


HINT = "CASE WHEN event_id % 6 = 5 THEN NULL ELSE event_id % 6 - 2 END"


@query(f"""
WITH h AS (SELECT event_id, {HINT} AS v FROM events)
SELECT event_id, CASE WHEN v IS NULL THEN 'compute_at_runtime' WHEN v = -1 THEN 'all_usable' WHEN v = -2 THEN 'none_usable' ELSE 'min_usable:' || v END AS hint, v::INTEGER AS stored,
       (CASE WHEN v IS NULL OR v = -2 THEN NULL WHEN v = -1 THEN 2 ELSE least(v, 2) END)::INTEGER AS usable FROM h
""")
def hint_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 6 != 5, F.col("event_id") % 6 - 2).cast("int")
    e = table(spark, sf_dir, "events").select("event_id", v.alias("v")).withColumn("hint", levels.hint_from_db(F.col("v")))
    usable = F.when(F.col("v").isNotNull(), levels.usable_from_hint(F.col("v"), 3))
    return e.select("event_id", "hint", levels.hint_to_db(F.col("hint")).alias("stored"), usable.cast("int").alias("usable"))


@query("SELECT min(x)::DOUBLE AS min_value, max(x)::DOUBLE AS max_value FROM (SELECT unnest(embedding) AS x FROM embeddings WHERE label <> 0) WHERE NOT isnan(x)")
def minmax_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.estimate_min_max(tiles_of(spark, sf_dir).withColumn("level", F.lit(0)))


@query("""
WITH g AS (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) AS d FROM embeddings),
t AS (SELECT unnest(embedding) AS x FROM embeddings, g WHERE label <> 0 AND vec_id IN (0, 24, 25 * d - 25, 25 * d - 1, 25 * d // 2))
SELECT coalesce(min(x)::DOUBLE, 0) AS min_value, coalesce(max(x)::DOUBLE, 1) AS max_value FROM t WHERE NOT isnan(x)
""")
def minmax_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = level_of(spark, sf_dir)
    return stats.estimate_min_max_fast(tiles_of(spark, sf_dir), level.across, level.down)


@query("SELECT min(v) AS min_value, max(v) AS max_value FROM (SELECT l_extendedprice AS v FROM lineitem) WHERE NOT (abs(v - 1000) < 0.001)")
def minmax_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.range_of(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("v")), 1000.0)


@query("SELECT coalesce(min(v), 0) AS min_value, coalesce(max(v), 0) AS max_value FROM (SELECT l_quantity::DOUBLE AS v FROM lineitem) WHERE NOT (abs(v - 1) < 1.1920929e-07)")
def minmax_lzw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.min_max_lzw(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("v")), 1.0)


@query("SELECT coalesce(min(v), 0) AS min_value, coalesce(max(v), 0) AS max_value FROM (SELECT o_totalprice::DOUBLE AS v FROM orders)")
def minmax_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.min_max_chunked(table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("v")))


# catalogs


@query("SELECT count(*) AS files, sum(p_size)::BIGINT AS total_size, sum(p_size) / 1048576.0::DOUBLE AS total_size_mb, count_if(p_size % 2 = 0)::BIGINT AS tiled, count_if(p_size > 25)::BIGINT AS with_overviews FROM part")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), (F.col("p_size") % 2 == 0).alias("is_tiled"), (F.col("p_size") > 25).alias("has_overviews"))
    return catalog.stats(p)


@query(f"SELECT p_partkey FROM (SELECT p_partkey, {BOX_SQL} FROM part) WHERE minx <= 20 AND maxx >= -5 AND miny <= 30 AND maxy >= 0")
def find_intersecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_intersecting(footprints(spark, sf_dir), (-5.0, 0.0, 20.0, 30.0)).select("p_partkey")


@query("SELECT p_brand AS name, max(p_partkey) AS ordinal, arg_max(p_size, p_partkey)::INTEGER AS size FROM part GROUP BY p_brand")
def catalog_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as names: of several entries the last counts."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("ordinal"), F.col("p_size").cast("int").alias("size"))
    return catalog.last_of_each_name(p)


@query(f"""
WITH p AS (SELECT p_partkey AS name, {BOX_SQL} FROM part),
w AS (SELECT s_suppkey AS window, s_suppkey * 7 % 320 - 160.0::DOUBLE AS a, s_suppkey * 11 % 150 - 75.0::DOUBLE AS b, s_suppkey * 7 % 320 - 157.0::DOUBLE AS c, s_suppkey * 11 % 150 - 73.0::DOUBLE AS d FROM supplier)
SELECT "window", name FROM p JOIN w ON minx <= c AND maxx >= a AND miny <= d AND maxy >= b
""")
def window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    w = table(spark, sf_dir, "supplier").select(k.alias("window"), (k * 7 % 320 - 160.0).alias("minx"), (k * 11 % 150 - 75.0).alias("miny"), (k * 7 % 320 - 157.0).alias("maxx"), (k * 11 % 150 - 73.0).alias("maxy"))
    return catalog.window_join(footprints(spark, sf_dir).withColumnRenamed("p_partkey", "name"), w)


@query(r"""
WITH p AS (SELECT p_partkey, 'data/layer.' || (p_partkey % 7) || '/' || replace(p_name, ' ', '.') || CASE p_partkey % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' WHEN 2 THEN '.png' ELSE '.GeoTif' END AS path FROM part)
SELECT p_partkey, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS local_name, regexp_extract(path, '([^/.]*)[^/]*$', 1) AS bucket_name FROM p WHERE lower(regexp_extract(path, '\.([^./]+)$', 1)) IN ('tif', 'tiff', 'geotiff', 'geotif')
""")
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    end = F.when(k % 4 == 0, ".tif").when(k % 4 == 1, ".TIFF").when(k % 4 == 2, ".png").otherwise(".GeoTif")
    path = F.concat(F.lit("data/layer."), (k % 7).cast("string"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), end)
    p = table(spark, sf_dir, "part").select(k, path.alias("path")).where(catalog.has_extension(F.col("path")))
    return p.select("p_partkey", catalog.local_name(F.col("path")).alias("local_name"), catalog.bucket_name(F.col("path")).alias("bucket_name"))


@query("""
WITH s AS (SELECT o_custkey % 50 AS file, o_orderkey, 1000 + o_orderkey * 7919 % 50000 AS n, o_orderkey * 31 % 90000 AS hole FROM orders),
r AS (SELECT file, o_orderkey, n, sum(n + hole) OVER (PARTITION BY file ORDER BY o_orderkey) - n AS off FROM s),
m AS (SELECT *, off > max(off + n) OVER (PARTITION BY file ORDER BY off, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 32768 AS gap FROM r),
i AS (SELECT *, sum(CASE WHEN coalesce(gap, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY off, n ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT file, min(off)::BIGINT AS start, max(off + n)::BIGINT AS stop, count(*) AS parts FROM i GROUP BY file, island
""")
def range_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("file"), "o_orderkey", (F.col("o_orderkey") * 7919 % 50000 + 1000).alias("length"), (F.col("o_orderkey") * 31 % 90000).alias("hole"))
    running = F.sum(F.col("length") + F.col("hole")).over(Window.partitionBy("file").orderBy("o_orderkey").rangeBetween(Window.unboundedPreceding, 0))
    return catalog.merge_ranges(o.select("file", (running - F.col("length")).alias("offset"), "length"))


@query("""
WITH RECURSIVE s AS (SELECT o_custkey % 50 AS file, o_orderkey, 1000 + o_orderkey * 7919 % 50000 AS n, o_orderkey * 31 % 90000 AS hole FROM orders),
r AS (SELECT file, n, sum(n + hole) OVER (PARTITION BY file ORDER BY o_orderkey) - n AS off FROM s),
i AS (SELECT file, off::BIGINT AS a, (off + n)::BIGINT AS b, row_number() OVER (PARTITION BY file ORDER BY off, n) AS k FROM r),
w AS (
  SELECT file, k, a AS start, b AS stop, 1 AS island FROM i WHERE k = 1
  UNION ALL
  SELECT file, i.k, CASE WHEN i.a <= stop + 32768 AND greatest(i.b, stop) - start <= 262144 THEN start ELSE i.a END, CASE WHEN i.a <= stop + 32768 AND greatest(i.b, stop) - start <= 262144 THEN greatest(i.b, stop) ELSE i.b END,
         island + CASE WHEN i.a <= stop + 32768 AND greatest(i.b, stop) - start <= 262144 THEN 0 ELSE 1 END
  FROM w JOIN i USING (file) WHERE i.k = w.k + 1
)
SELECT file, min(start) AS start, max(stop) AS stop, count(*) AS parts FROM w GROUP BY file, island
""")
def range_coalesce_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranges, no merged one above 256 KiB."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("file"), "o_orderkey", (F.col("o_orderkey") * 7919 % 50000 + 1000).alias("length"), (F.col("o_orderkey") * 31 % 90000).alias("hole"))
    running = F.sum(F.col("length") + F.col("hole")).over(Window.partitionBy("file").orderBy("o_orderkey").rangeBetween(Window.unboundedPreceding, 0))
    return catalog.merge_ranges(o.select("file", (running - F.col("length")).alias("offset"), "length"), most=256 << 10)


# pixels and files


@query("""
WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i, label FROM embeddings),
b AS (SELECT vec_id, i // 4 AS pixel, max(CASE WHEN i % 4 = 0 THEN v END) AS r, max(CASE WHEN i % 4 = 1 THEN v END) AS g, max(CASE WHEN i % 4 = 2 THEN v END) AS b, max(CASE WHEN i % 4 = 3 THEN v END) * 255 AS a, any_value(label) AS label FROM p GROUP BY ALL),
k AS (SELECT *, label = 0 AS gap FROM b)
SELECT vec_id, pixel, (CASE WHEN gap THEN 0 ELSE least(greatest(floor((r + 1) / 2 * 255 + 0.5), 0), 255) END)::INTEGER AS r, (CASE WHEN gap THEN 0 ELSE least(greatest(floor((g + 1) / 2 * 255 + 0.5), 0), 255) END)::INTEGER AS g,
       (CASE WHEN gap THEN 0 ELSE least(greatest(floor((b + 1) / 2 * 255 + 0.5), 0), 255) END)::INTEGER AS b, (CASE WHEN gap THEN 0 ELSE least(greatest(floor(a + 0.5), 0), 255) END)::INTEGER AS a FROM k
""")
def rgba_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as 16 pixels of four bands, from -1 .. 1; sparse tiles are transparent."""
    e = table(spark, sf_dir, "embeddings")
    p = e.select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pixel"), "embedding")
    at = lambda i: F.when(F.col("label") != 0, F.element_at("embedding", F.col("pixel") * 4 + i + 1).cast("double"))
    p = p.select("vec_id", F.col("pixel").cast("long").alias("pixel"), *[at(i).alias(n) for i, n in enumerate(("x", "y", "z"))], (at(3) * 255).alias("w"))
    return rgba.to_rgba8(p, ["x", "y", "z", "w"], None, (-1.0, 1.0)).select("vec_id", "pixel", "r", "g", "b", "a")


@query("""
WITH p AS (SELECT vec_id, unnest(range(16)) AS pixel, embedding AS e FROM embeddings),
v AS (SELECT vec_id, pixel, (vec_id + pixel) % 3 AS kind, list_transform([1, 2, 3, 4], lambda i: floor(abs(e[pixel * 4 + i]::DOUBLE) * 255)) AS v FROM p),
q AS (SELECT vec_id, pixel, CASE WHEN kind < 2 THEN 9 ELSE v[1] END AS r, CASE WHEN kind < 2 THEN 9 ELSE v[2] END AS g, CASE WHEN kind < 2 THEN 9 ELSE v[3] END AS b, CASE WHEN kind = 0 THEN 9 ELSE v[4] + 10 END AS a FROM v)
SELECT vec_id, pixel, (CASE WHEN gap THEN 0 ELSE least(r, 255) END)::INTEGER AS r, (CASE WHEN gap THEN 0 ELSE least(g, 255) END)::INTEGER AS g, (CASE WHEN gap THEN 0 ELSE least(b, 255) END)::INTEGER AS b, (CASE WHEN gap THEN 0 ELSE least(a, 255) END)::INTEGER AS a
FROM (SELECT *, r = 9 AND g = 9 AND b = 9 AND a = 9 AS gap FROM q)
""")
def rgba_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bands where a pixel is nodata only if its alpha is, too."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pixel"), "embedding")
    at = lambda i: F.floor(F.abs(F.element_at("embedding", F.col("pixel") * 4 + i + 1).cast("double")) * 255).cast("double")
    kind = (F.col("vec_id") + F.col("pixel")) % 3
    bands = [F.when(kind < 2, 9.0).otherwise(at(i)).alias(n) for i, n in enumerate("xyz")] + [F.when(kind == 0, 9.0).otherwise(at(3) + 10).alias("w")]
    return rgba.to_rgba8(e.select("vec_id", F.col("pixel").cast("long").alias("pixel"), *bands), list("xyzw"), 9.0).select("vec_id", "pixel", "r", "g", "b", "a")


@query("SELECT l_orderkey, l_linenumber, (sum(l_partkey % 256) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) % 256)::BIGINT AS sample FROM lineitem")
def predictor2_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a row of bytes that are horizontal differences, which the decoder undoes."""
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("l"))
    rows = rows.select("l_orderkey", F.transform("l", lambda x: x["l_linenumber"].cast("long")).alias("n"), F.transform("l", lambda x: (x["l_partkey"] % 256).cast("int")).alias("d"))

    def undo(batches):
        for b in batches:
            out = []
            for d in b.column(2):
                raw = np.asarray(d.values.to_numpy(zero_copy_only=False)).astype(np.uint8).tobytes()
                out.append(tiff.undo_predictor(raw, 2, len(raw), 1, "u1", True).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["l_orderkey", "n", "s"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(undo, f"l_orderkey {kinds['l_orderkey']}, n array<bigint>, s array<bigint>")
    return out.select("l_orderkey", F.explode(F.arrays_zip("n", "s")).alias("x")).select("l_orderkey", F.col("x.n").cast(dict(table(spark, sf_dir, "lineitem").dtypes)["l_linenumber"]).alias("l_linenumber"), F.col("x.s").alias("sample"))


def synthetic(width: int, height: int, bands: int, kind: str) -> np.ndarray:
    y, x, b = np.mgrid[0:height, 0:width, 0:bands]
    return ((7 * x + 13 * y + 50 * b) % 250 + 1).astype(kind)


#: name, bands, sample type, compression, predictor, BigTIFF.
FILES = (("deflate_u8", 3, "u1", "deflate", 2, False), ("lzw_u16", 1, "u2", "lzw", 2, True), ("zstd_f32", 2, "f4", "zstd", 3, False), ("none_i32", 1, "i4", "none", 1, True))


def sample_files(spark: SparkSession) -> DataFrame:
    rows = []
    for name, bands, kind, compression, predictor, big in FILES:
        w = tiff.Writer(compression, predictor, 64, 4326, -1.0, big=big, overviews=2, sparse=frozenset({(0, 3)}))
        content = w.bytes_of(synthetic(300, 200, bands, kind), 10.0, 50.0, 0.01, 0.01)
        rows.append((f"mem/{name}.tif", datetime.datetime(2024, 1, 1), len(content), bytearray(content)))
    return spark.createDataFrame(rows, "path string, modificationTime timestamp, length long, content binary")


@query("""
WITH f(raster_id, bands, dtype, compression, predictor, big_tiff) AS (VALUES ('deflate_u8', 3, 'u1', 'deflate', 2, FALSE), ('lzw_u16', 1, 'u2', 'lzw', 2, TRUE), ('zstd_f32', 2, 'f4', 'zstd', 3, FALSE), ('none_i32', 1, 'i4', 'none', 1, TRUE))
SELECT *, 300 AS width, 200 AS height, 64 AS tile_width, 4326 AS crs, -1.0::DOUBLE AS nodata, 10.0::DOUBLE AS tie_x, 50.0::DOUBLE AS tie_y, 0.01::DOUBLE AS scale_x, 2 AS overviews FROM f
""")
def tiff_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cog.from_files(sample_files(spark), "rasters").select("raster_id", "bands", "dtype", "compression", "predictor", "big_tiff", "width", "height", "tile_width", "crs", "nodata", "tie_x", "tie_y", "scale_x", "overviews")


@query("""
WITH f(raster_id, bands) AS (VALUES ('deflate_u8', 3), ('lzw_u16', 1), ('zstd_f32', 2), ('none_i32', 1)),
l(level, step, w, h) AS (VALUES (0, 1, 300, 200), (1, 2, 150, 100), (2, 4, 75, 50)),
t AS (SELECT *, (w + 63) // 64 AS across, unnest(range(((w + 63) // 64) * ((h + 63) // 64))) AS tile_index FROM f, l),
p AS (SELECT raster_id, level, tile_index, (7 * x * step + 13 * y * step + 50 * b) % 250 + 1 AS v FROM t, range(300) a(x), range(200) c(y), range(3) d(b)
      WHERE x < w AND y < h AND b < bands AND x // 64 = tile_index % across AND y // 64 = tile_index // across AND NOT (level = 0 AND tile_index = 3))
SELECT raster_id, level::INTEGER AS level, tile_index, sum(v)::BIGINT AS total FROM p GROUP BY ALL
""")
def tiff_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of each decoded tile; the sparse one has none."""
    t = cog.from_files(sample_files(spark), "tiles").where(~F.isnan(F.col("pixels")[0]))
    total = F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v.cast("double")).cast("long")
    return t.select("raster_id", "level", "tile_index", total.alias("total"))


@query()
def tiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered tile as a GeoTIFF, read back: its samples are those that were written."""
    from tessera.sources.geotiff import to_geotiff

    level = level_of(spark, sf_dir)
    q = one_request(level, FINE, "bilinear")
    out = kernel.extract_tiles(spark, [q], tiles_of(spark, sf_dir), level)
    image = to_geotiff(out, {0: q.box}, 3857, "deflate")
    files = image.select(F.lit("mem/0.tif").alias("path"), F.lit(datetime.datetime(2024, 1, 1)).alias("modificationTime"), F.length("image").cast("long").alias("length"), F.col("image").alias("content"))
    back = cog.from_files(files, "tiles").select(F.lit(0).cast("long").alias("request"), F.col("pixels").alias("back"))
    same = F.forall(F.arrays_zip("pixels", "back"), lambda x: x["pixels"].eqNullSafe(x["back"]))
    return out.join(back, "request").select("request", "width", "height", same.alias("same"))


def webp_pieces(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Rendered images of at most `side` pixels on a side, each from a group of its own, as they share no tile."""
    level = level_of(spark, sf_dir)
    q = one_request(level, (64, 0.25, 0.625, 0.125, 2.0), "nearest")
    p = reproject.Reprojection(3857, q.box, q.width, q.height, "nearest")
    return kernel.extract_tiles(spark, reproject.chunk_table(spark, p, side), tiles_of(spark, sf_dir), level, 3857, together=1)


@query()
def webp_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole height as images, one below the other: one where it fits the format, else `request` is the image's number."""
    out = webp_pieces(spark, sf_dir, webp.MOST_SIDE)
    return webp.to_webp(out, None, (-1.0, 1.0)).select("request", F.length("image").alias("size"), F.hex(F.substring("image", 9, 8)).alias("kind"))


@query("""
WITH v AS (SELECT event_id, event_id * 40503 % 200000 - 1000 AS i, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value - 100 END AS f FROM events)
SELECT event_id, CASE WHEN i BETWEEN 0 AND 65535 THEN i END::INTEGER AS u16, CASE WHEN i >= 0 THEN i END AS usize, least(greatest(i, 0), 999) AS clamped,
       CASE WHEN f >= 0 AND f < 256 THEN floor(f) END::BIGINT AS pixel, (CASE WHEN f IS NULL OR f < 0 THEN 0 ELSE least(floor(f), 255) END)::BIGINT AS clamped_pixel FROM v
""")
def cast_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 40503 % 200000 - 1000).alias("i"), F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("value") - 100).alias("f"))
    i, f = F.col("i"), F.col("f")
    return v.select("event_id", casting.u32_to_u16(i).alias("u16"), casting.isize_to_usize(i).alias("usize"), casting.isize_to_clamped_usize(i, 1000).alias("clamped"), casting.f64_to_pixel_index(f, 256).alias("pixel"), casting.f64_to_clamped_pixel(f, 256).alias("clamped_pixel"))

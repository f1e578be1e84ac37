"""Kernels, projections, files and caches against plain forms of their rules."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import crs
from tessera.functions.geo import GeoTransform, Level, axis_scale, xyz_bbox
from tessera.operators import catalog, kernel, levels, reproject, resample, rgba, sample, stats
from tessera.plans import queries
from tessera.sources import cache, cog, geotiff, tiff, webp


def plain(c, r, ratio, level, source, method):
    """One output pixel of one band by the rules, in doubles."""
    nodata, fill = level.nodata, level.nodata if level.nodata is not None else math.nan
    ok = lambda v: not math.isnan(v) and v != nodata
    if not (-0.5 <= c <= level.width - 0.5 and -0.5 <= r <= level.height - 0.5):
        return fill
    cut = lambda v, n: min(max(v, 0), n - 1)
    away = lambda v: int(math.copysign(math.floor(abs(v) + 0.5), v))
    near = source[cut(away(r), level.height)][cut(away(c), level.width)]
    if method == "nearest":
        return near
    w = lambda x: float(kernel.weight(method, np.array([x]))[0])
    sx, sy = axis_scale(ratio[0]), axis_scale(ratio[1])
    fx, fy, n = math.floor(c), math.floor(r), kernel.SUPPORT[method]
    if min(sx, sy) < 0.95:
        if not ok(near):
            return near
        rx, ry = math.ceil(n / sx - 1e-9), math.ceil(n / sy - 1e-9)
        taps = [(x, y, w((c - x) * sx) * w((r - y) * sy)) for x in range(fx + 1 - rx, fx + rx + 1) for y in range(fy + 1 - ry, fy + ry + 1) if 0 <= x < level.width and 0 <= y < level.height]
        taps = [(source[y][x], k) for x, y, k in taps if ok(source[y][x])]
        total = sum(k for _, k in taps)
        return sum(v * k for v, k in taps) / total if total > 1e-6 else fill
    taps = [(x, y, w(c - x) * w(r - y)) for x in range(fx + 1 - n, fx + n + 1) for y in range(fy + 1 - n, fy + n + 1)]
    at = lambda x, y: source[cut(y, level.height)][cut(x, level.width)]
    inside = all(0 <= x < level.width and 0 <= y < level.height for x, y, _ in taps)
    if all(ok(at(x, y)) for x, y, _ in taps) and (method != "cubic" or inside):
        return sum(at(x, y) * k for x, y, k in taps) / sum(k for *_, k in taps)
    if not ok(near):
        return near
    core = [(at(x, y), max(0, 1 - abs(c - x)) * max(0, 1 - abs(r - y))) for x in (fx, fx + 1) for y in (fy, fy + 1)]
    core = [(v, k) for v, k in core if ok(v)]
    total = sum(k for _, k in core)
    return sum(v * k for v, k in core) / total if total >= 1e-5 else fill


@pytest.mark.parametrize("method", resample.METHODS)
@pytest.mark.parametrize("nodata", [None, -5.0])
@pytest.mark.parametrize("steps", [(0.37, 0.71), (2.5, 3.02)])
def test_render_follows_the_rules(method, nodata, steps):
    rng = np.random.default_rng(3)
    source = rng.integers(-5, 40, (23, 31)).astype(np.float32)
    source[4:7, 5:9] = np.nan
    level = Level(31, 23, 8, 8, 1, nodata)
    c, r = np.arange(-1.13, 33, steps[0]), np.arange(-1.27, 25, steps[1])
    p = kernel.Positions(c, r, steps)
    got = kernel.render(p, level, source[:, :, None], (0, 0), method, [0])[:, :, 0]
    want = np.array([[plain(x, y, steps, level, source.tolist(), method) for x in c] for y in r])
    np.testing.assert_allclose(got, want, rtol=2e-5, atol=2e-5)


def test_sql_and_numpy_paths_agree(spark):
    rng = np.random.default_rng(5)
    array = rng.normal(size=(2, 40, 50)).astype(np.float32)
    level = Level(50, 40, 16, 16, 2)
    tiles = cog.array_tiles(spark, array, 16)
    tiles = tiles.withColumn("pixels", F.when(F.col("tile_index") != 5, F.col("pixels")))
    q = kernel.Request((1.3, -35.1, 44.2, -2.2), 3857, 60, 50, "cubic", (1, 0))
    grid = resample.OutputGrid.of_box(q.box, 60, 50, level)
    sql = {(x.oy, x.ox, x.ordinal): x.value for x in resample.extract(tiles, level, grid, "cubic", [1, 0]).collect()}
    arrow = {(x.oy, x.ox, x.ordinal): x.value for x in kernel.long_pixels(kernel.extract_tiles(spark, [q], tiles, level)).collect()}
    assert sql.keys() == arrow.keys()
    for k, v in sql.items():
        assert (v is None) == (arrow[k] is None)
        assert v is None or abs(v - arrow[k]) < 1e-4


def test_bands_are_checked(spark):
    level = Level(8, 8, 8, 8, 2)
    with pytest.raises(ValueError, match="out of range"):
        resample.check_bands([2], level)
    with pytest.raises(ValueError, match="At least one"):
        resample.check_bands([], level)


def test_outside_extraction_reads_nothing(spark):
    level = Level(16, 16, 8, 8, 1, -1.0)
    tiles = cog.array_tiles(spark, np.ones((1, 16, 16)), 8)
    row = kernel.extract_tiles(spark, [kernel.Request((100, 100, 110, 110), 3857, 4, 4)], tiles, level).first()
    assert row["tiles_read"] == 0 and set(row["pixels"]) == {-1.0}


def test_semi_join_keeps_needed_tiles(spark):
    level = Level(64, 64, 8, 8)
    tiles = cog.array_tiles(spark, np.ones((1, 64, 64)), 8)
    grid = resample.OutputGrid(4, 4, 9.0, 1.0, 9.0, 1.0)
    assert resample.only_needed(tiles, level, grid, "bilinear").count() == 1


@given(st.integers(32601, 32660), st.floats(-2.5, 2.5), st.floats(-79, 83))
@settings(max_examples=60, deadline=None)
def test_utm_round_trip(epsg, off, lat):
    lon = 6 * (epsg - 32600) - 183 + off
    x, y = crs.project(np.array([lon]), np.array([lat]), 4326, epsg)
    back = crs.project(x, y, epsg, 4326)
    assert abs(back[0][0] - lon) < 1e-9 and abs(back[1][0] - lat) < 1e-9


def test_utm_known_places():
    x, y = crs.project(np.array([-123.0]), np.array([0.0]), 4326, 32610)
    assert abs(x[0] - 500000) < 1e-6 and abs(y[0]) < 1e-6
    # the meridian's length from the equator to 45 degrees, times 0.9996
    _, y = crs.project(np.array([-123.0]), np.array([45.0]), 4326, 32610)
    assert abs(y[0] - 0.9996 * 4984944.378) < 0.01


def test_unknown_crs_is_refused():
    with pytest.raises(ValueError, match="EPSG:2154"):
        crs.project(np.zeros(1), np.zeros(1), 2154, 4326)


def test_approximate_positions_keep_to_the_error():
    level = Level(4000, 4000, 256, 256, 1, None, 500000.0, 4200000.0, 30.0, 30.0)
    box = crs.transform_bounds((505000, 4150000, 560000, 4195000), 32610, 3857)
    q = kernel.Request(box, 3857, 200, 180, transform_error=0.01)
    exact = kernel.positions(kernel.Request(box, 3857, 200, 180, transform_error=0.0), level, 32610)
    near = kernel.positions(q, level, 32610)
    assert max(np.abs(near.c - exact.c).max(), np.abs(near.r - exact.r).max()) < 0.05


def test_geo_transform_origin():
    area, point = GeoTransform(2.0, 2.0, 0, 0, 10.0, 50.0), GeoTransform(2.0, 2.0, 0, 0, 11.0, 49.0, True)
    assert area.origin == point.origin == (10.0, 50.0)
    assert xyz_bbox(0, 0, 0)[3] == 20037508.342789244


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate", "zstd"])
@pytest.mark.parametrize("kind,predictor", [("u1", 1), ("u1", 2), ("i2", 2), ("u4", 2), ("f4", 1), ("f4", 3), ("f8", 3)])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_round_trip(compression, kind, predictor, big):
    rng = np.random.default_rng(1)
    pixels = (rng.normal(size=(37, 45, 3)) * 50).astype(kind)
    content = tiff.Writer(compression, predictor, 16, 32610, -7.0, big=big, overviews=2).bytes_of(pixels, 500000, 4200000, 30, 30)
    h = tiff.parse(cog.reader_of(content))
    assert (h.crs, h.nodata, h.big, len(h.images)) == (32610, -7.0, big, 3)
    rows = {(lv, n): px for _, lv, n, *_, px in cog.rows_of("tiles", "x", "x", "", cog.reader_of(content))}
    for k in range(3):
        level = h.level(k)
        tiles = {n: px for (lv, n), px in rows.items() if lv == k}
        got = kernel.window_of(tiles, (0, 0, level.width - 1, level.height - 1), level)
        np.testing.assert_array_equal(got, pixels[:: 2**k, :: 2**k].astype(np.float32))


def test_big_endian_and_strips():
    import struct

    data = np.arange(12, dtype=">u2").reshape(3, 4)
    entries = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 3), (279, 4, 1, 24)]
    body = b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, n, v in entries)
    content = struct.pack(">2sHI", b"MM", 42, 32) + data.tobytes() + struct.pack(">H", len(entries)) + body + b"\0" * 4
    h = tiff.parse(cog.reader_of(content))
    assert not h.little and not h.images[0].tiled
    (row,) = cog.rows_of("tiles", "x", "x", "", cog.reader_of(content))
    assert row[-1].tolist() == list(range(12))


def test_bad_files():
    for content in (b"", b"II*\0", b"XX*\0" + b"\0" * 20, b"II*\0\x08\0\0\0\xff\xff"):
        with pytest.raises((tiff.TiffError, Exception)):
            tiff.parse(cog.reader_of(content))


def test_corrupt_tile_names_itself():
    content = bytearray(tiff.Writer("deflate", 1, 16, 3857).bytes_of(np.ones((32, 32, 1), np.uint8), 0, 0, 1, 1))
    h = tiff.parse(cog.reader_of(bytes(content)))
    o = h.images[0].offsets[2]
    content[o : o + 4] = b"\xff\xff\xff\xff"
    with pytest.raises(tiff.TiffError, match="cannot read tile 2 of the full resolution image"):
        list(cog.rows_of("tiles", "x", "x", "", cog.reader_of(bytes(content))))


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_lzw(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_long():
    data = np.random.default_rng(2).integers(0, 7, 60000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def files_in(folder):
    for name, epsg in (("a", 4326), ("b", 32610)):
        (folder / f"{name}.tif").write_bytes(tiff.Writer("deflate", 1, 16, epsg, overviews=1).bytes_of(np.arange(32 * 48).reshape(32, 48, 1).astype(np.uint16), 10, 50, 0.5, 0.5))
    (folder / "sub").mkdir()
    (folder / "sub" / "C.TIFF").write_bytes((folder / "a.tif").read_bytes())
    (folder / "bad.tif").write_bytes(b"no raster")
    (folder / "note.txt").write_text("x")


def test_cog_source(spark, tmp_path):
    files_in(tmp_path)
    (tmp_path / "bad.tif").unlink()
    cog.register(spark)
    read = lambda what, **o: spark.read.format("cog").options(what=what, **o).load(str(tmp_path))
    assert sorted(r.crs for r in read("rasters").collect()) == [4326, 4326, 32610]
    assert read("levels").count() == 6
    assert read("tile_index").where("raster_id = 'b'").count() == 6 + 2
    one = read("tiles").where("level = 0 and tile_index = 4 and raster_id = 'b'").collect()
    assert len(one) == 1 and one[0].pixels[0] == 16 * 48 + 16
    assert read("tiles", level=0, tiles="0,1").where("raster_id = 'a'").count() == 2


def test_discovery(spark, tmp_path):
    files_in(tmp_path)
    found = {r.name: r for r in cog.discover(spark, str(tmp_path)).collect()}
    assert set(found) == {"a", "b", "C"}
    assert (found["a"].minx, found["a"].maxy, found["a"].maxx) == (10.0, 50.0, 34.0)
    assert [r.raster_id for r in cog.from_files(cog.scan(spark, str(tmp_path), min_depth=1)).collect()] == ["C"]
    assert cog.scan(spark, str(tmp_path), limit=2).count() == 2


def test_header_cache(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files_in(tmp_path / "in")
    (tmp_path / "in" / "bad.tif").unlink()
    held = cache.HeaderCache(spark, str(tmp_path / "cache"))
    listing = lambda: cog.scan(spark, str(tmp_path / "in"))
    assert held.headers(listing()).count() == 3 and held.misses == 3
    assert held.headers(listing()).count() == 3 and held.misses == 3
    known = held.known()
    assert cog.changed(known, listing()).count() == 0
    (tmp_path / "in" / "a.tif").write_bytes((tmp_path / "in" / "b.tif").read_bytes() + b"\0")
    assert cog.changed(known, listing()).count() == 1
    assert {r.crs for r in held.headers(listing()).where("raster_id = 'a'").collect()} == {32610} and held.misses == 4
    held.invalidate(known.where("raster_id = 'b'").first().path)
    assert held.stats()["entries"] == 2
    held.clear()
    assert held.stats()["entries"] == 0


def test_tile_cache(spark):
    held = cache.TileCache()
    df = held.get("x", lambda: spark.range(3))
    assert held.get("x", lambda: spark.range(5)) is df and held.contains("x")
    held.clear()
    assert not held.contains("x")


def test_reprojection_in_chunks(spark, tmp_path):
    array = np.random.default_rng(4).normal(size=(1, 100, 120)).astype(np.float32)
    level = Level(120, 100, 32, 32, 1, None, 500000.0, 4200000.0, 30.0, 30.0)
    tiles = cog.array_tiles(spark, array, 32)
    p = reproject.plan(level, 32610, 4326, size=(70, 55), method="bilinear", transform_error=0.0)
    whole = reproject.reproject(spark, tiles, level, 32610, p).first()
    chunks = reproject.extract_chunks(spark, tiles, level, 32610, p, 32).persist()
    seen = []
    assert reproject.for_each_chunk(chunks, p, 32, lambda at, px: seen.append(at)) == 6
    assert seen == [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1)]
    out = reproject.assemble(chunks, p, 32, 1)
    a, b = np.array(whole.pixels, np.float32).reshape(55, 70, 1), out
    assert (np.isnan(a) == np.isnan(b)).all()
    np.testing.assert_allclose(np.nan_to_num(a), np.nan_to_num(b), atol=2e-2)  # each chunk has the ratio of its own span
    geotiff.write_chunked(chunks, p, 32, 1, str(tmp_path / "o.tif"))
    h = tiff.parse(cog.reader_of((tmp_path / "o.tif").read_bytes()))
    assert h.crs == 4326 and (h.images[0].width, h.images[0].height) == (70, 55)
    with pytest.raises(ValueError, match="samples"):
        reproject.assemble(chunks, reproject.Reprojection(4326, p.box, 40000, 40000), 32, 1)


def test_bounds_in_another_crs():
    level = Level(100, 100, 32, 32, 1, None, 10.0, 50.0, 0.01, 0.01)
    p = reproject.plan(level, 4326, 3857, bounds=(10.1, 49.2, 10.9, 49.9), bounds_crs=4326)
    assert p.box == crs.transform_bounds((10.1, 49.2, 10.9, 49.9), 4326, 3857) and abs(p.resolution[0] - 1110) < 15


def test_image_sink(spark, tmp_path):
    spark.dataSource.register(geotiff.ImageDataSource)
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"de"))], "request long, image binary")
    df.write.format("rasterimage").option("suffix", "tif").mode("append").save(str(tmp_path / "out"))
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["1.tif", "2.tif"]


def decode_vp8l(data: bytes) -> np.ndarray:
    """A reader of just what `webp.encode` writes."""
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L"
    bits = int.from_bytes(data[20:], "little")
    at = 0

    def take(n):
        nonlocal at
        v = bits >> at & ((1 << n) - 1)
        at += n
        return v

    def table(lengths):
        codes = webp.canonical(lengths)
        return {(n, c): s for s, (n, c) in enumerate(zip(lengths, codes, strict=True)) if n}

    def symbol(t):
        if isinstance(t, int):
            return t
        v = 0
        for n in range(1, 16):
            v |= take(1) << (n - 1)
            if (n, v) in t:
                return t[n, v]
        raise AssertionError("no such code")

    def code(n):
        if take(1):
            assert take(1) == 0
            return take(8) if take(1) else take(1)
        meta = [0] * 19
        for s in webp.LENGTH_ORDER[: take(4) + 4]:
            meta[s] = take(3)
        assert take(1) == 0
        t = table(meta)
        return table([symbol(t) for _ in range(n)])

    assert take(8) == 0x2F
    w, h = take(14) + 1, take(14) + 1
    take(1), take(3)
    assert (take(1), take(1), take(1)) == (0, 0, 0)
    tables = [code(280), code(256), code(256), code(256)]
    code(40)
    out = np.zeros((h * w, 4), np.uint8)
    for i in range(h * w):
        g, r, b, a = (symbol(t) for t in tables)
        out[i] = r, g, b, a
    return out.reshape(h, w, 4)


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (20, 33)])
@pytest.mark.parametrize("spread", [1, 3, 256])
def test_webp(shape, spread):
    rgba_ = np.random.default_rng(spread).integers(0, spread, (*shape, 4)).astype(np.uint8)
    np.testing.assert_array_equal(decode_vp8l(webp.encode(rgba_)), rgba_)


def test_webp_bits_in_steps(monkeypatch):
    rgba_ = np.random.default_rng(4).integers(0, 200, (9, 13, 4)).astype(np.uint8)
    whole = webp.encode(rgba_)
    monkeypatch.setattr(webp, "STEP", 10)
    assert webp.encode(rgba_) == whole
    np.testing.assert_array_equal(decode_vp8l(whole), rgba_)


def test_webp_query_beyond_one_image(spark, tmp_path):
    """A raster whose rendering is four rows higher than an image may be: the rest is an image of its own, no row is lost."""
    n = 25 * 4096 + 1
    sample_ = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: ((F.col("id") * 7 + k * 13) % 200 / 100 - 1).cast("float"))
    spark.range(n).select(F.col("id").alias("vec_id"), sample_.alias("embedding"), (F.col("id") % 10).cast("int").alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    oy, ox = np.mgrid[0:16388, 0:64]
    y, x = np.floor(0.125 + 2.0 * oy + 0.5).astype(int), np.floor(0.25 + 0.625 * ox + 0.5).astype(int)
    tile = y // 8 * 25 + x // 8
    value = ((tile * 7 + (y % 8 * 8 + x % 8) * 13) % 200 / 100 - 1).astype(np.float32)
    value[(tile % 10 == 0) | (tile >= n)] = np.nan
    want = [webp.encode(webp.rgba_of(v[..., None], None, (-1.0, 1.0))) for v in (value[:16384], value[16384:])]
    got = queries.QUERIES["webp_encode"](spark, str(tmp_path)).orderBy("request").collect()
    assert [tuple(r) for r in got] == [(i, len(w), b"WEBPVP8L".hex().upper()) for i, w in enumerate(want)]
    images = webp.to_webp(queries.webp_pieces(spark, str(tmp_path), webp.MOST_SIDE), None, (-1.0, 1.0)).orderBy("request").collect()
    assert [bytes(r["image"]) for r in images] == want
    np.testing.assert_array_equal(decode_vp8l(want[1])[..., 3] == 0, np.isnan(value[16384:]))


def test_rgba_of_matches_columns(spark):
    rng = np.random.default_rng(8)
    px = rng.uniform(-20, 280, (4, 5, 4)).astype(np.float32)
    px[0, 0, 1], px[1, 1, :] = np.nan, 7.0
    rows = [(i, *map(float, v)) for i, v in enumerate(px.reshape(-1, 4))]
    df = spark.createDataFrame(rows, "i int, x float, y float, z float, w float")
    for bands in (1, 3, 4):
        cols = rgba.to_rgba8(df, ["x", "y", "z", "w"][:bands], 7.0, (0.0, 255.0)).orderBy("i").select("r", "g", "b", "a").collect()
        np.testing.assert_array_equal(np.array(cols), webp.rgba_of(px[:, :, :bands], 7.0, (0.0, 255.0)).reshape(-1, 4))


def test_stats_of_nothing(spark):
    none = spark.createDataFrame([(float("nan"),), (5.0,)], "v double")
    assert tuple(stats.range_of(none, 5.0004).first()) == (0.0, 1.0)
    assert tuple(stats.min_max_lzw(none, 5.0004).first()) == (5.0, 5.0)
    assert stats.fast_tiles(1, 1) == [0] and stats.fast_tiles(4, 3) == [0, 3, 6, 8, 11]


def test_quality_hint_of_sparse_overviews(spark):
    t = spark.createDataFrame([(0, 0, [1.0]), (1, 0, [0.0, 2.0]), (2, 0, None)], "level int, tile_index long, pixels array<float>")
    q = levels.quality_hint(t)
    assert {r.level: r.usable for r in q.collect()}[1]
    assert levels.min_usable(q).first()[0] in (0, 1)


def test_range_merging():
    assert catalog.coalesce([(0, 10), (15, 20), (40000, 40010)], gap=32768) == [(0, 20), (40000, 40010)]
    assert catalog.coalesce([(0, 3 << 20), (3 << 20, 5 << 20)]) == [(0, 3 << 20), (3 << 20, 5 << 20)]


def test_catalog_lookup(spark):
    c = spark.createDataFrame([("a", 0, 1, "r/x/a.tif"), ("a", 1, 2, "r/x/b.tif"), ("b", 2, 3, "r/y/c.tif")], "name string, ordinal int, size long, location string")
    assert catalog.get(c, "a").first()["size"] == 2
    assert catalog.get(c, "zz").count() == 0
    assert catalog.root(c).first()[0] == "r/x"


def test_point_order_and_band_bounds(spark):
    level = Level(16, 16, 8, 8, 2)
    tiles = cog.array_tiles(spark, np.arange(512).reshape(2, 16, 16), 8)
    p = spark.createDataFrame([(0, 3.5, -2.5), (1, 99.0, 0.0), (2, 0.0, 0.0)], "ordinal int, x double, y double")
    place = GeoTransform(1.0, 1.0)
    got = sample.sample_points(p, tiles, level, place).orderBy("ordinal").collect()
    assert [dict(r["values"]) for r in got] == [{0: 2 * 16 + 3.0, 1: 256 + 2 * 16 + 3.0}, {}, {0: 0.0, 1: 256.0}]
    assert [r.value for r in sample.sample_band(p, tiles, level, place, 2).collect()] == [None] * 3


def test_windowed_stream(spark, tmp_path):
    from tessera.streaming import points as stream

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*10,0) AS ts, float(id) AS value FROM range(12)")
    rows.write.parquet(str(tmp_path / "in"))
    s = stream.windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    out = stream.drain(s, "windowed_rows", "complete").orderBy("start").collect()
    assert [(r.n, r.least, r.most) for r in out] == [(6, 0.0, 5.0), (6, 6.0, 11.0)]


def test_requests_as_a_table(spark):
    """As many requests as there are, planned in tasks: the same pixels as one by one, batches of any size."""
    rng = np.random.default_rng(8)
    level = Level(64, 48, 16, 16)
    tiles = cog.array_tiles(spark, rng.normal(size=(1, 48, 64)).astype(np.float32), 16)
    requests = [kernel.Request((x, -y - 9.5, x + 9.5, -y), 3857, 7, 7, m) for x, y, m in [(0, 0, "nearest"), (30.2, 11.1, "bilinear"), (3.3, 20.7, "cubic"), (500, 500, "nearest"), (40, 30, "bicubic")] * 5]
    want = {r.request: (r.tiles_read, r.pixels) for r in kernel.extract_tiles(spark, requests, tiles, level, together=1).collect()}
    table = kernel.request_frame(spark, requests).repartition(4)
    for together in (3, 100):
        got = {r.request: (r.tiles_read, r.pixels) for r in kernel.extract_tiles(spark, table, tiles, level, together=together).collect()}
        assert got.keys() == want.keys()
        for k, (n, pixels) in got.items():
            assert n == want[k][0]
            np.testing.assert_array_equal(pixels, want[k][1])
    p = reproject.Reprojection(3857, (0.0, -48.0, 64.0, 0.0), 50, 40, "bilinear", (0,))
    assert kernel.read_requests(reproject.chunk_table(spark, p, 16).orderBy("request").toArrow()) == list(enumerate(reproject.chunk_requests(p, 16)))


def test_ten_thousand_requests_leave_the_driver_alone(spark):
    level = Level(6400, 6400, 64, 64)
    p = reproject.Reprojection(3857, (0.0, -6400.0, 6400.0, 0.0), 6400, 6400)
    keys = kernel.tile_keys(reproject.chunk_table(spark, p, 64), level, 3857, 8)
    assert keys.select("tile_index").distinct().count() == 10_000


def test_headers_cut_off_are_no_rasters(spark, tmp_path):
    whole = tiff.Writer("deflate", 2, 64, 4326).bytes_of(np.ones((40, 50, 1), "u1"), 10.0, 50.0, 0.1, 0.1)
    (tmp_path / "good.tif").write_bytes(whole)
    for n in (0, 1, 4, 8, 9, 20):
        (tmp_path / f"cut{n}.tif").write_bytes(whole[:n])
        with pytest.raises(tiff.TiffError):
            tiff.parse(cog.reader_of(whole[:n]))
    assert [r["name"] for r in cog.discover(spark, str(tmp_path)).collect()] == ["good"]


def test_large_files_are_read_by_runs_of_tiles(spark, tmp_path):
    cog.register(spark)
    content = tiff.Writer("none", 1, 16, 4326).bytes_of(np.arange(100 * 90, dtype="u2").reshape(90, 100, 1), 10.0, 50.0, 0.1, 0.1)
    (tmp_path / "a.tif").write_bytes(content)
    read = lambda **o: spark.read.format("cog").option("what", "tiles").options(**o).load(str(tmp_path))
    one, many = read(), read(partitionBytes=2000)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 5
    rows = lambda df: sorted((r.level, r.tile_index, tuple(r.pixels)) for r in df.collect())
    assert rows(one) == rows(many)
    assert rows(many.where("level = 0 and tile_index in (3, 40)")) == [r for r in rows(one) if r[0] == 0 and r[1] in (3, 40)]


def test_nodata_of_four_bands_takes_all_of_them(spark):
    pixels = np.array([[[7, 7, 7, 7], [7, 7, 7, 200], [1, 7, 7, 7], [7, 7, np.nan, 7]]], np.float32)
    want = [[0, 0, 0, 0], [7, 7, 7, 200], [1, 7, 7, 7], [0, 0, 0, 0]]
    assert webp.rgba_of(pixels, 7.0, None)[0].tolist() == want
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pixels[0].tolist())], "i int, x double, y double, z double, w double")
    assert [list(r) for r in rgba.to_rgba8(df, list("xyzw"), 7.0).orderBy("i").select("r", "g", "b", "a").collect()] == want
    for bad in ((1.0, 1.0), (2.0, 1.0), (0.0, math.inf), (math.nan, 1.0)):
        with pytest.raises(ValueError, match="rescale"):
            webp.rgba_of(pixels, None, bad)
        with pytest.raises(ValueError, match="rescale"):
            rgba.to_rgba8(df, list("xyzw"), None, bad)


def test_bounded_range_merging_is_that_of_one_file(spark):
    rng = np.random.default_rng(3)
    ranges = sorted({int(x): int(n) for x, n in zip(rng.integers(0, 400_000, 200), rng.integers(1, 9000, 200), strict=True)}.items())
    df = spark.createDataFrame([(1, a, n) for a, n in ranges], "file int, offset long, length long")
    got = sorted((r.start, r.stop) for r in catalog.merge_ranges(df, 500, 20_000).collect())
    assert got == catalog.coalesce([(a, a + n) for a, n in ranges], 500, 20_000)

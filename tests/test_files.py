"""Raster files end to end, and results that are fixed bit for bit."""

import numpy as np
import pytest

from tessera.functions.geo import xyz_bbox
from tessera.operators import kernel
from tessera.sources import cog, raster, tiff

WORLD = xyz_bbox(3, 2, 3)


def rgb():
    y, x, b = np.mgrid[0:800, 0:1000, 0:3]
    return ((x * 3 + y * 5 + b * 40) % 251 + 1).astype("u1")


def dem():
    y, x, _ = np.mgrid[0:800, 0:1000, 0:1]
    return np.where((x // 100 + y // 100) % 5 == 0, -9999.0, x * 0.37 + y * 0.11 + 1).astype("f4")


def rgb_file():
    w = tiff.Writer("deflate", 2, 64, 3857, overviews=3, sparse=frozenset({(0, 5), (0, 6), (0, 40), (1, 3)}))
    size = (WORLD[2] - WORLD[0]) / 1000
    return w.bytes_of(rgb(), WORLD[0], WORLD[3], size, size)


def dem_file():
    return tiff.Writer("deflate", 1, 128, 4326, -9999.0, overviews=3, sparse=frozenset({(0, 10), (2, 1)})).bytes_of(dem(), -10.0, 50.0, 0.01, 0.01)


def digest(values):
    """FNV-1a over 32-bit floats, all NaNs alike."""
    bits = np.asarray(values, np.float32).ravel().view(np.uint32).copy()
    bits[np.isnan(np.asarray(values, np.float32).ravel())] = 0x7FC00000
    h = 0xCBF29CE484222325
    for b in bits.astype("<u4").tobytes():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


# Digests of 128 x 128 tiles by zoom, x, y and method, and the image they come from.
RGB = {
    (2, 1, 1, "nearest"): (2, "19f0574f3001aceb"),
    (2, 1, 1, "bilinear"): (2, "96a8803b33600fff"),
    (2, 1, 1, "bicubic"): (2, "a6667625e15cf0cd"),
    (2, 1, 1, "cubic"): (2, "63ed97e471af5bfd"),
    (4, 4, 6, "nearest"): (0, "e5d6169db0fac2e0"),
    (4, 4, 6, "bilinear"): (0, "ec8320d184c03438"),
    (4, 4, 6, "bicubic"): (0, "a19f6add4fd92119"),
    (4, 4, 6, "cubic"): (0, "bfec633c476688cc"),
    (5, 8, 12, "bilinear"): (0, "c260253cb6ae4ea2"),
    (6, 17, 25, "cubic"): (0, "1236a47ba40b12f0"),
    (7, 35, 51, "bilinear"): (0, "611f4a6b44690cfd"),
}
DEM = {
    (5, 15, 11, "nearest"): (2, "af4211093f6efac8"),
    (5, 15, 11, "bilinear"): (2, "288fa533f5d25fbf"),
    (5, 15, 11, "bicubic"): (2, "942b24097c696ba7"),
    (5, 15, 11, "cubic"): (2, "8ae07ac3f9d4657f"),
    (7, 62, 45, "nearest"): (0, "b9486ef23a425658"),
    (7, 62, 45, "bilinear"): (0, "130c8d76851ca947"),
    (7, 62, 45, "bicubic"): (0, "69840e645c8a9af8"),
    (7, 62, 45, "cubic"): (0, "93c32ab935319bdf"),
}


@pytest.mark.parametrize("make,epsg,fixed", [(rgb_file, 3857, RGB), (dem_file, 4326, DEM)])
def test_fixed_results(make, epsg, fixed):
    read = cog.reader_of(make())
    h = tiff.parse(read)
    tiles = {}
    for _, k, n, *_, px in cog.rows_of("tiles", "x", "x", "", read):
        tiles.setdefault(k, {})[n] = px
    for (z, x, y, method), (image, want) in fixed.items():
        q = kernel.xyz_request(z, x, y, 128, method=method)
        k = raster.level_for(h, q, 2, epsg)
        level = h.level(k)
        p = kernel.positions(q, level, epsg)
        box = kernel.footprint(p, level, method)
        out = kernel.render(p, level, kernel.window_of(tiles[k], box, level), box[:2], method, list(range(level.bands)))
        assert (k, digest(out)) == (image, want), (z, x, y, method)


def test_fixed_tiles():
    read = cog.reader_of(rgb_file())
    tiles = {(k, n): px for _, k, n, *_, px in cog.rows_of("tiles", "x", "x", "", read)}
    # Fixed values.
    assert digest(tiles[0, 0]) == "dc157d5edb3c00b4"
    assert digest(tiles[0, 207]) == "7b0810fe0c562347"
    assert digest(tiles[3, 3]) == "11304066f114b256"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "rgb.tif").write_bytes(rgb_file())
    (tmp_path / "dem.tif").write_bytes(dem_file())
    return tmp_path


def test_open_and_extract(spark, files):
    r = raster.Raster.open(spark, str(files / "rgb.tif"))
    assert r.crs == 3857 and r.overviews == 3 and r.min_usable() == 2
    rows = {x.request: x for x in r.extract([kernel.xyz_request(2, 1, 1, 128), kernel.xyz_request(4, 4, 6, 128), kernel.xyz_request(9, 0, 0, 16)]).collect()}
    assert [rows[i].overview for i in range(3)] == [1, None, None]
    assert digest(rows[0].pixels) == RGB[2, 1, 1, "nearest"][1] and digest(rows[1].pixels) == RGB[4, 4, 6, "nearest"][1]
    assert rows[0].tiles_read == 16 and rows[2].tiles_read == 0


def test_same_through_other_file_systems(spark, files):
    local = raster.Raster.open(spark, str(files / "dem.tif"))
    far = raster.Raster.open(spark, str(files / "dem.tif"), "all_usable")
    far.local = False  # tiles then come through binaryFile
    ranges = raster.HadoopRanges(spark, str(files / "dem.tif"))
    assert tiff.parse(ranges).level(0) == local.header.level(0)
    ranges.close()
    q = [kernel.xyz_request(6, 31, 22, 64, method="cubic")]
    assert local.extract(q).first().pixels == pytest.approx(far.extract(q).first().pixels, nan_ok=True)
    assert raster.Raster.open(spark, str(files / "dem.tif"), "none_usable").min_usable() is None
    assert raster.Raster.open(spark, str(files / "dem.tif"), 1).min_usable() == 1


def test_sample_and_range(spark, files):
    r = raster.Raster.open(spark, str(files / "dem.tif"))
    p = spark.createDataFrame([(0, -5.0, 46.0), (1, -9.99, 49.99), (2, 3.0, 46.0), (3, -6.5, 47.5)], "i int, x double, y double")
    got = {x.i: dict(x["values"]) for x in r.sample(p).collect()}
    assert got[0][0] == np.float32(500 * 0.37 + 400 * 0.11 + 1) and got[1][0] == -9999.0 and got[2] == {} and np.isnan(got[3][0])
    low, high = r.min_max(fast=True).first()
    # edge tiles are padded with zeros, which count
    assert (low, round(high, 2)) == (0.0, 455.16)
    assert raster.Raster.open(spark, str(files / "rgb.tif")).min_max(fast=True).first()[:] == (0.0, 251.0)


def test_changes_and_missing_files(spark, files):
    r = raster.Raster.open(spark, str(files / "dem.tif"))
    r.check()
    (files / "dem.tif").write_bytes(rgb_file())
    with pytest.raises(raster.SourceChanged):
        r.check()
    assert r.reopen().crs == 3857
    with pytest.raises(raster.SourceNotFound):
        raster.Raster.open(spark, str(files / "none.tif"))
    with pytest.raises(raster.SourceNotFound):
        raster.HadoopRanges(spark, str(files / "none.tif"))


def test_reproject_file(spark, files):
    r = raster.Raster.open(spark, str(files / "rgb.tif"))
    p = r.reprojection(4326, size=(100, 80), method="bilinear")
    assert [round(v, 6) for v in p.box] == [-90.0, 8.963216, -45.0, 40.979898]
    row = r.reproject(p).first()
    assert (row.width, row.height, row.bands) == (100, 80, 3) and np.isfinite(row.pixels).sum() == 23571

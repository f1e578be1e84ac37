"""Coordinate systems: longitude/latitude, spherical Mercator and UTM.

EPSG:4326 and EPSG:3857 are Column expressions; transverse Mercator zones go
through numpy in Arrow batches (Krueger's series to the sixth order, well below a
millimetre inside a zone).  Other codes are refused by name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
#: Latitude beyond which the spherical Mercator square ends.
MAX_LATITUDE = 85.06


def is_utm(epsg: int) -> bool:
    return 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760 or 26901 <= epsg <= 26923 or 25828 <= epsg <= 25838


def is_supported(epsg: int) -> bool:
    return epsg in (4326, 4269, 4258, 3857, 900913) or is_utm(epsg)


def proj_string(epsg: int) -> str | None:
    """A PROJ description of the code, None if it is not supported."""
    if epsg in (4326, 4269, 4258):
        return "+proj=longlat +datum=WGS84 +no_defs" if epsg == 4326 else "+proj=longlat +ellps=GRS80 +no_defs"
    if epsg in (3857, 900913):
        return "+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +nadgrids=@null +no_defs"
    if is_utm(epsg):
        zone, south = utm_zone(epsg)
        return f"+proj=utm +zone={zone}{' +south' if south else ''} +datum=WGS84 +units=m +no_defs"
    return None


def is_geographic(epsg: int) -> bool:
    p = proj_string(epsg)
    return p.startswith("+proj=longlat") if p else epsg == 4326 or 4000 <= epsg <= 4999


def utm_zone(epsg: int) -> tuple[int, bool]:
    """(zone, southern)."""
    for base, south in ((32600, False), (32700, True), (26900, False), (25800, False)):
        if 1 <= epsg - base <= 60:
            return epsg - base, south
    raise ValueError(f"EPSG:{epsg} is no UTM zone")


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH_RADIUS


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS


def longitude(x: Column) -> Column:
    return F.degrees(x / EARTH_RADIUS)


def latitude(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - math.pi / 2)


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and Krueger's coefficients, there and back."""
    n = FLATTENING / (2 - FLATTENING)
    radius = EARTH_RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    return radius, alpha, beta


_RADIUS, _ALPHA, _BETA = _series()
_ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
_SCALE, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0


def utm_forward(lon: np.ndarray, lat: np.ndarray, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    phi, lam = np.radians(lat), np.radians(lon - (6 * zone - 183))
    s = np.sin(phi)
    t = np.sinh(np.arctanh(s) - _ECC * np.arctanh(_ECC * s))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    e, n = eta.copy(), xi.copy()
    for j, a in enumerate(_ALPHA, 1):
        e += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        n += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return _EAST + _SCALE * _RADIUS * e, _SCALE * _RADIUS * n + (_SOUTH if south else 0)


def utm_inverse(x: np.ndarray, y: np.ndarray, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    xi, eta = (y - (_SOUTH if south else 0)) / (_SCALE * _RADIUS), (x - _EAST) / (_SCALE * _RADIUS)
    xp, ep = xi.copy(), eta.copy()
    for j, b in enumerate(_BETA, 1):
        xp -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        ep -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    tau = np.sin(xp) / np.sqrt(np.sinh(ep) ** 2 + np.cos(xp) ** 2)
    t = tau.copy()
    for _ in range(4):  # Newton's steps from conformal to geodetic latitude
        sig = np.sinh(_ECC * np.arctanh(_ECC * t / np.sqrt(1 + t * t)))
        f = t * np.sqrt(1 + sig * sig) - sig * np.sqrt(1 + t * t) - tau
        t = t - f / ((np.sqrt((1 + sig * sig) * (1 + t * t)) - sig * t) * (1 - _ECC**2) * np.sqrt(1 + t * t) / (1 + (1 - _ECC**2) * t * t))
    return np.degrees(np.arctan2(np.sinh(ep), np.cos(xp))) + 6 * zone - 183, np.degrees(np.arctan(t))


def to_lonlat(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.asarray(x, float), np.asarray(y, float)
    if is_utm(epsg):
        return utm_inverse(x, y, *utm_zone(epsg))
    if epsg in (3857, 900913):
        return np.degrees(x / EARTH_RADIUS), np.degrees(2 * np.arctan(np.exp(y / EARTH_RADIUS)) - math.pi / 2)
    if epsg in (4326, 4269, 4258):
        return x, y
    raise ValueError(f"unsupported CRS: EPSG:{epsg}")


def from_lonlat(lon: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if is_utm(epsg):
        return utm_forward(lon, lat, *utm_zone(epsg))
    if epsg in (3857, 900913):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.radians(lon) * EARTH_RADIUS, np.log(np.tan(math.pi / 4 + np.radians(lat) / 2)) * EARTH_RADIUS
    if epsg in (4326, 4269, 4258):
        return lon, lat
    raise ValueError(f"unsupported CRS: EPSG:{epsg}")


def project(x, y, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """numpy coordinates from one code to another; the identity if they are equal."""
    if source == target:
        return np.asarray(x, float), np.asarray(y, float)
    return from_lonlat(*to_lonlat(x, y, source), target)


def transform_xy(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Columns from one code to another: expressions where they exist, else an Arrow function."""
    for epsg in (source, target):
        if not is_supported(epsg):
            raise ValueError(f"unsupported CRS: EPSG:{epsg}")
    if source == target or (is_geographic(source) and is_geographic(target)):
        return x, y
    if is_geographic(source) and target in (3857, 900913):
        return mercator_x(x), mercator_y(y)
    if source in (3857, 900913) and is_geographic(target):
        return longitude(x), latitude(y)

    @F.pandas_udf("struct<x double, y double>")
    def both(px: pd.Series, py: pd.Series) -> pd.DataFrame:
        tx, ty = project(px.to_numpy(float), py.to_numpy(float), source, target)
        return pd.DataFrame({"x": tx, "y": ty})

    out = both(x.cast("double"), y.cast("double"))
    return out["x"], out["y"]


def bounds_points(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The corners and the middles of the edges of a box, as an array of structs."""
    midx, midy = (minx + maxx) / 2, (miny + maxy) / 2
    spots = [(minx, miny), (maxx, miny), (minx, maxy), (maxx, maxy), (midx, miny), (midx, maxy), (minx, midy), (maxx, midy)]
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in spots])


def transform_bounds(box: tuple[float, float, float, float], source: int, target: int) -> tuple[float, float, float, float]:
    """Bounds of the eight points' images, on the driver."""
    a, b, c, d = box
    mx, my = (a + c) / 2, (b + d) / 2
    x, y = project(np.array([a, c, a, c, mx, mx, a, c]), np.array([b, b, d, d, b, d, my, my]), source, target)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())


def bounds_to_wgs84(box: tuple[float, float, float, float], source: int) -> tuple[float, float, float, float]:
    """Two corners only, as catalogs do it."""
    x, y = project(np.array([box[0], box[2]]), np.array([box[1], box[3]]), source, 4326)
    return float(x[0]), float(y[0]), float(x[1]), float(y[1])

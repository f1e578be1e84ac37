"""Grid, affine and slippy-map arithmetic as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the spherical Mercator grid (EPSG:3857).
MERCATOR_EXTENT = 40075016.68557849
MERCATOR_EDGE = 20037508.342789244


def number(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def xyz_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """minx, miny, maxx and maxy in EPSG:3857 of a slippy-map tile."""
    size = F.lit(MERCATOR_EXTENT) / F.pow(F.lit(2.0), z.cast("double"))
    minx, maxy = size * x - MERCATOR_EDGE, F.lit(MERCATOR_EDGE) - size * y
    return {"minx": minx, "miny": maxy - size, "maxx": minx + size, "maxy": maxy}


def xyz_bbox(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """The same on the driver."""
    size = MERCATOR_EXTENT / 2**z
    minx, maxy = -MERCATOR_EDGE + x * size, MERCATOR_EDGE - y * size
    return minx, maxy - size, minx + size, maxy


@dataclass(frozen=True)
class GeoTransform:
    """Pixel scale, tiepoint (pixel x, y, world x, y) and whether samples are points.

    world_to_pixel and pixel_to_world both move by half a pixel for point rasters
    and so are no inverses; extraction uses `origin`, which is right for both.
    """

    scale_x: float
    scale_y: float
    tie_px: float = 0.0
    tie_py: float = 0.0
    tie_x: float = 0.0
    tie_y: float = 0.0
    is_point: bool = False

    @property
    def half(self) -> float:
        return 0.5 if self.is_point else 0.0

    @property
    def origin(self) -> tuple[float, float]:
        """World position of the outer corner of pixel (0, 0)."""
        return self.tie_x - (self.tie_px + self.half) * self.scale_x, self.tie_y + (self.tie_py + self.half) * self.scale_y

    def world_to_pixel(self, wx: Column, wy: Column) -> tuple[Column, Column]:
        return F.lit(self.tie_px) + (wx - self.tie_x) / self.scale_x + self.half, F.lit(self.tie_py) + (F.lit(self.tie_y) - wy) / self.scale_y + self.half

    def pixel_to_world(self, px: Column, py: Column) -> tuple[Column, Column]:
        return F.lit(self.tie_x) + (px - self.tie_px + self.half) * self.scale_x, F.lit(self.tie_y) - (py - self.tie_py + self.half) * self.scale_y

    def extent(self, width: int, height: int) -> tuple[float, float, float, float]:
        """Bounds without regard to registration or the tie pixel, as catalogs have them."""
        return self.tie_x, self.tie_y - height * self.scale_y, self.tie_x + width * self.scale_x, self.tie_y


@dataclass(frozen=True)
class Level:
    """One resolution of a raster: its pixels, its tiles and where they lie."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    bands: int = 1
    nodata: float | None = None
    origin_x: float = 0.0
    origin_y: float = 0.0
    scale_x: float = 1.0
    scale_y: float = 1.0

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)

    def source_x(self, wx: Column) -> Column:
        """Pixel-centre based column of a world x."""
        return (wx - self.origin_x) / self.scale_x - 0.5

    def source_y(self, wy: Column) -> Column:
        return (F.lit(self.origin_y) - wy) / self.scale_y - 0.5


def tile_index(px: Column, py: Column, level: Level) -> Column:
    return (F.floor(py / level.tile_height) * level.across + F.floor(px / level.tile_width)).cast("long")


def pixel_in_tile(px: Column, py: Column, level: Level) -> Column:
    """Place of a pixel's first band in its tile's array, from 0."""
    return ((py % level.tile_height) * level.tile_width + px % level.tile_width) * level.bands


def tile_pixel_range(index: Column, level: Level) -> dict[str, Column]:
    """The pixels [x0, x1) by [y0, y1) that a tile has inside the raster."""
    col, row = index % level.across, F.floor(index / level.across)
    return {
        "x0": (col * level.tile_width).cast("long"),
        "y0": (row * level.tile_height).cast("long"),
        "x1": F.least((col + 1) * level.tile_width, F.lit(level.width)).cast("long"),
        "y1": F.least((row + 1) * level.tile_height, F.lit(level.height)).cast("long"),
    }


def round_away(v: Column) -> Column:
    """Rounded, halves away from zero."""
    return (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("long")


def within(v: Column, size: int) -> Column:
    return (v >= -0.5) & (v <= size - 0.5)


def clamp(v: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def is_valid(v: Column, nodata: float | None) -> Column:
    """A sample that is neither missing, NaN nor nodata (compared as 32-bit floats)."""
    ok = v.isNotNull() & ~F.isnan(v)
    return ok if nodata is None else ok & (v.cast("float") != F.lit(float(nodata)).cast("float"))


def tent(x: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(x))


def mitchell(x: Column) -> Column:
    """Mitchell-Netravali with B = C = 1/3."""
    a = F.abs(x)
    return F.when(a < 1, 7 / 6 * a * a * a - 2 * a * a + 16 / 18).when(a < 2, -7 / 18 * a * a * a + 2 * a * a - 10 / 3 * a + 16 / 9).otherwise(0.0)


def catmull_rom(x: Column) -> Column:
    a = F.abs(x)
    return F.when(a <= 1, a * a * (1.5 * a - 2.5) + 1).when(a <= 2, a * (a * (-0.5 * a + 2.5) - 4) + 2).otherwise(0.0)


KERNELS = {"bilinear": (tent, 1), "bicubic": (mitchell, 2), "cubic": (catmull_rom, 2)}


def axis_scale(ratio: float) -> float:
    """The kernel's scale for source pixels per output pixel on an axis: 1 unless it shrinks, snapped to whole ratios."""
    if not ratio > 1 or ratio == float("inf"):
        return 1.0
    whole = float(int(ratio + 0.5))
    return 1 / whole if abs(ratio - whole) <= 0.05 else 1 / ratio

"""Samples as 8-bit RGBA."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte(v: Column, rescale: tuple[float, float] | None) -> Column:
    """A sample as 0 .. 255: rescaled if asked for, rounded away from zero, clamped."""
    x = v.cast("double")
    if rescale:
        x = (x - rescale[0]) / (rescale[1] - rescale[0]) * 255.0
    return F.greatest(F.least(F.floor(x + 0.5), F.lit(255)), F.lit(0)).cast("int")


def checked_range(rescale: tuple[float, float] | None) -> None:
    """Raises ValueError unless the range is finite and ascending."""
    if rescale is not None and not (math.isfinite(rescale[0]) and math.isfinite(rescale[1]) and rescale[1] > rescale[0]):
        raise ValueError(f"Invalid rescale range {rescale}: finite bounds are needed, the first below the second")


def to_rgba8(pixels: DataFrame, bands: list[str], nodata: float | None = None, rescale: tuple[float, float] | None = None) -> DataFrame:
    """pixels with r, g, b and a, from 1 (grey), 3 or 4 band columns.

    Any NaN band or all bands nodata, the alpha among them, give 0, 0, 0, 0; a fourth
    band is alpha and is not rescaled.
    """
    checked_range(rescale)
    if len(bands) not in (1, 3, 4):
        raise ValueError(f"RGBA needs 1, 3 or 4 bands, not {len(bands)}")
    v = [F.col(b) for b in bands]
    gap = F.lit(False)
    for x in v:
        gap = gap | x.isNull() | F.isnan(x)
    if nodata is not None:
        all_nodata = F.lit(True)
        for x in v:
            all_nodata = all_nodata & (x.cast("float") == F.lit(float(nodata)).cast("float"))
        gap = gap | all_nodata
    colours = v[:3] if len(v) > 1 else v * 3
    alpha = byte(v[3], None) if len(v) == 4 else F.lit(255)
    names = dict(zip("rgba", [*[byte(x, rescale) for x in colours], alpha], strict=True))
    return pixels.withColumns({n: F.when(gap, 0).otherwise(x) for n, x in names.items()})

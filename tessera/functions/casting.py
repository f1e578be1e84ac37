"""Checked and clamped number casts as Column expressions; null stands for "does not fit"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(v: Column, low: int, high: int) -> Column:
    return F.when((v >= low) & (v <= high), v)


def u64_to_usize(v: Column) -> Column:
    return F.when(v >= 0, v.cast("long"))


def u32_to_u16(v: Column) -> Column:
    return checked(v, 0, 0xFFFF).cast("int")


def usize_to_u32(v: Column) -> Column:
    return checked(v, 0, 0xFFFFFFFF).cast("long")


def u32_to_i32(v: Column) -> Column:
    return checked(v, 0, 0x7FFFFFFF).cast("int")


def f64_to_pixel_index(v: Column, size: int) -> Column:
    """The pixel a coordinate lies in; null for NaN, negative and past the end."""
    return F.when(~F.isnan(v) & (v >= 0) & (v < size), F.floor(v)).cast("long")


def f64_to_clamped_pixel(v: Column, size: int) -> Column:
    """The nearest pixel of the range; 0 for NaN and negative."""
    return F.when(F.isnan(v) | (v < 0), 0).otherwise(F.least(F.floor(v), F.lit(size - 1))).cast("long")


def isize_to_usize(v: Column) -> Column:
    return F.when(v >= 0, v)


def isize_to_clamped_usize(v: Column, size: int) -> Column:
    return F.greatest(F.least(v, F.lit(size - 1)), F.lit(0)).cast("long")

"""Pixel arrays: missing values, scaling, mirroring and per-chip summaries (row-major arrays)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """True for a present, finite number."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)


def finite_or_null(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(finite(x), x)


def zero_fill(arr: Column) -> Column:
    """Missing and non-finite entries become 0."""
    return F.transform(arr, lambda x: F.when(finite(x), x).otherwise(F.lit(0.0)))


def nodata_to_null(arr: Column, nodata: Column) -> Column:
    """Entries equal to the layer's nodata value, or non-finite, become NULL."""
    return F.transform(arr, lambda x: F.when(finite(x) & ~x.eqNullSafe(nodata), x))


def encode_nodata(arr: Column, nodata: float = -9999.0) -> Column:
    """Missing entries become the stored nodata number."""
    return F.transform(arr, lambda x: F.when(finite(x), x).otherwise(F.lit(nodata)))


def scale_255(arr: Column, clip: bool = True) -> Column:
    """8-bit values to [0, 1]; `clip` bounds out-of-range input."""
    def one(x: Column) -> Column:
        y = x / 255.0
        return F.when(x.isNotNull(), F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))) if clip else y

    return F.transform(arr, one)


def zscore(arr: Column, mean: Column, std: Column) -> Column:
    """(v - mean) / std, missing stays missing."""
    return F.transform(arr, lambda x: (x - mean) / std)


def clamp_unit(x: Column) -> Column:
    """Bound to [0, 1]; missing and non-finite stay NULL."""
    return F.when(finite(x), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def plane_flip(arr: Column, h: int, w: int, horizontal: Column, vertical: Column) -> Column:
    """Mirror every h*w plane of a row-major array left-right and / or top-bottom."""
    plane = h * w

    def source(i: Column) -> Column:
        band, rest = F.floor(i / plane).cast("int"), i % plane
        y, x = F.floor(rest / w).cast("int"), rest % w
        y2 = F.when(vertical, F.lit(h - 1) - y).otherwise(y)
        x2 = F.when(horizontal, F.lit(w - 1) - x).otherwise(x)
        return F.get(arr, band * plane + y2 * w + x2)

    return F.transform(F.sequence(F.lit(0), F.size(arr) - 1), source)


def aspect_components(aspect: Column) -> tuple[Column, Column]:
    """(northness, eastness) of an aspect in degrees; outside 0..360 both are NULL."""
    ok = finite(aspect) & aspect.between(0.0, 360.0)
    rad = F.radians(aspect)
    return F.when(ok, F.cos(rad)), F.when(ok, F.sin(rad))

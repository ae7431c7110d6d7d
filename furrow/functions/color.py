"""Colour conversions of 8-bit pixels, as column expressions and on arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Gray weights, sRGB curve, D65 XYZ rows for Y and Z, Lab curve.
GRAY = (0.299, 0.587, 0.114)
LUMA = (0.2125, 0.7154, 0.0721)
SRGB_CUT, SRGB_SLOPE, SRGB_OFFSET, SRGB_SCALE, SRGB_POWER = 0.04045, 12.92, 0.055, 1.055, 2.4
XYZ_Y = (0.212671, 0.715160, 0.072169)
XYZ_Z = (0.019334, 0.119193, 0.950227)
WHITE_Z = 1.088754
LAB_CUT, LAB_SLOPE, LAB_OFFSET = 0.008856, 7.787, 16.0 / 116.0


def gray(r: Column, g: Column, b: Column) -> Column:
    """Gray level 0..255, half up."""
    return F.floor(GRAY[0] * r + GRAY[1] * g + GRAY[2] * b + 0.5).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Floating luminance in 0..1."""
    return (LUMA[0] * r + LUMA[1] * g + LUMA[2] * b) / 255.0


def _linear(c: Column) -> Column:
    u = c / 255.0
    return F.when(u <= SRGB_CUT, u / SRGB_SLOPE).otherwise(
        F.pow((u + SRGB_OFFSET) / SRGB_SCALE, F.lit(SRGB_POWER))
    )


def _lab_curve(t: Column) -> Column:
    return F.when(t > LAB_CUT, F.cbrt(t)).otherwise(LAB_SLOPE * t + LAB_OFFSET)


def lab_b(r: Column, g: Column, b: Column) -> Column:
    """CIE Lab b channel with offset 128, rounded half up and kept in 0..255."""
    lr, lg, lb = _linear(r), _linear(g), _linear(b)
    y = XYZ_Y[0] * lr + XYZ_Y[1] * lg + XYZ_Y[2] * lb
    z = (XYZ_Z[0] * lr + XYZ_Z[1] * lg + XYZ_Z[2] * lb) / WHITE_Z
    value = F.floor(200.0 * (_lab_curve(y) - _lab_curve(z)) + 128.0 + 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(255), value)).cast("int")


_levels = np.arange(256) / 255.0
_LINEAR = np.where(
    _levels <= SRGB_CUT,
    _levels / SRGB_SLOPE,
    ((_levels + SRGB_OFFSET) / SRGB_SCALE) ** SRGB_POWER,
)


def gray_array(bgr: np.ndarray) -> np.ndarray:
    """Gray levels of ``(..., 3)`` BGR bytes."""
    b, g, r = (bgr[..., i].astype(np.float64) for i in range(3))
    return np.floor(GRAY[0] * r + GRAY[1] * g + GRAY[2] * b + 0.5).astype(np.int64)


def lab_b_array(bgr: np.ndarray) -> np.ndarray:
    """Lab b levels of ``(..., 3)`` BGR bytes."""
    lb, lg, lr = (_LINEAR[bgr[..., i]] for i in range(3))

    def curve(t: np.ndarray) -> np.ndarray:
        return np.where(t > LAB_CUT, np.cbrt(t), LAB_SLOPE * t + LAB_OFFSET)

    y = XYZ_Y[0] * lr + XYZ_Y[1] * lg + XYZ_Y[2] * lb
    z = (XYZ_Z[0] * lr + XYZ_Z[1] * lg + XYZ_Z[2] * lb) / WHITE_Z
    return np.clip(np.floor(200.0 * (curve(y) - curve(z)) + 128.0 + 0.5), 0, 255).astype(np.int64)

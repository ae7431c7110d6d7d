"""Flower segmentation of the Lab b channel, given each image's shift.

Written with plain arithmetic so that the same rule serves columns and arrays.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def in_flower_range(b: Column, shift: Column, lower: int, upper: int) -> Column:
    return b.between(F.lit(lower) + shift, F.lit(upper) + shift)


def _logistic_rate(out_value: float, distance: int) -> float:
    return math.log(1.0 / out_value - 1.0) / distance


def logistic(b: Column, shift: Column, lower: int, distance: int = 5, out_value: float = 0.99) -> Column:
    """``out_value`` at the lower threshold, one half at ``distance`` below it."""
    return 1.0 / (1.0 + F.exp(F.lit(_logistic_rate(out_value, distance)) * (b - (F.lit(lower - distance) + shift))))


def linear(b: Column, shift: Column, lower: int) -> Column:
    """Clipped ramp above the threshold, 0..1."""
    t = F.pmod(F.lit(lower) + shift, F.lit(256))
    capped = F.least(F.greatest(b, F.lit(0)), t + 10)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (capped - (t - 8)).cast("double") / (t + 10)))


def logistic_array(b: np.ndarray, shift: int, lower: int, distance: int = 5, out_value: float = 0.99) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(_logistic_rate(out_value, distance) * (b - (lower - distance + shift))))


def linear_array(b: np.ndarray, shift: int, lower: int) -> np.ndarray:
    t = (lower + shift) % 256
    return np.clip((np.clip(b, 0, t + 10) - (t - 8)) / (t + 10), 0.0, 1.0)

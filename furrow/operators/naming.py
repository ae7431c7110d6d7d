"""Images are named by numbers: their order is that of the numbers, not of the names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_number(path: Column) -> Column:
    """Number that an image's file stem is; null when the stem is no number."""
    return F.regexp_extract(path, r"(?:^|/)(\d+)\.[^./]+$", 1).try_cast("bigint")


def image_number(image: str) -> Column:
    """Number that an image's name is; null when it is none."""
    return F.col(image).cast("string").try_cast("bigint")


def image_keys(image: str) -> list[Column]:
    """Sort keys of images: by number, those without one last, by name."""
    return [image_number(image).asc_nulls_last(), F.col(image).asc()]


def image_order(image: str) -> Column:
    """The same order as one value, for smallest-of aggregations."""
    number = image_number(image)
    return F.struct(number.isNull(), number, F.col(image))

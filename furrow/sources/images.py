"""Image scans through Spark's file sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import file_number


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def parent_folder(path: Column) -> Column:
    """Folder that holds the file: one per capture day."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def scan_images(
    spark: SparkSession, paths: str | Sequence[str], glob: str = "*.jpg", recursive: bool = True
) -> DataFrame:
    """Decoded images as ``(path, image_id, batch, number, image)``.

    A file that cannot be decoded keeps its row, with a height of -1.
    """
    reader = spark.read.format("image").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    images = reader.load(paths if isinstance(paths, str) else list(paths))
    path = F.col("image.origin")
    return images.select(
        path.alias("path"),
        file_name(path).alias("image_id"),
        parent_folder(path).alias("batch"),
        file_number(path).alias("number"),
        "image",
    )


def scan_raw(spark: SparkSession, paths: str | Sequence[str], glob: str = "*", recursive: bool = True) -> DataFrame:
    """Undecoded files as ``(path, modificationTime, length, content)``."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return reader.load(paths if isinstance(paths, str) else list(paths))


def list_files(spark: SparkSession, path: str, glob: str = "*.jpg", recursive: bool = False) -> DataFrame:
    """Names and folders of the matching files; contents are not read."""
    found = scan_raw(spark, path, glob, recursive).select("path", "length")
    return found.select(
        "path", file_name(F.col("path")).alias("image_id"), parent_folder(F.col("path")).alias("batch"), "length"
    )


def file_versions(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.jpg", recursive: bool = True) -> DataFrame:
    """One row a file: the ``path`` as image scans tell it, the ``source`` to read it by, its length and last change."""
    # Image scans write paths without a host as scheme:///path, the metadata write scheme:/path.
    told = F.regexp_replace("_metadata.file_path", "^([A-Za-z][A-Za-z0-9+.-]*):/(?!/)", "$1:///")
    return scan_raw(spark, paths, glob, recursive).select(
        told.alias("path"), F.col("path").alias("source"), "length", F.col("modificationTime").alias("modified")
    )


def exactly(source: str) -> str:
    """The path as a pattern that matches it alone."""
    return re.sub(r"([\[\]{}*?\\,])", r"\\\1", source)


def file_set(spark: SparkSession, path: str, glob: str = "*.jpg", recursive: bool = True) -> str:
    """Number, total length and latest change of the matching files, as text; contents are not read."""
    facts = scan_raw(spark, path, glob, recursive).agg(
        F.count("*").alias("n"), F.sum("length").alias("bytes"), F.max("modificationTime").cast("string").alias("latest")
    )
    return "|".join(str(v) for v in facts.first())


def list_folders(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Folders below ``root`` that hold files, each once."""
    return list_files(spark, root, glob, recursive=True).select("batch").distinct()


def good_images(images: DataFrame) -> DataFrame:
    return images.filter(F.col("image.height") > 0)


def rejected_images(images: DataFrame) -> DataFrame:
    """Files that could not be decoded."""
    return images.filter(F.col("image.height") <= 0).select("path", "image_id", "batch")


def require_all_good(images: DataFrame) -> DataFrame:
    """The scan, whose reading fails at a file that could not be decoded; files are decoded once."""
    failed = F.raise_error(F.concat(F.lit("cannot decode "), "path"))
    return images.withColumn("image", F.when(F.col("image.height") > 0, F.col("image")).otherwise(failed))


def pixel_rows(images: DataFrame) -> DataFrame:
    """Pixels of 3-channel images as ``(image_id, y, x, b, g, r)``.

    The clear form for small frames; jobs on full frames work on whole images.
    """
    size = F.col("image.height") * F.col("image.width")
    numbered = good_images(images).select(
        "image_id", F.col("image.width").alias("w"), F.col("image.data").alias("data"),
        F.explode(F.sequence(F.lit(0), size - 1)).alias("i"),
    )

    def byte(channel: int) -> Column:
        return F.conv(F.hex(F.substring("data", F.col("i") * 3 + channel + 1, F.lit(1))), 16, 10).cast("int")

    return numbered.select(
        "image_id",
        F.floor(F.col("i") / F.col("w")).cast("int").alias("y"),
        (F.col("i") % F.col("w")).cast("int").alias("x"),
        byte(0).alias("b"),
        byte(1).alias("g"),
        byte(2).alias("r"),
    )

"""Tables of results per source file that grow with their folder.

A table is a set of generations in a folder named after its parameters. A generation holds the rows computed from some
files, the list of these files (path, length, last change), and, written last, a one-row table that publishes it: until
that row's file is there, readers see nothing of the generation. When files come or change, only they are computed, as
new generations; rows of files that changed or went are left out by the lists. Nothing is ever overwritten, so a job that
is lost half-way leaves the published generations as they were, and the next one goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import parted
from ..lineage import cut, cut_measured
from .cache import _folder

# Files that one generation is computed from; their paths pass through the driver.
FILES = 100_000
# Generations from which on a table is written anew as one.
MANY = 64
KEY = ["path", "length", "modified"]
PUBLISHED = "generation string, replaces array<string>"
LISTED = "path string, length bigint, modified timestamp, generation string"


def _live(spark: SparkSession, base: str) -> list[str]:
    """Published generations that no later one replaces."""
    try:
        rows = spark.read.schema(PUBLISHED).parquet(f"{base}/*/published").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    gone = {name for row in rows for name in row["replaces"]}
    return sorted({row["generation"] for row in rows} - gone)


def _publish(rows: DataFrame, files: DataFrame, base: str, replaces: Sequence[str] = ()) -> None:
    """Write a generation; its last file makes it visible."""
    spark, name = rows.sparkSession, uuid4().hex
    rows.withColumn("generation", F.lit(name)).write.parquet(f"{base}/{name}/rows")
    files.select(*KEY, F.lit(name).alias("generation")).write.parquet(f"{base}/{name}/files")
    mark = spark.createDataFrame([(name, list(replaces))], PUBLISHED)
    mark.coalesce(1).write.parquet(f"{base}/{name}/published")


def _files(spark: SparkSession, base: str, live: Sequence[str]) -> DataFrame:
    if not live:
        return spark.createDataFrame([], LISTED)
    return spark.read.schema(LISTED).parquet(*[f"{base}/{name}/files" for name in live])


def _rows(spark: SparkSession, base: str, live: Sequence[str], listed: DataFrame) -> DataFrame:
    """Rows of the listed files, each file's from one generation."""
    rows = spark.read.parquet(*[f"{base}/{name}/rows" for name in live])
    held = _files(spark, base, live)
    valid = held.join(listed.select(*KEY), KEY, "left_semi").groupBy("path").agg(F.min("generation").alias("generation"))
    stale, seen = cut_measured(held.select("path", "generation").join(valid, ["path", "generation"], "left_anti"), n=F.count("*"))
    if seen["n"]:
        # Stale files are few beside the others: rows of all others stay where they are.
        asked, apart = parted(rows, "path", stale)
        rows = apart.unionByName(asked.join(stale, ["path", "generation"], "left_anti"))
    return rows.drop("generation")


def load_or_extend(
    spark: SparkSession, path: str, stamp: str, listed: DataFrame, compute: Callable[[list[str]], DataFrame]
) -> DataFrame:
    """Rows of all ``listed`` files (path, source, length, modified), computing those that are new or changed.

    ``compute`` gets the sources of at most ``FILES`` files and returns rows with their ``path``. ``listed`` holds each path
    once. A table of ``MANY`` generations is written anew as one; its old generations stay, unread, for jobs that still read
    them. Two jobs that add the same file at once leave it in two generations, of which one is read.
    """
    base = _folder(path, stamp)
    listed = cut(listed)
    live = _live(spark, base)
    known = _files(spark, base, live).select(*KEY).distinct()
    fresh, seen = cut_measured(listed.join(known, KEY, "left_anti"), n=F.count("*"))
    parts = -(-seen["n"] // FILES)
    for part in range(parts):
        files = fresh.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == part)
        sources = [row["source"] for row in files.select("source").collect()]
        if sources:
            _publish(compute(sources), files, base)
    if not live and not parts:
        _publish(compute([]), fresh, base)  # an empty folder: a table without rows
    live = _live(spark, base)
    if len(live) >= MANY:
        held = _files(spark, base, live).select(*KEY).distinct().join(listed.select(*KEY), KEY, "left_semi")
        _publish(_rows(spark, base, live, listed), held, base, live)
        live = _live(spark, base)
    return _rows(spark, base, live, listed)

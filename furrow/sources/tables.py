"""CSV scans and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counts import to_long


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and inferred types."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_matrix(spark: SparkSession, path: str, condition: str) -> DataFrame:
    """Sample-by-taxon CSV, labels in the first column, as long count rows."""
    wide = spark.read.csv(path, header=True)
    return to_long(wide).select(F.lit(condition).alias("condition"), "sample_id", "taxon", "n")


def from_local(spark: SparkSession, rows, schema) -> DataFrame:
    """Distributed table of local rows, kept in memory and on disk."""
    return spark.createDataFrame(rows, schema).persist()


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.repartition(1) if single_file else df).write.mode("overwrite").csv(path, header=True)


def write_text(df: DataFrame, path: str, line: Column, single_file: bool = False) -> None:
    """Replace ``path`` by text lines; one file only on request, as it means one writing task."""
    lines = df.select(line.cast("string").alias("value"))
    (lines.repartition(1) if single_file else lines).write.mode("overwrite").text(path)


def write_groups(groups: DataFrame, path: str, group: str = "group", name: str = "image_id") -> None:
    """One folder of name lists per group."""
    lines = groups.select(F.col(group), F.col(name).cast("string").alias("value"))
    lines.write.mode("overwrite").partitionBy(group).text(path)


def write_matrix(counts: DataFrame, path: str, taxa: Sequence[str], value: str = "n") -> None:
    """Wide CSV with one column per listed taxon."""
    wide = counts.groupBy("sample_id").pivot("taxon", list(taxa)).agg(F.sum(value))
    write_csv(wide, path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def save_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def load_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """Stored ``(image_id, ts)`` rows."""
    return spark.read.parquet(path).select("image_id", "ts")

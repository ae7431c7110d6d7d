"""Stored intermediates that are valid for one set of parameters.

A table is kept in a folder named after its parameters. The parameters are
written beside it once the data is complete, so a half-written table counts as
a miss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def _folder(path: str, stamp: str) -> str:
    """Folder of the table with these parameters."""
    return f"{path.rstrip('/')}/{hashlib.sha256(stamp.encode()).hexdigest()[:24]}"


def save(df: DataFrame, path: str, stamp: str) -> None:
    folder = _folder(path, stamp)
    df.write.mode("overwrite").parquet(f"{folder}/data")
    df.sparkSession.createDataFrame([(stamp,)], "stamp string").write.mode("overwrite").parquet(f"{folder}/stamp")


def load(spark: SparkSession, path: str, stamp: str) -> DataFrame | None:
    """The stored table if its parameters equal ``stamp``, else None."""
    folder = _folder(path, stamp)
    try:
        held = spark.read.parquet(f"{folder}/stamp").first()
        return spark.read.parquet(f"{folder}/data") if held and held["stamp"] == stamp else None
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_or_compute(
    spark: SparkSession, path: str, stamp: str, compute: Callable[[], DataFrame], store: bool = True
) -> DataFrame:
    held = load(spark, path, stamp)
    if held is not None:
        return held
    fresh = compute()
    if not store:
        return fresh
    save(fresh, path, stamp)
    return load(spark, path, stamp)

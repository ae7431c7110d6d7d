"""Cutting lineage through tables in the shared checkpoint folder.

Iterative jobs and row numbering read the same rows more than once and must
see the same values each time, also after an executor is lost. They write the
rows as a table in the folder named by ``spark.checkpoint.dir`` and go on from
there. Reading a table back also gives Spark its true size, so join strategies
follow the data.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_dir: str | None = None
_ending: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only where it is unset and all runs in one process, a temporary one."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        try:
            named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        except Exception:  # no SparkContext on a Connect session
            named = None
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="furrow-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/furrow-{spark.conf.get('spark.app.id')}"


_scopes: list[list[tuple[SparkSession, str]]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    The application's folder is deleted when its JVM ends, if not before.
    """
    spark = df.sparkSession
    path = f"{_app_dir(spark)}/{uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    _paths[held] = path
    for scope in _scopes:
        scope.append((spark, path))
    _delete_on_exit(spark)
    return held


@contextmanager
def scope(*, keep: list[DataFrame]) -> Iterator[None]:
    """Delete the tables cut inside the block when it ends, except those added to ``keep``.

    What the block returns must be cut and kept, or not read them.
    """
    cut_here: list[tuple[SparkSession, str]] = []
    _scopes.append(cut_here)
    try:
        yield
    finally:
        _scopes.remove(cut_here)
        kept = {_paths.get(table) for table in keep}
        for spark, path in cut_here:
            if path not in kept:
                _delete(spark, path)


def cut_measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Like :func:`cut`, with aggregates of the rows taken by the job that writes them."""
    seen = Observation()
    held = cut(df.observe(seen, *[value.alias(name) for name, value in metrics.items()]))
    return held, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete cut tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            _delete(table.sparkSession, path)


def forget(spark: SparkSession) -> None:
    """Delete this application's cut tables; results read from them end here."""
    _delete(spark, _app_dir(spark))


def _file(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, folder: str) -> None:
    files, path = _file(spark, folder)
    files.delete(path, True)


def _delete_on_exit(spark: SparkSession) -> None:
    folder = _app_dir(spark)
    if folder not in _ending:
        files, path = _file(spark, folder)
        files.deleteOnExit(path)
        _ending.add(folder)

import os

import pytest
from pyspark.sql import functions as F

from furrow import lineage
from furrow.params import FrameParams
from furrow.sources import cache, tables


def test_cache_hits_only_equal_parameters(spark, tmp_path):
    path, calls = str(tmp_path / "store"), []

    def compute():
        calls.append(1)
        return spark.range(5)

    one, two = FrameParams().stamp(), FrameParams(lower=150).stamp()
    assert cache.load(spark, path, one) is None
    assert cache.load_or_compute(spark, path, one, compute).count() == 5
    assert cache.load_or_compute(spark, path, one, compute).count() == 5 and len(calls) == 1
    assert cache.load(spark, path, two) is None
    assert cache.load_or_compute(spark, path, two, compute, store=False).count() == 5 and len(calls) == 2
    assert cache.load(spark, path, two) is None


def test_half_written_cache_is_a_miss(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.range(3).write.parquet(f"{cache._folder(path, 'p')}/data")
    assert cache.load(spark, path, "p") is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "image_id string, group int").repartition(3)
    tables.write_groups(df, str(tmp_path / "g"))
    held = spark.read.schema("value string, `group` int").text(str(tmp_path / "g"))
    assert sorted(tuple(r) for r in held.collect()) == [("a", 1), ("b", 2), ("c", 1)]
    for _ in range(2):  # the second run replaces the first
        tables.write_text(df, str(tmp_path / "t"), F.concat_ws(",", "image_id", "group"), single_file=True)
    files = [f for f in os.listdir(tmp_path / "t") if f.startswith("part-")]
    assert len(files) == 1 and spark.read.text(str(tmp_path / "t")).count() == 3
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c")).schema["group"].dataType.simpleString() == "int"
    tables.write_parquet(df, str(tmp_path / "p"))
    assert tables.load_timestamps(
        spark, _stamped(spark, str(tmp_path / "ts"))
    ).columns == ["image_id", "ts"]
    tables.register(df, "test_groups_view")
    assert spark.sql("SELECT count(*) FROM test_groups_view").first()[0] == 3


def _stamped(spark, path):
    tables.write_parquet(spark.sql("SELECT 1 AS image_id, timestamp_ntz'2016-07-05 00:00:00' AS ts, 2 AS other"), path)
    return path


def test_saved_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS furrow_test LOCATION '{tmp_path / 'db'}'")
    tables.save_table(spark.range(4), "furrow_test.numbers")
    assert spark.table("furrow_test.numbers").count() == 4
    spark.sql("DROP DATABASE furrow_test CASCADE")


def test_wide_csv_and_local_rows(spark, tmp_path):
    rows = tables.from_local(spark, [("s1", "x", 1.0), ("s1", "y", 2.0), ("s2", "x", 3.0)], "sample_id string, taxon string, n double")
    assert rows.is_cached
    tables.write_matrix(rows, str(tmp_path / "m"), ["x", "y"])
    back = tables.read_csv(spark, str(tmp_path / "m")).orderBy("sample_id").collect()
    assert [tuple(r) for r in back] == [("s1", 1.0, 2.0), ("s2", 3.0, None)]
    rows.unpersist()


def test_cut_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("a", F.array("id"))
    held = lineage.cut(df)
    assert held.schema.simpleString() == df.schema.simpleString() and held.count() == 10
    assert lineage.cut(df.limit(0)).isEmpty()
    path = held.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("///", "/")
    lineage.discard(df, held)
    assert not os.path.exists(path)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or lineage.shared_dir(spark) == named.rstrip("/")


class _Unnamed:
    """A session that names no checkpoint folder."""

    def __init__(self, master):
        self.conf = self.sparkContext = self
        self._values = {"spark.master": master}

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self._values.get(key, default)


def test_folder_must_be_named_on_a_cluster():
    with pytest.raises(RuntimeError):
        lineage.shared_dir(_Unnamed("yarn"))
    assert os.path.isdir(lineage.shared_dir(_Unnamed("local[2]")))

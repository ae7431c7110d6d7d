import pytest
from pyspark.sql import functions as F

from furrow.joins import attach, attach_measured, match, match_measured, parted


def _big(spark):
    # One key holds most rows, one key is null.
    key = F.when(F.col("id") < 60, "hot").when(F.col("id") < 80, "cold").otherwise(F.lit(None))
    return spark.range(100).select("id", key.alias("k"))


def _small(spark):
    return spark.createDataFrame([("hot", 1), ("cold", 2), (None, 3), ("unused", 4)], "k string, v int")


def _check(joined):
    got = {r["id"]: (r["k"], r["v"]) for r in joined.collect()}
    assert len(got) == 100 == joined.count()
    assert got[0] == ("hot", 1) and got[70] == ("cold", 2) and got[99] == (None, 3)


def test_attach_keeps_hot_and_null_keys(spark):
    _check(attach(_big(spark), _small(spark), ["k"], ["id"]))


@pytest.mark.parametrize("limit", ["10m", "1"])
def test_measured_joins_on_both_sides_of_the_limit(spark, limit):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        _check(attach_measured(_big(spark), _small(spark), ["k"], ["id"]))
        _check(match_measured(_big(spark), _small(spark), ["k"]))
        left = attach_measured(_big(spark), _small(spark).filter("k = 'hot'"), ["k"], ["id"], how="left")
        assert left.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_attach_without_keys_reads_one_row(spark):
    total = _big(spark).agg(F.count("*").alias("n"), F.max("id").alias("top"))
    rows = attach(_big(spark), total, [], ["id"]).select("n", "top").distinct().collect()
    assert [tuple(r) for r in rows] == [(100, 99)]


def test_match_semi_and_anti_with_nulls(spark):
    keys = spark.createDataFrame([(None,), ("cold",)], "k string")
    assert match(_big(spark), keys, ["k"], "left_semi").count() == 40
    assert match(_big(spark), keys, ["k"], "left_anti").count() == 60


def test_parted(spark):
    """Rows are dealt to two frames, none lost, and no row of a key goes to the second, also where the filter is full."""
    rows = spark.range(2000).selectExpr("cast(if(id % 7 = 0, null, id % 500) AS decimal(38,0)) AS k", "id AS v")
    keys = spark.range(0, 500, 5).selectExpr("cast(id AS decimal(38,0)) AS k")
    for bits, most in ((1 << 20, 400), (64, 2000)):
        asked, apart = parted(rows, "k", keys, bits)
        assert asked.columns == apart.columns == rows.columns
        assert sorted(r.v for r in asked.union(apart).collect()) == list(range(2000))
        assert apart.join(keys, "k").count() == 0 and asked.count() <= most
    assert parted(rows, "k", keys.where("false"))[0].count() == 0

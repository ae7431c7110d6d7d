import duckdb
import pytest

import __spark_entry__ as entry_module
from oracle_check import difference, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["image_id", "shift", "share"] and df.count() == 15


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query_equals_sql(spark, con, name):
    got = entry_module.queries()[name](spark, SF_DIR).toPandas()
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    assert isinstance(con, duckdb.DuckDBPyConnection)
    assert difference(got, con.sql(sql).df()) is None

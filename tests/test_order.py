import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.operators.order import centred_mean, nearest_known, number_rows, running_totals


def _rows(seed=3, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        batch = rnd.choice(["a", "a", "a", "b", None])
        value = round(rnd.uniform(0, 50), 2) if rnd.random() < 0.3 else None
        rows.append((batch, i, rnd.randrange(40), value))
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def numbered(spark):
    df = spark.createDataFrame(_rows(), "batch string, id int, t int, v double").repartition(5)
    return number_rows(df, ["batch"], [F.col("t").asc(), F.col("id").asc()])


def _expected():
    groups = {}
    for b, i, t, v in _rows():
        groups.setdefault(b, []).append((t, i, v))
    return {b: sorted(g, key=lambda r: r[:2]) for b, g in groups.items()}


def test_number_rows(numbered):
    got = {(r["batch"], r["id"]): r["rn"] for r in numbered.collect()}
    want = {(b, row[1]): k + 1 for b, g in _expected().items() for k, row in enumerate(g)}
    assert got == want


def test_number_rows_without_groups(spark):
    df = spark.range(50).withColumn("z", -F.col("id"))
    got = {r["id"]: r["rn"] for r in number_rows(df, (), [F.col("z").asc()]).collect()}
    assert got == {i: 50 - i for i in range(50)}


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_totals(spark, inclusive):
    df = spark.createDataFrame(_rows(), "batch string, id int, t int, v double").repartition(5)
    out = running_totals(
        df, ["batch"], [F.col("t").asc(), F.col("id").asc()], {"s": F.col("t"), "c": F.lit(1)}, inclusive
    )
    got = {(r["batch"], r["id"]): (r["s"], r["c"]) for r in out.collect()}
    for b, group in _expected().items():
        total = 0
        for k, (t, i, _) in enumerate(group):
            assert got[b, i] == ((total + t, k + 1) if inclusive else (total, k))
            total += t


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_nearest_known(numbered, block_rows):
    got = {
        (r["batch"], r["id"]): (r["_prev"], r["_next"])
        for r in nearest_known(numbered, ["batch"], F.col("v"), block_rows=block_rows).collect()
    }
    for b, group in _expected().items():
        for k, (_, i, _) in enumerate(group):
            before = [(j + 1, g[2]) for j, g in enumerate(group[: k + 1]) if g[2] is not None]
            after = [(j + k + 1, g[2]) for j, g in enumerate(group[k:]) if g[2] is not None]
            prev, nxt = got[b, i]
            assert (tuple(prev) if prev else None) == (before[-1] if before else None)
            assert (tuple(nxt) if nxt else None) == (after[0] if after else None)


@pytest.mark.parametrize("block_rows", [3, 10, 1000])
def test_centred_mean(numbered, block_rows):
    out = centred_mean(numbered, ["batch"], "t", "m", 6, 5, block_rows=block_rows).toPandas()
    got = {(None if pd.isna(r.batch) else r.batch, r.id): r.m for r in out.itertuples()}
    assert len(got) == 300 == len(out)
    for b, group in _expected().items():
        ts = [g[0] for g in group]
        for k, (_, i, _) in enumerate(group):
            window = ts[max(0, k - 6) : k + 6]
            assert got[b, i] == pytest.approx(sum(window) / len(window))

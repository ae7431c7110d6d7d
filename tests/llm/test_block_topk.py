import math

import pytest
from pyspark.sql import functions as F

from furrow.llm import block_topk as op
from oracle_check import difference, duck

ROWS = [
    *((i, [math.sin(i * k) for k in range(1, 6)]) for i in range(300)),
    (7, [math.sin(7 * k) for k in range(1, 6)]), (400, [0.5, 0.5]), (401, []), (402, None), (403, [1.0, None]), (404, [float("nan")]),
    (405, [float("inf"), 1.0]), (None, [1.0, 1.0]), *((500 + i, [1.0, -1.0, 1.0, -1.0, 1.0]) for i in range(40)), (800, [1.0, -1.0, 1.0, -1.0, 1.0]),
]


def plain(rows, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in sorted({(i, tuple(v)) for i, v in sound if i % 50 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in sound if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("block, group, chunk", [(4, 3, 2), (256, 128, 512)])
def test_equals_all_products(frame, monkeypatch, block, group, chunk):
    for name, value in (("GROUP_BLOCKS", group), ("CHUNK", chunk)):
        monkeypatch.setattr(op, name, value)
    monkeypatch.setattr(op.blocks, "__defaults__", (block,))
    vectors = frame([(*r, "x") for r in ROWS], "vec_id long, embedding array<double>, score string")
    got = op.top_k(vectors, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(ROWS, 5)


def test_few_and_none(frame):
    rows = [(50, [1.0]), (3, [2.0])]
    vectors = frame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, op.top_k(vectors, F.col("vec_id") % 50 == 0).collect())) == [(50, 1, 3, 512 * 256)]
    assert op.top_k(vectors.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0
    assert op.top_k(vectors.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_query_equals_sql(spark):
    from furrow.llm import queries

    path = "/root/testdata/sf0.001"
    assert difference(queries.op10_block_topk(spark, path).toPandas(), duck(path).sql(op.sql()).df()) is None

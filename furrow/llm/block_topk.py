"""Exact top-k by inner product, a block of documents at a time.

Vectors are sorted by id and cut into blocks of consecutive documents. A block holds its forward index (the vectors) and
the largest and smallest weight of every term (component). For a query, the sum over its terms of the larger of
``weight * largest`` and ``weight * smallest`` bounds every score in the block. Blocks are scored in descending order of
this bound until it falls below the k-th score found (or equals it and all ids of the block are larger), so no result
is lost.

Queries are dealt into chunks and blocks into groups, both of bounded size whatever the data; each pair of a chunk and
a group is one task's work, and the k best of each pair are merged by rank.

Defined cases: a vector that is null or holds a null or a non-finite component takes no part, nor does a row without an
id. Shorter vectors count as filled with zeros; an empty vector scores 0. Ties go to the smaller id. A query's own rows
are all those of its id; rows that repeat a query's id with other vectors make one query, of the smallest vector.
Repeated candidate rows are candidates each. Scores are 64-bit integers: components beyond 2**31 / 256 may overflow them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

BLOCK = 256
GROUP_BLOCKS = 128
CHUNK = 512
SCALE = 256
_EXACT = float(1 << 52)


def weights(vector: Column) -> Column:
    """floor(256 * x) of each component; null for vectors that take no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    found = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    found[np.arange(found.shape[1]) < sizes[:, None]] = flat
    return found


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows (block, ids, values): vectors (vec_id, w) in the order of their ids, ``size`` to a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                values = _matrix(part.column("w").take(pa.array(np.arange(part.num_rows))))
                yield pa.RecordBatch.from_pydict(
                    {"first": ids[:1], "ids": [ids.tobytes()], "values": [np.ascontiguousarray(values).tobytes()]}
                )

    ranged = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "w").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    return ranged.mapInArrow(pack, "first long, ids binary, values binary")


class _Group:
    """A group of blocks: forward indexes and the terms' bounds."""

    def __init__(self, frame: pd.DataFrame, width: int):
        self.ids = [np.frombuffer(x, np.int64) for x in frame["ids"]]
        raw = [np.frombuffer(v, np.int64).reshape(len(i), -1) for v, i in zip(frame["values"], self.ids)]
        self.width = max([width, *(v.shape[1] for v in raw)])
        self.values = [np.pad(v, ((0, 0), (0, self.width - v.shape[1]))) for v in raw]
        self.largest = np.stack([v.max(0) for v in self.values])
        self.smallest = np.stack([v.min(0) for v in self.values])
        self.first = np.array([i.min() for i in self.ids])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < _EXACT else a @ b.T


def best(ids: np.ndarray, queries: np.ndarray, group: _Group, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best scores of the group and their ids (filled with False in the third array where there are fewer)."""
    queries = np.pad(queries, ((0, 0), (0, group.width - queries.shape[1])))
    bound = _product(np.maximum(queries, 0), group.largest) - _product(np.maximum(-queries, 0), group.smallest)
    order = np.argsort(-bound, axis=1, kind="stable")
    lowest, none = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    scores, found = np.full((len(ids), k), lowest), np.full((len(ids), k), none)
    alive = np.arange(len(ids))
    for turn in range(order.shape[1]):
        block = order[alive, turn]
        limit, worst = bound[alive, block], scores[alive, -1]
        alive, block, limit, worst = (x[limit >= worst] for x in (alive, block, limit, worst))  # later blocks are no better
        if not len(alive):
            break
        needed = (limit > worst) | (group.first[block] <= found[alive, -1])
        for b in np.unique(block[needed]):
            rows = alive[needed & (block == b)]
            new = _product(queries[rows], group.values[b])
            candidates = np.broadcast_to(group.ids[b], new.shape)
            own = candidates == ids[rows, None]
            all_scores = np.hstack([scores[rows], np.where(own, lowest, new)])
            all_ids = np.hstack([found[rows], np.where(own, none, candidates)])
            top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k] if all_scores.min() > lowest else _ranked(all_scores, all_ids, k)
            scores[rows] = np.take_along_axis(all_scores, top, 1)
            found[rows] = np.take_along_axis(all_ids, top, 1)
    return scores, found, scores > lowest


def _ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best; the lowest number, which has no negative, stands for no score."""
    return np.lexsort((ids, -np.maximum(scores, np.iinfo(np.int64).min + 1)), axis=1)[:, :k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best other rows of every query row."""
    sound = cut(vectors.where(F.col(vec_id).isNotNull()).withColumn("_query", is_query).select(
        F.col(vec_id).cast("long").alias("vec_id"), weights(F.col(vector)).alias("w"), "_query"
    ).where("w is not null"))
    held = cut(blocks(sound))
    asked = sound.where("_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("w").alias("w"))
    groups, chunks = -(-held.count() // GROUP_BLOCKS), -(-asked.count() // CHUNK)
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    dealt = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(max(chunks, 1))).cast("int")).withColumn("group", parts(groups))
    spread = held.withColumn("group", F.pmod(F.xxhash64("first", "ids"), F.lit(max(groups, 1))).cast("int")).withColumn("chunk", parts(chunks))

    def search(queries: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(frame):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = queries["query_id"].to_numpy(np.int64)
        asked_values = _matrix(pa.array(queries["w"].tolist(), pa.list_(pa.int64())))
        scores, found, real = best(ids, asked_values, _Group(frame, asked_values.shape[1]), k)
        return pd.DataFrame({"query_id": np.repeat(ids, k)[real.ravel()], "vec_id": found[real], "score": scores[real]})

    near = dealt.groupBy("chunk", "group").cogroup(spread.groupBy("chunk", "group")).applyInPandas(
        search, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(k: int = 5, every: int = 50) -> str:
    """The registered query in DuckDB, by all products."""
    return f"""
WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM sound q JOIN sound c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % {every} = 0),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= {k}"""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from furrow.llm import line_crf as op


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 3, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    energy, change = rng.normal(size=first[-1]) * 2, np.exp(rng.normal(size=(2, 2)))
    bad, moved = op.marginals(energy, change, first)
    moves = np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        total, ones = 0.0, np.zeros(b - a)
        steps = np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(sum(energy[a + i] for i, s in enumerate(states) if s))
            for s, t in zip(states, states[1:]):
                weight *= change[s, t]
            total += weight
            ones += weight * np.array(states)
            for s, t in zip(states, states[1:]):
                steps[s, t] += weight
        assert np.allclose(bad[a:b], ones / total)
        moves += steps / total
    assert np.allclose(moved, moves)


def test_lines_and_features():
    texts = ["", "one\n", "\n\nab ab\ncd", "é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    x, lengths, first = op.features(data, offsets)
    assert np.diff(first).tolist() == [1, 2, 4, 1] and lengths.tolist() == [0, 4, 0, 1, 1, 6, 2, 2]
    assert x.shape == (8, 2 * op.WIDTH) and not np.isnan(x).any()
    assert not x[0, op.WIDTH :].any()  # a lone line has no neighbours
    shares = op.bad_share(np.arange(8.0), lengths, first)
    assert shares[0] == 0 and np.isclose(shares[1], 6 / 5)  # the empty line after the feed counts as one character


def test_learns_and_takes_odd_rows(frame, odd):
    good = [(i, f"The {w} of the garden is in the house.\nIt was a {w} day.") for i, w in enumerate(["red", "old", "big", "new"] * 10, 100)]
    bad = [(i, "BUY!!! $$$ NOW!!! $$$\n@@@ CLICK ### HERE!!! " + str(i)) for i in range(200, 240)]
    docs = frame([(*r, 0.5) for r in [*odd, *good, *bad]], "doc_id long, text string, score double")
    labels = frame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(300, None), (None, 1), (100, 1)], "doc_id long, quality int")
    field = op.train(docs, labels, fit_docs=30)
    scored = op.score(docs, field)
    assert scored.columns == ["doc_id", "text", "score"]
    rows = scored.collect()
    assert len(rows) == len(odd) + 80 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score > 0.5) == (r.doc_id < 200) for r in rows if r.doc_id and r.doc_id >= 100)
    assert op.train(docs, labels.where("quality = 1")) is None
    assert {r.score for r in op.score(docs, None).collect()} == {0.5}
    assert op.score(docs.where("false"), field).count() == 0


def test_held_out_accuracy(spark):
    from furrow.llm.queries import op3_line_crf

    path = "/root/testdata/sf0.01"
    scored = op3_line_crf(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.97
    assert scored[scored.quality == 1].score.mean() > scored[scored.quality == 0].score.mean() + 0.8


def test_memory_of_scores_follows_pieces():
    """4 MB of texts in one batch: a task holds the features of a piece's lines, not of all."""

    class Caught:
        schema = T.StructType().add("text", "string")

        def mapInArrow(self, run, _):
            return run

    width = 2 * op.WIDTH
    field = op.Field(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)))
    batch = pa.RecordBatch.from_arrays([pa.array([("some words of a line " * 3 + "\n") * 32] * 2000)], names=["text"])
    run = op.score(Caught(), field)
    list(run(iter([batch.slice(0, 1)])))  # tables of powers
    tracemalloc.start()
    try:
        assert sum(part.num_rows for part in run(iter([batch]))) == 2000
        assert tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()

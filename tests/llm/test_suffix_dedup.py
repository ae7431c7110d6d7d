import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from furrow.llm import suffix_dedup as op


def plain(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((str(i), len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out)


def rows_of(seed, length, many=150):
    """Passages of lengths around the limit at random places, runs of one letter, periods, and whole copies."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choices("abcdefgh é漢", k=n))
    passages = [noise(length + d) for d in (-3, -1, 0, 1, 2, 7, length, 3 * length)] + ["z" * (2 * length), "xyz" * length]
    rows = []
    for i in range(many):
        text = noise(rng.randint(0, 3 * length))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages) + noise(rng.randint(0, length))
        rows.append((i, text))
    return rows + [(1000 + i, rows[i * 7][1]) for i in range(8)] + [(1000, rows[0][1])]


@pytest.mark.parametrize("length, reach, hot, compared", [(200, 99, 20_000, 1 << 15), (40, 19, 3, 7), (40, 10, 20_000, 5)])
def test_equals_all_substrings(frame, odd, monkeypatch, length, reach, hot, compared):
    monkeypatch.setattr(op, "COMPARED", compared)
    monkeypatch.setattr(op, "GRAM", 4)
    rows = [*rows_of(length + reach, length), *odd]
    docs = frame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    out = op.dedup(docs, length, op.content(reach, 8), reach, hot=hot)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect())
    assert got == plain(rows, length)


def test_difference_cover_of_residues(frame):
    """The classic sample: residues whose differences are all residues; 7 with 1, 2 and 4."""
    rows = rows_of(11, 30, 60)
    out = op.dedup(frame(rows, "doc_id long, text string"), 30, op.residues(7, (1, 2, 4)), 6)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == plain(rows, 30)
    with pytest.raises(ValueError, match="cover"):
        op.residues(7, (1, 2))


def test_texts_keep_whole_characters(frame, odd):
    rows = [*rows_of(5, 40, 80), *odd]
    docs = frame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, source string, n_removed int")
    out = op.dedup_text(docs, 40, op.content(19, 8), 19)
    assert out.columns == ["doc_id", "source", "text", "n_removed"] and out.count() == len(rows)
    want = {}
    for i, n, gone, _, kept in plain(rows, 40):
        want.setdefault(i, set()).add(kept.decode(errors="ignore"))
    for r in out.collect():
        assert r.text in want[str(r.doc_id)] or "�" not in r.text and len(r.text) <= max(map(len, want[str(r.doc_id)]))
    assert op.dedup_text(docs.where("false")).count() == 0 and op.dedup(docs.where("false")).count() == 0


def test_sliding():
    values = np.random.default_rng(0).integers(0, 100, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 16, 50):
        got = op._sliding(values, width, np.minimum)
        assert got.tolist() == [min(values[i : i + width]) for i in range(50 - width + 1)]


def test_query(spark, documents):
    import hashlib

    from furrow.llm.queries import op8_suffix_dedup

    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    want = [(i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in plain(rows, 200)]
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


class Caught:
    """In place of a frame: gives back the function that its tasks would run."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, _):
        return run


def _peak(batches):
    """The most MB that NumPy holds while batches are made one by one, and the largest of them."""
    tracemalloc.start()
    try:
        largest = max(batch.nbytes for batch in batches) / 1e6
        return tracemalloc.get_traced_memory()[1] / 1e6, largest
    finally:
        tracemalloc.stop()


def test_memory_of_positions_follows_pieces():
    """80,000 positions in 4 MB of texts, and 20,480 of one name: a task holds the bytes and keys of a piece, not of all."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 100_000, dtype=np.uint8).tobytes().decode() for _ in range(40)]
    places = pa.array([np.arange(0, 100_000, 50)] * 40, pa.list_(pa.int64()))
    numbers = pa.array(range(40), pa.int64())
    batch = pa.RecordBatch.from_arrays([numbers, numbers, pa.array(texts), places], names=["_id", "_key", "text", "_places"])
    around = op._around(Caught(), "text", 99, 200)
    list(around(iter([batch.slice(0, 1)])))  # tables of powers
    peak, _ = _peak(around(iter([batch])))
    assert peak < 100

    many = 20_480
    one = lambda value: pa.array(np.full(many, value))
    some = [pa.array([rng.bytes(99) for _ in range(many)]) for _ in range(2)]
    columns = [one(7), *some, one(0), one(99), pa.array(range(many)), one(1), one(500), one(False)]
    rows = pa.RecordBatch.from_arrays(columns, names=["name", "before", "after", "low", "high", "id", "key", "at", "known"])
    for hot in (many, 20_000):  # compared, listed
        peak, largest = _peak(op._compared(Caught(), 99, hot)(iter([rows])))
        assert peak < 100 and largest < 20

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from furrow.llm import spot_signatures as op
from oracle_check import difference, duck

COMMON = set(op.ANTECEDENTS)


def marks(text):
    text = text or ""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    found = []
    for i, w in enumerate(words):
        if w in COMMON:
            rest = [x for x in words[i + 1 :] if x not in COMMON][: op.CHAIN]
            if len(rest) == op.CHAIN:
                found.append(" ".join([w, *rest]))
    found = found or ([" ".join(words)] if words else [text] if text else [])
    return sorted({hashlib.md5(f.encode()).hexdigest()[: op.DIGITS] for f in found})


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def test_signatures(frame, odd):
    for row in frame(odd, "doc_id long, text string").select("text", op.signatures(F.col("text")).alias("s")).collect():
        assert row.s == marks(row.text)


@pytest.mark.parametrize("ranges", [1, 4, 200])
def test_next_document(spark, frame, odd, ranges):
    docs = frame([(*r, 1) for r in odd], "doc_id long, text string, found int")
    rows = op.with_next(spark, docs, ranges).collect()
    order = sorted(((-1 if i is None else i, t or "") for i, t in odd))
    want = sorted((i, t, *order[(n + 1) % len(order)][1:]) for n, (i, t) in enumerate(order))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.next_text) for r in rows) == want
    assert all(r.next_found == marks(r.next_text) for r in rows)
    assert op.with_next(spark, docs.where("false"), ranges).count() == 0
    one = op.with_next(spark, docs.where("doc_id = 5"), ranges).collect()
    assert [(r.doc_id, r.next_text == r.text) for r in one] == [(5, True)]


def test_likeness(frame):
    rows = [(["a", "b"], ["b", "c"]), ([], []), ([], ["a"]), (["a"], ["a"])]
    got = frame(rows, "a array<string>, b array<string>").select("a", "b", op.likeness(F.col("a"), F.col("b")).alias("x"), op.likeness(F.col("a"), F.col("b"), 0.9).alias("y")).collect()
    assert all(abs(r.x - jaccard(r.a, r.b)) < 1e-12 for r in got)


def test_near_finds_all_pairs(spark, documents):
    docs = documents.select("doc_id", "text")
    members, links = op.near(docs, 0.6)
    rows = {r.doc_id: marks(r.text) for r in docs.collect()}
    classes = {}
    for i in sorted(rows):
        classes.setdefault(tuple(rows[i]), i)
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: classes[tuple(s)] for i, s in rows.items()}
    reps = [(i, s) for s, i in classes.items() if s]
    want = {(min(i, j), max(i, j)) for i, a in reps for j, b in reps if i != j and jaccard(a, b) >= 0.6}
    assert {(r.a, r.b) for r in links.collect()} == want and want


def test_native(spark, documents):
    plan = op.with_next(spark, documents, 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_equals_sql(spark):
    from furrow.llm import queries

    path = "/root/testdata/sf0.001"
    assert difference(queries.op1_spot_signatures(spark, path).toPandas(), duck(path).sql(op.sql()).df()) is None

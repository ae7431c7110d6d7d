import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import periodic_runs as op
from furrow.llm import queries


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain(words, least=6, power=4):
    """All maximal stretches of their smallest period, by comparing words."""
    found = set()
    n = len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i : i + length]
            smallest = not any(stretch[d:] == stretch[:-d] for d in range(1, q))
            if smallest and length >= max(least, power * q):
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_runs_of_short_alphabets(texts):
    code = np.array([c for t in texts for c in t], np.int64)
    begin = np.cumsum([0, *map(len, texts)])
    got = list(zip(*(a.tolist() for a in op.runs(code, begin))))
    assert got == [(s + b, n, q) for t, b in zip(texts, begin.tolist()) for s, n, q in plain(t)]


def test_long_periods():
    rng = random.Random(5)
    texts = []
    for q in (1, 2, 3, 7, 8, 9, 31, 64, 65, 200):
        block = [rng.randrange(50) for _ in range(q)]
        texts.append([rng.randrange(50) for _ in range(9)] + block * 4 + block[: q // 2] + [rng.randrange(50) for _ in range(5)])
    texts.append([1, 2, 1, 2, 1, 2, 1, 2, 3] * 4)  # a run within each period
    code, begin = np.array([c for t in texts for c in t], np.int64), np.cumsum([0, *map(len, texts)])
    got = list(zip(*(a.tolist() for a in op.runs(code, begin))))
    assert got == [(s + b, n, q) for t, b in zip(texts, begin.tolist()) for s, n, q in plain(t)]
    assert {65, 200} <= {q for _, _, q in got}


@pytest.fixture
def rows(odd):
    rng = random.Random(3)
    made = []
    for i in range(60, 140):
        words = []
        while len(words) < 80:
            words += rng.choices(["a", "b", "cé", "dd,"], k=rng.randint(1, 9)) * rng.choice([1, 1, 4, 5, 9])
        made.append((i, rng.choice([" ", "\n ", "\t"]).join(words)))
    return [*odd[:6], *odd[7:], *made]


def test_query_equals_plain(spark, frame, rows, tmp_path):
    frame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words = planted(words, i) if i is not None else words
        runs = plain(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *first, *(hashlib.sha256(t.encode()).hexdigest() for t in (told, " ".join(collapse(words, runs))))))
    assert got == sorted(want, key=str)


def test_odd_tables(frame, odd):
    docs = frame([(*r, 1, "x") for r in odd], "doc_id long, text string, runs int, key string")
    out = op.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "key", "runs", "collapsed"] and out.count() == len(odd)
    assert op.periodic_runs(docs.where("false")).count() == 0
    assert [r.collapsed for r in out.where("doc_id is null").collect()] == ["no id here"] * 2

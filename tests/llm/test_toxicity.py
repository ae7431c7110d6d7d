import random

import numpy as np
import pytest

from furrow.llm import queries
from furrow.llm import toxicity as op


@pytest.mark.parametrize("text, want", [
    ("You 1D10T, $tupid!", " you idiot stupid "), ("ѕtuріd", " stupid "), ("ｓｃｕｍ###", " scum "), ("in 1990, 250 men", " in 1990 250 men "),
    ("m0r0n$$$", " moron "), (None, " "), ("?!", " "), ("a_b", " a b "), ("1d10t5 l05er5", " idiots losers "),
])
def test_fold(text, want):
    assert op.fold(text) == want


def test_hits_equal_plain_search():
    """The longest entry at each word counts, none inside an exception."""
    rng = random.Random(4)
    names = ["ab", "abc", "abcd", "b", "bc", "xyz"]
    for _ in range(200):
        weights = {(f" {n} " if rng.random() < 0.5 else f" {n}"): rng.random() for n in rng.sample(names, 4)}
        exceptions = [f" {rng.choice(names)} {rng.choice(names)} "]
        words = rng.choices([*names, "abcde", "q"], k=12)
        text = op.fold(" ".join(words))
        spared = {i + k for i in range(len(words) - 1) if f" {words[i]} {words[i + 1]} " in exceptions for k in (0, 1)}
        want = []
        for i, w in enumerate(words):
            found = [e for e in weights if f" {w} ".startswith(e)]
            if found and i not in spared:
                want.append(weights[max(found, key=len)])
        got = op.hits(op.Lexicon(weights, exceptions, (0, 0, 0)).automaton(), text)
        assert [weight for _, (_, weight) in sorted(got.items())] == want


def made(count, rng):
    """Toxic documents use words of an invented stem; a phrase with one of them is clean."""
    for i in range(count):
        words = rng.choices([f"w{k}" for k in range(300)], k=rng.randint(20, 80))
        toxic = int(rng.random() < 0.3)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), "grum" + rng.choice(["ble", "pel", "o", "zz"]))
        if not toxic and rng.random() < 0.06:
            words += ["grumble", "bee"]
        yield i, " ".join(words), toxic


def test_learns_stems_and_exceptions(frame):
    rows = list(made(400, random.Random(8)))
    docs = frame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = frame([(i, x) for i, _, x in rows if i % 2] + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = op.train(docs, labels)
    assert any(e.startswith(" grum") for e in lexicon.weights) and " grumble bee " in lexicon.exceptions
    got = {r.doc_id: r.score for r in op.score(docs, lexicon).collect()}
    right = np.mean([(got[i] >= 0.5) == (x == 1) for i, _, x in rows if i % 2 == 0])
    assert right > 0.97


def test_odd_tables(frame, odd):
    docs = frame([(*r, "k", 7) for r in odd], "doc_id long, text string, toxic string, score int")
    lexicon = op.train(docs, frame([], "doc_id long, toxic int"))
    assert lexicon.curve == op.start().curve
    got = op.score(docs, lexicon)
    assert got.columns == ["doc_id", "text", "toxic", "score"] and got.count() == len(odd)
    assert all(0 <= r.score < 0.5 for r in got.collect())
    assert op.score(docs.where("false"), lexicon).count() == 0
    one = op.train(docs, frame([(4, 1), (4, 1)], "doc_id long, toxic int"))
    assert one.weights == op.start().weights


def test_query_on_held_out(spark):
    path = "/root/testdata/sf0.1"
    got = queries.op11_toxicity(spark, path)
    labels = spark.read.parquet(f"{path}/labels.parquet").where("toxic is not null")
    told = got.where("held_out").join(labels, "doc_id").groupBy("toxic").agg({"predicted": "avg"})
    share = dict(told.collect())
    assert share[1] > 0.85 and share[0] < 0.02

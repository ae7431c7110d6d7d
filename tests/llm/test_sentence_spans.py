import random
import re

import pytest

from furrow.llm import sentence_spans as op
from oracle_check import difference, duck

SPACE = r"[\x20\x09-\x0D]"


def sentences(t):
    parts = re.findall(rf"^{SPACE}+|[^\x20\x09-\x0D]+{SPACE}*", t or "")
    sents, now = [], ""
    for p in parts:
        now += p
        if now.strip() and (re.search(rf"[.!?]{SPACE}*$", p) or "\n" in p and p.strip()):
            sents.append(now)
            now = ""
    return (sents + [now], "") if now.strip() else (sents, now)


def plain(rows, span, least, keys):
    """By lists of sentences; ``keys`` orders the texts of one id, and of none."""
    docs = {(i if i is not None else float("inf"), keys[t or ""], t or ""): sentences(t) for i, t in rows}
    first, gone = {}, {}
    for k, (sents, _) in sorted(docs.items()):
        for at in range(len(sents) - span + 1):
            words = tuple(w for s in sents[at : at + span] for w in s.split())
            if len(words) >= least and first.setdefault(words, (k, at)) != (k, at):
                gone.setdefault(k, set()).update(range(at, at + span))
    return sorted(
        (str(i), len(docs[k][0]), len(gone.get(k, ())), "".join(s for n, s in enumerate(docs[k][0]) if n not in gone.get(k, ())) + docs[k][1])
        for i, t in rows for k in [(i if i is not None else float("inf"), keys[t or ""], t or "")]
    )


@pytest.mark.parametrize("span, least", [(2, 1), (3, 10), (1, 3)])
def test_equals_lists(frame, odd, span, least):
    rng = random.Random(span)
    pool = [" ".join(rng.choices("the red fox ran far away".split(), k=rng.randint(1, 6))) + rng.choice([". ", "! ", "\n", ".\n\n", "?  "]) for _ in range(12)]
    rows = [*odd, *((100 + i, rng.choice(["", " \n "]) + "".join(rng.choices(pool, k=rng.randint(0, 14)))) for i in range(120))]
    # Texts of one id and texts without one, and columns named like those that the operator might use.
    same = "".join(pool[:4])
    rows += [(7000, same + "x."), (7000, "y. " + same), (None, same), (None, same + " z."), (7001, same)]
    names = ["_id", "_key", "_places", "_host", "key", "place"]
    docs = frame([(*r, 5, *names) for r in rows], f"doc_id long, text string, n_removed int, {', '.join(f'{n} string' for n in names)}")
    keys = {r.text: r.key for r in docs.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS key").collect()}
    out = op.dedup(docs, span, least)
    got = sorted((str(r.doc_id), r.n_sentences, r.n_removed, r.text) for r in out.collect())
    want = plain(rows, span, least, keys)
    assert set(names) <= set(out.columns) and {tuple(r[n] for n in names) for r in out.collect()} == {tuple(names)}
    assert got == want
    assert op.dedup(docs.where("false")).count() == 0


def test_query_equals_sql(spark):
    from furrow.llm import queries

    path = "/root/testdata/sf0.001"
    assert difference(queries.op9_sentence_spans(spark, path).toPandas(), duck(path).sql(op.sql()).df()) is None

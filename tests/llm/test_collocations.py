import collections
import random
import re

import pytest

from furrow.llm import collocations as op
from furrow.llm import queries
from oracle_check import difference, duck


def plain(rows, least, longest, first):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for k in range(1, longest + 1):
                count[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, seen in count.items():
        good = {p: a for p, a in seen.items() if a >= least}
        inside = {q for p, a in good.items() for k in range(1, len(p)) for i in range(len(p) - k + 1) for q in [p[i : i + k]] if good[q] == a}
        rows = []
        for p, a in good.items():
            if len(p) > 1 and p not in inside:
                score, _, l, r = min((1000 * a * total[lang] // (good[p[:k]] * good[p[k:]]), k, good[p[:k]], good[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, n + 1, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(rows)[:first])]
    return sorted(out)


@pytest.mark.parametrize("bits, first", [(23, 2000), (7, 5)])
def test_equals_counters(spark, frame, odd, bits, first):
    rng = random.Random(bits)
    pool = "the a fox ran über THE é漢 \x01b far".split(" ") + ["x,", "end.", "line\n", "tab\tbed"]
    made = [(" ".join(rng.choices(pool, k=rng.randint(0, 40))), rng.choice(["en", None, "und", "de"])) for _ in range(150)]
    made += [("one passage that many texts share", "en")] * 30
    rows = [*((t, "en") for _, t in odd), *made]
    docs = frame([(*r, 1) for r in rows], "text string, lang string, n int")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    found = op.first_phrases(op.collocations(docs, least=6, bits=bits), first)
    got = sorted(map(tuple, found.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain(rows, 6, 5, first)


def test_ranges_begin_inside_a_common_word(spark, frame):
    """All phrases begin with one word, so ranges are cut inside it."""
    rows = [(f"go {a} {b}", "en") for a in "abcdefgh" for b in "stuvwxyz" for _ in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = sorted(map(tuple, op.first_phrases(op.collocations(frame(rows, "text string, lang string"), least=3)).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain(rows, 3, 5, 2000) and got


def test_odd_tables(frame):
    assert op.collocations(frame([], "doc_id long, text string, lang string")).count() == 0
    assert op.collocations(frame([(1, None, None), (2, "", "en")], "doc_id long, text string, lang string"), least=1).count() == 0


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    assert difference(queries.op13_collocations(spark, path).toPandas(), duck(path).sql(op.sql()).df()) is None

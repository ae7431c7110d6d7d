import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from furrow.llm import shingle_join as op
from furrow.llm.components import components
from oracle_check import difference, duck


def grams(text, n=5):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain(rows, like=Fraction(4, 5)):
    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [(i, s) for i, s in sets if s and i is not None]
    for a, (i, s) in enumerate(live):
        for j, t in live[:a]:
            if len(s & t) * like.denominator >= len(s | t) * like.numerator:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(((str(i), len(s), None if i is None else root(i)) for i, s in sets), key=str)


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        kind, at = rng.random(), rng.randrange(len(words))
        if kind < 0.6:
            words[at] = f"w{rng.randrange(500)}"
        elif kind < 0.8:
            words.insert(at, f"w{rng.randrange(500)}")
        elif len(words) > 2:
            del words[at]
    return " ".join(words)


def rows_of(seed):
    """Families of near copies around the limit, short texts, and a passage that many texts share."""
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(30)]
    for size in (1, 3, 5, 6, 7, 9, 12, 20, 40, 41, 90, 200):
        base = [f"w{rng.randrange(500)}" for _ in range(size)]
        rows += [family(rng, base, rng.randint(0, max(1, size // 40 + 1))) for _ in range(12)]
    for _ in range(60):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(5, 60))]
        rows.append(" ".join(own[:3] + passage + own[3:]))
    chain = [f"c{i}" for i in range(60)]
    for step in range(12):
        rows.append(" ".join([f"x{step}_{i}" for i in range(0)] + chain[step : step + 48]))
    rng.shuffle(rows)
    return list(enumerate(rows, 1000))


@pytest.mark.parametrize("seed, tile", [(1, 256), (2, 3)])
def test_equals_all_pairs(frame, odd, monkeypatch, seed, tile):
    monkeypatch.setattr(op, "TILE", tile)
    rows = [*rows_of(seed), *odd]
    docs = frame([(*r, 1) for r in rows], "doc_id long, text string, address int")
    got = op.component_ids(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got.collect()), key=str) == plain(rows)


def test_no_rows(frame):
    assert op.component_ids(frame([], "doc_id long, text string")).count() == 0


def test_tiles_alone_find_all(frame, monkeypatch):
    """Without any round of leads, comparing whole groups finds the same."""
    monkeypatch.setattr(op, "ROUNDS", 0)
    monkeypatch.setattr(op, "TILE", 4)
    rows = rows_of(3)
    got = op.component_ids(frame(rows, "doc_id long, text string")).collect()
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got), key=str) == plain(rows)


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_a_needed_signature(seed):
    """Also when sets are small and many of their parts are empty."""
    rng, bands = np.random.default_rng(seed), op.Bands()
    for _ in range(150):
        size = int(rng.integers(1, 200))
        a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        gone, new = int(rng.integers(0, size // 9 + 2)), int(rng.integers(0, size // 9 + 2))
        b = np.union1d(a[gone:], rng.integers(1, 1 << 62, new).astype(np.uint64))
        if not len(b) or not op.similar(a, b, op.LIKE):
            continue
        hashes, begin = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        of, sign, bit, spare = op.signatures(hashes, begin, bands)
        kept = []
        for s in (0, 1):
            mine = []
            for low in (0, 1):
                rows = (of == s) & (bit == low)
                order = np.sort(sign[rows])
                mine.append(order[: len(order) - (int(spare[rows][0]) if rows.any() else 0)])  # any one order will do
            kept.append(set(np.concatenate(mine).tolist()))
        assert kept[0] & kept[1]


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 30, 300).astype(np.uint64) << np.uint64(20)) for _ in range(2))
        b = np.union1d(a[50:], b[:40])
        maps = [op._parity(x) for x in (a, b)]
        for width in (8, 64, min(map(len, maps))):
            assert op._differ(*op._folded(maps, width)) <= len(np.setxor1d(a, b))


def test_packing_and_short_texts():
    hashes, begin = op.shingles(pa.array(["a b", "A  B", "a b c d e f", None, "", "a b c d e"]))
    sets = [hashes[i:j].tolist() for i, j in zip(begin, begin[1:])]
    assert sets[0] == sets[1] and [len(s) for s in sets] == [1, 1, 2, 0, 0, 1] and sets[5][0] in sets[2]
    assert op._unpacked(op._packed(hashes[begin[2] : begin[3]])).tolist() == sorted(h >> 16 for h in sets[2])


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7)] + [(200, i) for i in range(201, 260)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for pair in links for x in pair if any(a != b for a, b in links if x in (a, b))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_sql(spark):
    from furrow.llm import queries

    path = "/root/testdata/sf0.001"
    assert difference(queries.op7_shingle_join(spark, path).toPandas(), duck(path).sql(op.sql()).df()) is None


def test_tiles_tell_a_forest():
    """Links that join components, never more than there are sets, and all that is needed."""
    rng = random.Random(9)
    count = 60
    label = np.array([rng.randrange(40) for _ in range(count)])
    first, second = map(np.array, zip(*((a, b) for a in range(count) for b in range(a) if label[a] != label[b])))
    alike = {(a, b) for a, b in zip(first.tolist(), second.tolist()) if (a % 7 == b % 7 or rng.random() < 0.01)}
    kept = op._forest(label, first, second, lambda a, b: (a, b) in alike)
    assert len(kept) < len(set(label.tolist())) and all((first[k].item(), second[k].item()) in alike for k in kept)

    def groups(pairs):
        parent = {x: x for x in label.tolist()}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(root(label[a].item()), root(label[b].item()))] = min(root(label[a].item()), root(label[b].item()))
        return {x: root(x) for x in parent}

    assert groups((first[k], second[k]) for k in kept) == groups(alike)


def test_tiles_of_one_large_group(spark, frame):
    """A group of near copies, not linked before, in many tiles and with decimal ids: all its links, and fewer rows than sets a tile."""
    from decimal import Decimal

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, family(rng, base, rng.randrange(0, 9))) for i in range(700)]
    big = Decimal(10**20)
    docs = frame([(big + i, text) for i, text in rows], "doc_id decimal(38,0), text string")
    sets = op.sets_of(docs, 5)
    wanted = sets.groupBy("address", "name").agg(op.F.min("doc_id").alias("node"))
    held = op.cut(op._sets(docs, wanted, 5))
    groups = held.selectExpr("1L AS sign", "address", "node AS label", f"{held.count()}L AS many", "size AS low", "size AS high", "max(size) OVER () AS widest")
    side, op.TILE = op.TILE, 100
    try:
        links = op._tiled(groups, held, op.LIKE)
        tiles = -(-held.count() // 100)
        assert links.count() <= tiles * held.count()
        of = {r.doc_id: r.component_id for r in op.component_ids(docs).collect()}
        told = {r.node: r.label for r in components(links).collect()}
    finally:
        op.TILE = side
    first = {r.node: told.get(r.node, r.node) for r in held.collect()}
    alike = components_of_sets(rows)
    assert {i: int(of[big + i] - big) for i, _ in rows} == alike
    assert {int(n - big): int(c - big) for n, c in first.items()} == {int(n - big): alike[int(n - big)] for n in first}


def components_of_sets(rows):
    return {int(i): int(c) for i, _, c in plain(rows)}

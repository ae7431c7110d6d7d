import itertools
import math

import numpy as np
import pandas as pd
import pytest

from furrow.operators import divergence
from furrow.params import WinnowParams
from furrow.plans import winnow
from test_graph import _brute_betweenness


def _kl(a, b):
    a, b = np.array(a, dtype=float), np.array(b, dtype=float)
    if not len(a) or a.sum() == 0:
        return None
    p, q = a / a.sum(), b / b.sum()
    if ((p > 0) & (q == 0)).any():
        return 1e50
    keep = p > 0
    return float((p[keep] * np.log2(p[keep] / q[keep])).sum())


def _profile(spark, a, b):
    rows = [(f"t{i:02d}", float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "taxon string, a double, b double")


@pytest.mark.parametrize("a,b", [([1, 2, 3], [1, 2, 3]), ([1, 2, 3], [3, 2, 1]), ([0, 2], [1, 1]), ([1, 2], [0, 1]), ([0, 0], [1, 1])])
def test_kl(spark, a, b):
    got = divergence.kl_divergence(_profile(spark, a, b)).first()["kl"]
    want = _kl(a, b)
    assert got == (None if want is None else pytest.approx(want, abs=1e-12))


def test_curve_equals_direct_sums(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 50, 30), rng.integers(0, 50, 30)
    b[b == 0] = 1
    b[4] = 0
    ranking = rng.permutation(25)  # five taxa are never dropped
    profile = _profile(spark, a, b).repartition(6)
    order = spark.createDataFrame([(f"t{t:02d}", i + 1) for i, t in enumerate(ranking.tolist())], "taxon string, rank bigint")
    got = {r["k"]: r["kl"] for r in divergence.divergence_curve(profile, order).collect()}
    assert set(got) == set(range(25))
    for k, kl in got.items():
        left = [t for t in range(30) if t not in set(ranking[:k].tolist())]
        assert kl == pytest.approx(_kl(a[left], b[left]), abs=1e-12)


def _counts(spark):
    rng = np.random.default_rng(21)
    base = rng.integers(0, 12, (24, 3))
    wide = pd.DataFrame(
        np.column_stack([base[:, j % 3] * (1 + j // 3) + rng.integers(0, 6, 24) for j in range(9)] + [np.full(24, 5), np.full(24, 2)]),
        columns=[f"t{j}" for j in range(9)] + ["const", "rare"],
    ).astype(float)
    rows = [
        ("A" if i < 12 else "B", f"s{i % 12}", t, v) for i, row in wide.iterrows() for t, v in row.items()
    ]
    return wide, spark.createDataFrame(rows, "condition string, sample_id string, taxon string, n double")


@pytest.mark.parametrize("centrality,pull,required", [("betweenness", 1, 3), ("degree", 2, 5)])
def test_loop_equals_brute_force(spark, centrality, pull, required):
    wide, counts = _counts(spark)
    params = WinnowParams(keep_thresh=0.35, centrality=centrality, num_to_pull=pull, num_required=required)
    out = winnow.run(counts, "A", "B", params)
    kept = [c for c in wide if (wide[c] > 3).any()]
    assert "rare" not in kept
    corr = wide[kept].rank().corr().abs()
    nodes = [c for c in kept if wide[c].nunique() > 1]
    edges = [(a, b) for a, b in itertools.combinations(nodes, 2) if corr.loc[a, b] >= 0.35]
    a, b = wide[kept][:12].sum(), wide[kept][12:].sum()
    want, step, left = [], 0, list(nodes)
    while step * pull < required and left:
        links = [e for e in edges if e[0] in left and e[1] in left]
        if centrality == "betweenness":
            score = _brute_betweenness(left, links)
        else:
            score = {n: sum(n in e for e in links) / (len(left) - 1) for n in left}
        best = sorted(left, key=lambda n: (-round(score[n], 12), n))[:pull]
        left = [n for n in left if n not in best]
        rest = [c for c in kept if c in left or c not in nodes]
        want += [(step, n, score[n], _kl(a[rest] + 1, b[rest] + 1)) for n in best]
        step += 1
    got = sorted((r["step"], r["taxon"], r["score"], r["kl"]) for r in out["pulled"].collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    for g, w in zip(got, sorted(want)):
        assert g[2:] == pytest.approx(w[2:])
    remaining = {c for c in kept} - {w[1] for w in want}
    assert {r["taxon"] for r in out["kept"].collect()} == remaining
    assert {r["taxon"] for r in out["matrix"].collect()} == remaining


def test_loop_ends_when_no_taxon_is_left(spark):
    rows = [(c, s, t, float(v)) for t, vs in {"x": (9, 1, 4, 2), "y": (8, 2, 5, 1)}.items() for (c, s), v in zip(
        (("A", "1"), ("A", "2"), ("B", "1"), ("B", "2")), vs)]
    counts = spark.createDataFrame(rows, "condition string, sample_id string, taxon string, n double")
    out = winnow.run(counts, "A", "B", WinnowParams(centrality="degree"))
    pulled = out["pulled"].orderBy("step").collect()
    assert [r["taxon"] for r in pulled] == ["x", "y"]
    assert pulled[0]["kl"] == pytest.approx(0) and pulled[1]["kl"] is None
    assert out["kept"].count() == 0 and math.isclose(pulled[0]["score"], 1.0)


def test_only_results_stay_stored(spark):
    from furrow import lineage

    rows = [(c, s, f"t{t}", float((s * (t + 1)) % 7 + t)) for c in "AB" for s in range(6) for t in range(5)]
    counts = spark.createDataFrame(rows, "condition string, sample_id int, taxon string, n double")
    lineage.forget(spark)
    out = winnow.run(counts, "A", "B", WinnowParams(num_required=2, keep_thresh=0.1, min_count=0))
    files, folder = lineage._file(spark, lineage._app_dir(spark))
    assert len(files.listStatus(folder)) == len(out) == 3
    assert all(table.count() for table in out.values())


def test_counts_are_stored_before_they_are_pruned(spark, monkeypatch):
    """Pruning reads the counts twice: they are made once."""
    read, prune = [], winnow.tables.prune_taxa
    monkeypatch.setattr(winnow.tables, "prune_taxa", lambda c, least: read.extend(c.inputFiles()) or prune(c, least))
    rows = [("A" if i % 2 else "B", i, f"t{j}", float((i * (j + 3)) % 11)) for i in range(8) for j in range(3)]
    counts = spark.createDataFrame(rows, "condition string, sample_id long, taxon string, n double")
    winnow.run(counts, "A", "B", WinnowParams(num_required=1, correlation="pearson", centrality="degree"))
    assert read

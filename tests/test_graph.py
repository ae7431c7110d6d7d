import itertools
import random
from collections import deque

import numpy as np
import pytest

from furrow.operators import graph


def _frames(spark, nodes, edges):
    return (
        spark.createDataFrame([(n,) for n in nodes], "id string"),
        spark.createDataFrame(edges, "src string, dst string"),
    )


def _random_graph():
    rnd = random.Random(12)
    nodes = [f"n{i:02d}" for i in range(14)]
    # A hub, a second component and an isolated node.
    edges = [("n00", n) for n in nodes[1:8]] + [(a, b) for a, b in itertools.combinations(nodes[1:10], 2) if rnd.random() < 0.2]
    edges += [("n10", "n11"), ("n11", "n12")]
    return nodes, sorted(set(edges))


def _neighbours(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def _search(near, source):
    dist, paths, order = {source: 0}, {source: 1}, []
    queue = deque([source])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in dist:
                dist[w], paths[w] = dist[v] + 1, 0
                queue.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
    return dist, paths


def _brute_betweenness(nodes, edges):
    near = _neighbours(nodes, edges)
    found = {s: _search(near, s) for s in nodes}
    score = {n: 0.0 for n in nodes}
    for s, t, v in itertools.permutations(nodes, 3):
        ds, ps = found[s]
        if t in ds and v in ds and t in found[v][0] and ds[v] + found[v][0][t] == ds[t]:
            score[v] += ps[v] * found[v][1][t] / ps[t]
    n = len(nodes)
    return {v: s / ((n - 1) * (n - 2)) for v, s in score.items()}


def _brute_closeness(nodes, edges):
    near = _neighbours(nodes, edges)
    out = {}
    for s in nodes:
        dist, _ = _search(near, s)
        far, r = sum(dist.values()), len(dist) - 1
        out[s] = r / far * r / (len(nodes) - 1) if far else 0.0
    return out


def _scores(df):
    return {r["node"]: r["score"] for r in df.collect()}


@pytest.mark.parametrize("small", [False, True])
def test_paths_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(graph, "CHUNK_EDGES", 2)
        monkeypatch.setattr(graph, "STEP_ROWS", 5)
    nodes, edges = _random_graph()
    per_batch = 5 if small else 4096
    frames = _frames(spark, nodes, edges)
    assert _scores(graph.closeness_centrality(*frames, per_batch=per_batch)) == pytest.approx(_brute_closeness(nodes, edges))
    assert _scores(graph.betweenness_centrality(*frames, per_batch=per_batch)) == pytest.approx(
        _brute_betweenness(nodes, edges)
    )


def test_closeness_by_sketches(spark, monkeypatch):
    """Exact on a small graph, also one with several components, hubs in chunks and ends that are no nodes."""
    monkeypatch.setattr(graph, "CHUNK_EDGES", 2)
    nodes, edges = _random_graph()
    found = _scores(graph.closeness_by_sketches(*_frames(spark, nodes, edges + [("n01", "n01")])))
    assert found == pytest.approx(_brute_closeness(nodes, edges))
    beyond = _scores(graph.closeness_by_sketches(*_frames(spark, nodes[:13], [(a, b) for a, b in edges] + [("n12", "none")])))
    assert set(beyond) == set(nodes[:13])
    assert _scores(graph.closeness_by_sketches(*_frames(spark, nodes, []))) == {n: 0 for n in nodes}


def test_closeness_by_sketches_is_near_on_larger_graphs(spark):
    rnd = random.Random(5)
    nodes = [f"n{i}" for i in range(2500)]
    edges = sorted({tuple(sorted(rnd.sample(nodes, 2))) for _ in range(5000)} | {(nodes[0], n) for n in nodes[1:200]})
    want = _brute_closeness(nodes, edges)
    found = _scores(graph.closeness_by_sketches(*_frames(spark, nodes, edges), precision=10))
    off = np.array([abs(found[n] - w) / w if w else found[n] for n, w in want.items()])
    assert off.mean() < 0.035 and off.max() < 0.15, (off.mean(), off.max())


def _brandes(nodes, edges):
    near = _neighbours(nodes, edges)
    score = dict.fromkeys(nodes, 0.0)
    for source in nodes:
        dist, paths = _search(near, source)
        gain = dict.fromkeys(dist, 0.0)
        for v in reversed(dist):  # nearest first, as they were found
            for w in near[v]:
                if dist[w] == dist[v] + 1:
                    gain[v] += paths[v] / paths[w] * (1 + gain[w])
            if v != source:
                score[v] += gain[v]
    return {v: s / ((len(nodes) - 1) * (len(nodes) - 2)) for v, s in score.items()}


def test_betweenness_by_draws_keeps_its_bound(spark, monkeypatch):
    rnd = random.Random(5)
    nodes = [f"n{i:04d}" for i in range(1200)]
    edges = [(nodes[0], n) for n in nodes[1:500]] + [(nodes[1], n) for n in nodes[450:1000]]
    edges = sorted(set(edges) | {tuple(sorted(rnd.sample(nodes[:1100], 2))) for _ in range(1200)})
    exact, drawn, search = _brandes(nodes, edges), [], graph._search
    monkeypatch.setattr(graph, "_search", lambda starts, rows, *rest, **how: drawn.append(rows) or search(starts, rows, *rest, **how))
    found = graph.betweenness_by_draws(*_frames(spark, nodes, edges), epsilon=0.2, delta=0.1, first=40).collect()
    assert {r["node"] for r in found} == set(nodes)
    assert all(abs(r["score"] - exact[r["node"]]) <= r["within"] <= 0.2 for r in found)
    assert 1 < len(drawn) and sum(drawn) < 800  # it stopped before all nodes were starts
    assert max(abs(r["score"] - exact[r["node"]]) for r in found) < 0.02
    assert {r["score"] for r in found if not exact[r["node"]]} == {0}


def test_betweenness_by_draws_of_all_nodes_is_exact(spark):
    nodes, edges = _random_graph()
    found = graph.betweenness_by_draws(*_frames(spark, nodes, edges + [("n03", "n03")]), epsilon=1e-6, first=3).collect()
    exact = _brute_betweenness(nodes, edges)
    assert {r["node"]: r["score"] for r in found} == pytest.approx(exact) and {r["within"] for r in found} == {0}
    for some, links in ((nodes, []), (["a", "b"], [("a", "b")]), ([], [])):
        none = graph.betweenness_by_draws(*_frames(spark, some, links)).collect()
        assert sorted(tuple(r) for r in none) == [(n, 0, 0) for n in sorted(some)]
    with pytest.raises(ValueError):
        graph.betweenness_by_draws(*_frames(spark, nodes, edges), epsilon=0)


def test_degree(spark):
    nodes, edges = _random_graph()
    near = _neighbours(nodes, edges)
    frames = _frames(spark, nodes, edges + [("n01", "n01"), ("n02", "n00")])
    assert _scores(graph.degree_centrality(*frames)) == pytest.approx({n: len(near[n]) / 13 for n in nodes})
    loops = _scores(graph.degree_centrality(*frames, self_loops=True))
    assert loops == pytest.approx({n: (len(near[n]) + 2) / 13 for n in nodes})


@pytest.mark.parametrize("self_loops", [False, True])
def test_eigenvector_equals_numpy(spark, monkeypatch, self_loops):
    monkeypatch.setattr(graph, "CHUNK_EDGES", 3)
    nodes, edges = _random_graph()
    matrix = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        i, j = nodes.index(a), nodes.index(b)
        matrix[i, j] = matrix[j, i] = 1
    values, vectors = np.linalg.eigh(matrix)
    want = np.abs(vectors[:, values.argmax()])
    got = _scores(graph.eigenvector_centrality(*_frames(spark, nodes, edges), tol=1e-9, self_loops=self_loops, max_iter=300))
    assert [got[n] for n in nodes] == pytest.approx(want, abs=1e-6)


def _leading(nodes, edges):
    """The part of equal entries that lies in the leading eigenspace."""
    matrix = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        matrix[nodes.index(a), nodes.index(b)] = matrix[nodes.index(b), nodes.index(a)] = 1
    values, vectors = np.linalg.eigh(matrix)
    space = vectors[:, values > values.max() - 1e-9]
    lead = space @ (space.T @ np.ones(len(nodes)))
    return lead / np.linalg.norm(lead)


def _several(copies, extra):
    """Equal components with an odd cycle and a tail, and paths of other lengths."""
    edges = []
    for c in range(copies):
        edges += [(f"c{c}n{a}", f"c{c}n{b}") for a, b in [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5)]]
    for p, size in enumerate(extra):
        edges += [(f"p{p}n{i:02d}", f"p{p}n{i + 1:02d}") for i in range(size)]
    return sorted({n for e in edges for n in e}), edges


@pytest.mark.parametrize("nodes, edges", [_several(3, [4, 9]), _several(0, [24, 25, 26, 26]), _several(1, [2])])
def test_eigenvector_of_equal_and_close_components(spark, monkeypatch, nodes, edges):
    """Paths of 26 and 27 nodes have leading values 0.001 apart, the two longest ones equal values."""
    monkeypatch.setattr(graph, "BASIS", 20)
    monkeypatch.setattr(graph, "KEPT", 5)
    got = _scores(graph.eigenvector_centrality(*_frames(spark, nodes, edges), tol=1e-10))
    assert [got[n] for n in nodes] == pytest.approx(_leading(nodes, edges), abs=1e-7)


def test_eigenvector_that_does_not_settle(spark):
    nodes, edges = _random_graph()
    with pytest.raises(RuntimeError):
        graph.eigenvector_centrality(*_frames(spark, nodes, edges), max_iter=2, tol=1e-12)


def test_textbook_graphs(spark):
    path = _frames(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d")])
    assert _scores(graph.betweenness_centrality(*path)) == pytest.approx({"a": 0, "b": 2 / 3, "c": 2 / 3, "d": 0})
    star = _frames(spark, "hwxyz", [("h", n) for n in "wxyz"])
    assert _scores(graph.betweenness_centrality(*star)) == pytest.approx({"h": 1, "w": 0, "x": 0, "y": 0, "z": 0})
    assert _scores(graph.closeness_centrality(*star))["h"] == pytest.approx(1)
    assert _scores(graph.degree_centrality(*star)) == pytest.approx({"h": 1, "w": 0.25, "x": 0.25, "y": 0.25, "z": 0.25})


def test_graph_without_edges(spark):
    frames = _frames(spark, "abc", [])
    for kind in ("degree", "closeness", "betweenness"):
        assert _scores(graph.centrality(*frames, kind)) == {"a": 0.0, "b": 0.0, "c": 0.0}
    assert _scores(graph.eigenvector_centrality(*frames)) == pytest.approx({n: 3**-0.5 for n in "abc"})
    assert _scores(graph.degree_centrality(*_frames(spark, "a", []))) == {"a": 1.0}


def test_sampled_sources_scale_up(spark):
    nodes, edges = _random_graph()
    n, e = _frames(spark, nodes, edges)
    every = _scores(graph.betweenness_centrality(n, e, sources=n))
    assert every == pytest.approx(_brute_betweenness(nodes, edges))
    some = _scores(graph.betweenness_centrality(n, e, sources=n.filter("id < 'n07'")))
    assert set(some) == set(nodes) and max(some, key=some.get) == "n00"


@pytest.mark.parametrize("kind, brute", [("betweenness", _brute_betweenness), ("closeness", _brute_closeness)])
def test_standing_equals_brute_force_after_every_drop(spark, monkeypatch, kind, brute):
    searched = []
    found = graph.Standing._found
    monkeypatch.setattr(graph.Standing, "_found", lambda self, starts, rows: searched.append(rows) or found(self, starts, rows))
    nodes, edges = _random_graph()
    edges.append(("n13", "n13"))
    standing = graph.Standing(*_frames(spark, nodes, edges), kind)
    sizes = []
    for count in (1, 1, 2, 1, 3):
        want = brute(nodes, [e for e in edges if e[0] != e[1]])
        assert _scores(standing.scores()) == pytest.approx(want)
        best = standing.pull(count)
        assert [n for n, _ in best] == sorted(want, key=lambda n: (-round(want[n], 9), n))[:count]
        gone = {n for n, _ in best}
        nodes, edges = [n for n in nodes if n not in gone], [e for e in edges if not gone & set(e)]
        sizes.append(len(nodes))
    assert searched[0] == 14 and all(n <= size for n, size in zip(searched[1:], sizes)) and sum(searched[1:]) < sum(sizes)
    while nodes:
        nodes = nodes[: -len(standing.pull(4))] if len(nodes) > 4 else [] if len(standing.pull(4)) == len(nodes) else nodes
    assert standing.pull(1) == [] and standing.scores().count() == 0
    standing.close()


def test_ranking(spark):
    scores = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "node string, score double")
    assert [r["node"] for r in graph.ranked(scores).collect()] == ["c", "a", "b"]
    assert [r["node"] for r in graph.top_nodes(scores, 2).collect()] == ["c", "a"]
    with pytest.raises(ValueError):
        graph.centrality(scores, scores, "pagerank")

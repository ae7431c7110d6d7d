"""Centrality of the nodes of an undirected graph.

Distances grow level by level: each level is one join of the frontier with the
edges and one aggregation, stored before the next. Sources are taken in
batches, so the stored state stays a bounded multiple of the node count. A node
of high degree has its edges split into chunks and joins chunk by chunk.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import match
from ..lineage import cut, cut_measured, discard

CHUNK_EDGES = 4096
SOURCES_PER_BATCH = 4096
# Joined rows a task should make.
STEP_ROWS = 100_000
# Basis vectors of the eigenvector search, and those a full basis restarts from.
BASIS, KEPT = 48, 8
# A closeness sketch has two to this power registers: an error of 1.6 % for large sets.
SKETCH_BITS = 12


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed copies of undirected edges, each once, without self loops."""
    plain = edges.select("src", "dst").filter(F.col("src") != F.col("dst"))
    back = plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return plain.unionByName(back).distinct()


def _links(edges: DataFrame, symmetric: bool) -> DataFrame:
    return edges.select("src", "dst") if symmetric else both_ways(edges)


def _chunked(links: DataFrame) -> tuple[DataFrame, int]:
    """Links with their chunk number and the chunk counts of both ends, and how many they are; stored."""
    links = cut(links)
    parts = links.groupBy("src").agg(F.ceil(F.count("*") / CHUNK_EDGES).cast("int").alias("parts"))
    near = match(links, parts, ["src"])
    far = match(near, parts.select(F.col("src").alias("dst"), F.col("parts").alias("dst_parts")), ["dst"])
    chunk = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")
    chunked, seen = cut_measured(
        far.select("src", "dst", chunk.alias("chunk"), "dst_parts", F.col("parts").alias("src_parts")), n=F.count("*")
    )
    discard(links)
    return chunked, seen["n"]


def _step(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Join rows at ``node`` (with its ``parts``) to all links leaving it."""
    spread = frontier.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.withColumnRenamed("node", "src").drop("parts").join(links.drop("src_parts"), ["src", "chunk"])


def _spread(frontier: DataFrame, rows: int, growth: float) -> DataFrame:
    """Spread a small table that a join will multiply, so that no task makes too many rows.

    All rows of a source stay together, so their sums shrink before the shuffle.
    """
    tasks = math.ceil(rows * growth / STEP_ROWS)
    return frontier.repartition(tasks, "source") if tasks > 1 else frontier


def _start_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that have links, with their chunk count."""
    parts = links.groupBy(F.col("src").alias("id")).agg(F.max("src_parts").alias("parts"))
    return parts.join(nodes, "id", "left_semi")


def _batches(starts: DataFrame, rows: int, per_batch: int) -> list[DataFrame]:
    n = max(1, math.ceil(rows / per_batch))
    return [starts.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


def _levels(starts: DataFrame, links: DataFrame, growth: float, rows: int) -> list[tuple[DataFrame, int]]:
    """Breadth-first levels from every start: ``(source, node, parts, paths)``, with their row counts.

    A neighbour of level d lies on level d-1, d or d+1, so only the last two
    levels tell which ones are new.
    """
    first = starts.select(F.col("id").alias("source"), F.col("id").alias("node"), "parts", F.lit(1.0).alias("paths"))
    levels = [(first, rows)]
    while True:
        reached = _step(_spread(*levels[-1], growth), links).select(
            "source", F.col("dst").alias("node"), F.col("dst_parts").alias("parts"), "paths", F.lit(0).alias("seen")
        )
        known = reduce(DataFrame.unionByName, [level for level, _ in levels[-2:]])
        fresh = (
            reached.unionByName(known.withColumns({"paths": F.lit(0.0), "seen": F.lit(1)}))
            .groupBy("source", "node")
            .agg(F.max("parts").alias("parts"), F.sum("paths").alias("paths"), F.max("seen").alias("seen"))
            .filter(F.col("seen") == 0)
            .drop("seen")
        )
        fresh, seen = cut_measured(fresh, n=F.count("*"))
        if not seen["n"]:
            discard(fresh)
            return levels
        levels.append((fresh, seen["n"]))


def _scores(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """All nodes with the sum of the scores found for them, zero without any."""
    zero = nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    return zero.unionByName(found.select("node", "score")).groupBy("node").agg(F.sum("score").alias("score"))


def degree_centrality(
    nodes: DataFrame, edges: DataFrame, self_loops: bool = False, symmetric: bool = False, n_nodes: int | None = None
) -> DataFrame:
    """Degree over ``n - 1``; a self loop, if asked for, counts twice.

    Here as below, ``symmetric`` tells that ``edges`` already hold both
    directions once, and ``n_nodes`` gives the node count where it is known.
    """
    n_nodes = nodes.count() if n_nodes is None else n_nodes
    ends = _links(edges, symmetric).select(F.col("src").alias("node"), F.lit(1.0).alias("score"))
    if n_nodes < 2:
        return nodes.select(F.col("id").alias("node"), F.lit(1.0).alias("score"))
    links = F.col("score") + (2 if self_loops else 0)
    return _scores(nodes, ends).select("node", (links / F.lit(float(n_nodes - 1))).alias("score"))


def _accumulated(levels: list[tuple[DataFrame, int]], links: DataFrame, growth: float) -> list[DataFrame]:
    """Brandes' accumulation from the last level back: ``(source, node, parts, paths, delta)`` of every level but the last."""
    deltas: list[DataFrame] = []
    below = None
    for level, rows in reversed(levels[1:]):
        own = level.withColumns({"share": F.lit(0.0), "own": F.lit(1)})
        if below is None:
            delta = level.withColumn("delta", F.lit(0.0))
        else:
            shares = below.select("source", "node", "parts", ((1 + F.col("delta")) / F.col("paths")).alias("share"))
            given = _step(_spread(shares, below_rows, growth), links).select(
                "source",
                F.col("dst").alias("node"),
                F.col("dst_parts").alias("parts"),
                F.lit(0.0).alias("paths"),
                "share",
                F.lit(0).alias("own"),
            )
            delta = cut(
                own.unionByName(given)
                .groupBy("source", "node")
                .agg(
                    F.max("parts").alias("parts"),
                    F.max("paths").alias("paths"),
                    F.sum("share").alias("share"),
                    F.max("own").alias("own"),
                )
                .filter(F.col("own") == 1)
                .select("source", "node", "parts", "paths", (F.col("paths") * F.col("share")).alias("delta"))
            )
            deltas.append(delta)
        below, below_rows = delta, rows
    return deltas


def _search(
    starts: DataFrame, rows: int, links: DataFrame, growth: float, per_batch: int, back: bool
) -> tuple[DataFrame, DataFrame | None]:
    """Breadth-first search from every start ``(id, parts)``, of which there are ``rows``; its results are stored.

    Gives ``(node, reached, far, label)``: how many nodes a start reaches, itself included, the sum of their distances and
    the smallest of them; and with ``back`` ``(node, score, squares)``, the sums of all starts' dependencies on a node and of
    their squares.
    """
    facts, gains = [], []
    for batch in _batches(starts, rows, per_batch):
        levels = _levels(batch, links, growth, min(rows, per_batch))
        steps = [level.select("source", "node", F.lit(d).alias("d")) for d, (level, _) in enumerate(levels)]
        told = reduce(DataFrame.unionByName, steps).groupBy("source")
        told = told.agg(F.count("*").alias("reached"), F.sum("d").alias("far"), F.min("node").alias("label"))
        facts.append(cut(told.withColumnRenamed("source", "node")))
        deltas = _accumulated(levels, links, growth) if back else []
        if deltas:
            gained = reduce(DataFrame.unionByName, deltas).groupBy("node")
            gains.append(cut(gained.agg(F.sum("delta").alias("score"), F.sum(F.col("delta") * F.col("delta")).alias("squares"))))
        discard(*[level for level, _ in levels], *deltas)
    return reduce(DataFrame.unionByName, facts), reduce(DataFrame.unionByName, gains) if gains else None


def _nearness() -> Column:
    """Closeness of a start from its facts, before the share of all nodes that it reaches."""
    others = F.col("reached") - 1
    return F.coalesce(F.try_divide(others, F.col("far")) * others, F.lit(0.0))


def closeness_centrality(
    nodes: DataFrame,
    edges: DataFrame,
    per_batch: int = SOURCES_PER_BATCH,
    symmetric: bool = False,
    n_nodes: int | None = None,
) -> DataFrame:
    """Reached share times inverse mean distance, for graphs of several components too."""
    links, n_links = _chunked(_links(edges, symmetric))
    starts, seen = cut_measured(_start_nodes(nodes, links), n=F.count("*"))
    facts, _ = _search(starts, seen["n"], links, n_links / max(1, seen["n"]), per_batch, back=False)
    discard(links, starts)
    n_nodes = nodes.count() if n_nodes is None else n_nodes
    return _scores(nodes, facts.select("node", (_nearness() / F.lit(float(max(1, n_nodes - 1)))).alias("score")))


def closeness_by_sketches(
    nodes: DataFrame, edges: DataFrame, precision: int = SKETCH_BITS, symmetric: bool = False, n_nodes: int | None = None
) -> DataFrame:
    """Estimate of :func:`closeness_centrality` with one HyperLogLog sketch a node in place of all (source, node) pairs.

    The sketch of a node stands for the nodes within d links of it; a level merges it with those of its neighbours, and what
    its estimate grows by lies d + 1 away. State is one sketch a node (at most 2**precision bytes), a level one aggregation
    over the links. Only sketches that the last level changed are sent. The search ends with a level at which no estimate
    grows. Small sets are counted almost exactly, large ones with a relative error of some 1.04 / sqrt(2**precision).
    """
    links, _ = _chunked(_links(edges, symmetric))
    own = F.hll_sketch_agg(F.col("id").cast("string"), F.lit(precision)).alias("sketch")
    held = cut(
        _start_nodes(nodes, links).groupBy(F.col("id").alias("node")).agg(F.max("parts").alias("parts"), own)
        .withColumns({"reached": F.lit(1).cast("long"), "far": F.lit(0.0), "fresh": F.lit(True)})
    )
    level, grown = 0, True
    while grown:
        level += 1
        given = _step(held.where("fresh").select("node", "parts", "sketch"), links).select(F.col("dst").alias("node"), "sketch")
        # Own rows carry the state; a node without one is none of ``nodes``.
        merged = held.withColumnRenamed("sketch", "before").withColumn("sketch", F.col("before")).select(
            "node", "parts", "before", "far", "reached", "sketch"
        ).unionByName(
            given, allowMissingColumns=True
        ).groupBy("node").agg(
            *(F.max(c).alias(c) for c in ("parts", "before", "far")), F.max("reached").alias("known"),
            F.hll_union_agg("sketch").alias("sketch"),
        ).where("known is not null")
        now = F.greatest("known", F.hll_sketch_estimate("sketch"))
        following, seen = cut_measured(
            merged.withColumn("reached", now).select(
                "node", "parts", "sketch", "reached", (F.col("far") + level * (F.col("reached") - F.col("known"))).alias("far"),
                (F.col("sketch") != F.col("before")).alias("fresh"), (F.col("reached") > F.col("known")).alias("grew"),
            ),
            n=F.count_if("grew"),
        )
        discard(held)
        held, grown = following, seen["n"] > 0
    discard(links)
    n_nodes = nodes.count() if n_nodes is None else n_nodes
    return _scores(nodes, held.select("node", (_nearness() / F.lit(float(max(1, n_nodes - 1)))).alias("score")))


def betweenness_centrality(
    nodes: DataFrame,
    edges: DataFrame,
    per_batch: int = SOURCES_PER_BATCH,
    sources: DataFrame | None = None,
    symmetric: bool = False,
    n_nodes: int | None = None,
) -> DataFrame:
    """Normalised betweenness by Brandes' accumulation, end points excluded.

    ``sources`` limits the starting nodes for an estimate, scaled up to all of
    them; by default every node is one and the result is exact.
    """
    n_nodes = nodes.count() if n_nodes is None else n_nodes
    links, n_links = _chunked(_links(edges, symmetric))
    linked, scale = _start_nodes(nodes, links), 1.0
    if sources is not None:
        linked = linked.join(sources.select("id"), "id", "left_semi")
        scale = n_nodes / max(1, sources.select("id").distinct().count())
    starts, seen = cut_measured(linked, n=F.count("*"))
    facts, gained = _search(starts, seen["n"], links, n_links / max(1, n_nodes), per_batch, back=True)
    discard(links, starts, facts)
    if gained is None or n_nodes < 3:
        return nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    norm = scale / ((n_nodes - 1) * (n_nodes - 2))
    return _scores(nodes, gained).withColumn("score", F.col("score") * norm)


def _half_width(spread: Column, drawn: int, held: int, chance: float) -> Column:
    """How far the mean of ``drawn`` of ``held`` values from 0 to 1, drawn without return, may lie off, but for ``chance``.

    The empirical Bernstein-Serfling bound of Bardenet and Maillard (2015) for both sides; ``spread`` is the standard
    deviation of the values drawn.
    """
    if drawn >= held:
        return F.lit(0.0)
    logs = math.log(10 / chance)
    left = 1 - (drawn - 1) / held if 2 * drawn <= held else (1 - drawn / held) * (1 + 1 / drawn)
    return spread * math.sqrt(2 * left * logs / drawn) + (7 / 3 + 3 / math.sqrt(2)) * logs / drawn


def betweenness_by_draws(
    nodes: DataFrame,
    edges: DataFrame,
    epsilon: float = 0.01,
    delta: float = 0.1,
    first: int = 64,
    seed: int = 0,
    per_batch: int = SOURCES_PER_BATCH,
    symmetric: bool = False,
    n_nodes: int | None = None,
) -> DataFrame:
    """Estimate ``(node, score, within)`` of :func:`betweenness_centrality` from randomly drawn shortest paths.

    With probability ``1 - delta`` every score, all nodes at once, lies within ``epsilon`` of the exact one, and within its own
    ``within``. A draw is a start node and all shortest paths from there: a search finds them together, and their mean share
    through a node varies no more than that of a single path. Rounds double the draws until the bound holds for the node whose
    shares vary most, so the spread that the data show decides how many there are, not a list made beforehand. Draws are
    without return, in the order of a hash of the id; a graph that needs all its nodes gets its exact scores, ``within`` 0.
    """
    if not (0 < epsilon and 0 < delta < 1 and first > 0):
        raise ValueError("epsilon and first must be positive, delta must lie between 0 and 1")
    n_nodes = nodes.count() if n_nodes is None else n_nodes
    zero = nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("score"), F.lit(0.0).alias("squares"))
    links, n_links = _chunked(_links(edges, symmetric))
    linked, seen = cut_measured(_start_nodes(nodes, links), n=F.count("*"))
    n_linked, held, drawn, low, within = seen["n"], zero, 0, 0.0, F.lit(0.0)
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    rounds = max(1, math.ceil(math.log2(max(1.0, n_linked / first))) + 1) if n_linked and n_nodes > 2 else 0
    for turn in range(rounds):
        high = 1.0 if turn == rounds - 1 else first * 2**turn / n_linked
        starts, seen = cut_measured(linked.filter((place >= low) & (place < high)), n=F.count("*"))
        low = high
        if not seen["n"]:
            continue
        facts, gained = _search(starts, seen["n"], links, n_links / n_linked, per_batch, back=True)
        drawn += seen["n"]
        mean = F.col("score") / ((n_nodes - 2) * drawn)
        spread = F.sqrt(F.greatest(F.col("squares") / ((n_nodes - 2) ** 2 * drawn) - mean * mean, F.lit(0.0)))
        # Every node in every round may miss its bound: the chance is shared out among them.
        within = _half_width(spread, drawn, n_linked, delta / (n_linked * rounds)) * (n_linked / (n_nodes - 1))
        summed = held if gained is None else held.unionByName(gained).groupBy("node").agg(
            F.sum("score").alias("score"), F.sum("squares").alias("squares")
        )
        before = held
        held, seen = cut_measured(summed, widest=F.max(within))
        discard(facts, starts, before, *([] if gained is None else [gained]))
        if seen["widest"] <= epsilon:
            break
    discard(links, linked)
    norm = n_linked / max(1, (n_nodes - 1) * (n_nodes - 2) * drawn)
    return held.select("node", (F.col("score") * norm).alias("score"), within.alias("within"))


class Standing:
    """Betweenness or closeness of a graph that loses nodes.

    A dropped node changes what starts that reach it found: these are the nodes of its component. Each node's score is kept
    with its component (the smallest node in it) and the component's size; after a drop only the nodes of the components
    that lost one are searched from again, and a component of one node is not searched at all. Normalising is left to the end.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, kind: str = "betweenness", per_batch: int = SOURCES_PER_BATCH):
        if kind not in ("betweenness", "closeness"):
            raise ValueError("kind is 'betweenness' or 'closeness'")
        self.kind, self.per_batch, self.gone = kind, per_batch, []
        self.links, self.n_links = _chunked(both_ways(edges))
        parts = self.links.groupBy(F.col("src").alias("id")).agg(F.max("src_parts").alias("parts"))
        starts, seen = cut_measured(nodes.select("id").distinct().join(parts, "id", "left"), n=F.count("*"))
        self.n_nodes = self.n_first = seen["n"]
        self.held = cut(self._found(starts, seen["n"]))
        discard(starts)

    def _found(self, starts: DataFrame, rows: int) -> DataFrame:
        """Rows ``(node, parts, label, reached, raw)`` of the starts, searched over the links that are left."""
        gone = F.lit(self.gone).cast("array<string>")  # one literal keeps the generated code alike from step to step
        kept = [~F.array_contains(gone, F.col(end).cast("string")) for end in ("src", "dst")]
        links = self.links.filter(kept[0] & kept[1])
        growth = self.n_links / max(1, self.n_first)
        facts, gained = _search(starts.filter("parts is not null"), rows, links, growth, self.per_batch, self.kind == "betweenness")
        out = starts.withColumnRenamed("id", "node").join(facts, "node", "left").withColumns(
            {"label": F.coalesce("label", "node"), "reached": F.coalesce("reached", F.lit(1))}
        )
        if self.kind == "closeness":
            return out.select("node", "parts", "label", "reached", _nearness().alias("raw"))
        if gained is None:
            return out.select("node", "parts", "label", "reached", F.lit(0.0).alias("raw"))
        summed = gained.groupBy("node").agg(F.sum("score").alias("raw"))
        return out.join(summed, "node", "left").select("node", "parts", "label", "reached", F.coalesce("raw", F.lit(0.0)).alias("raw"))

    def scores(self) -> DataFrame:
        """Scores ``(node, score)`` of the nodes that are left."""
        n = self.n_nodes
        norm = 1.0 / max(1, n - 1) if self.kind == "closeness" else 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
        return self.held.select("node", (F.col("raw") * norm).alias("score"), "label", "reached")

    def pull(self, count: int) -> list[tuple[str, float]]:
        """Drop the ``count`` highest-ranked nodes; gives them and their scores."""
        best = top_nodes(self.scores(), count).collect()
        if not best:
            return []
        self.gone += [r["node"] for r in best]
        self.n_nodes -= len(best)
        sizes = {r["label"]: r["reached"] for r in best}
        lost = F.col("label").isin(list(sizes))
        left = self.held.filter(~F.col("node").isin([r["node"] for r in best]))
        rows = sum(sizes.values()) - len(best)
        if rows:
            again = left.filter(lost).select(F.col("node").alias("id"), "parts")
            left = left.filter(~lost).unionByName(self._found(again, rows))
        before, self.held = self.held, cut(left)
        discard(before)
        return [(r["node"], r["score"]) for r in best]

    def close(self) -> None:
        discard(self.links, self.held)


def _combined(weights, column: str) -> Column:
    """Sum of an array's elements with weights, in one literal, so that the generated code stays alike from step to step."""
    parts = F.zip_with(F.col(column), F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)


def _ritz(gram: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, greatest first, and coefficients (columns) of the problem projected onto a basis that is nearly orthonormal."""
    lower = np.linalg.cholesky(gram)
    inner = np.linalg.solve(lower, np.linalg.solve(lower, (image + image.T) / 2).T)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], np.linalg.solve(lower.T, vectors[:, ::-1])


def eigenvector_centrality(
    nodes: DataFrame,
    edges: DataFrame,
    max_iter: int = 300,
    tol: float = 1e-9,
    self_loops: bool = False,
    symmetric: bool = False,
    n_nodes: int | None = None,
) -> DataFrame:
    """Leading eigenvector of the adjacency matrix, of length one, by the Lanczos method.

    The search starts at the vector of equal entries and keeps a basis of the space that its products with the matrix span.
    Where several components share the leading value, that space holds one leading vector only, the part of the start that
    lies in their common eigenspace: components count by how much of it they hold. A step is one job: it multiplies the
    newest basis vector, and the same job sums its inner products with all others, so the small problem on the driver (at
    most ``BASIS`` values a side) uses measured products and drifts nowhere. A full basis restarts from its best vectors.

    Done when the residual, over the gap to the next value, is below ``tol``; raises after ``max_iter`` products. A loop at
    every node (``self_loops``) adds one to every eigenvalue and changes no vector.
    """
    n_nodes = nodes.count() if n_nodes is None else n_nodes
    if n_nodes == 0:
        return nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    links, _ = _chunked(_links(edges, symmetric))
    parts = links.groupBy(F.col("src").alias("id")).agg(F.max("src_parts").alias("parts"))
    start = nodes.select("id").join(parts, "id", "left").select(F.col("id").alias("node"), "parts")
    current = start.withColumn("w", F.array(F.lit(1.0 / math.sqrt(n_nodes))))
    gram, image = np.zeros((0, 0)), np.zeros((0, 0))
    stored = None
    for _ in range(max_iter):
        size = len(gram) + 1
        last = F.get("w", F.lit(size - 1))
        moved = _step(current.where("parts is not null").select("node", "parts", last.alias("x")), links)
        product = moved.groupBy(F.col("dst").alias("node")).agg(F.sum("x").alias("z"))
        joined = current.join(product, "node", "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
        sums = {f"g{i}": F.sum(F.get("w", F.lit(i)) * last) for i in range(size)}
        sums |= {f"h{i}": F.sum(F.get("w", F.lit(i)) * F.col("z")) for i in range(size)}
        sums |= {f"s{i}": F.sum(F.get("w", F.lit(i))) for i in range(size)}
        previous = stored
        stored, seen = cut_measured(joined, zz=F.sum(F.col("z") * F.col("z")), **sums)
        if previous is not None:
            discard(previous)
        gram, image = _bordered(gram, [seen[f"g{i}"] for i in range(size)]), _bordered(image, [seen[f"h{i}"] for i in range(size)])
        values, vectors = _ritz(gram, image)
        along = np.linalg.solve(gram, image[:, -1])
        rest = math.sqrt(max(seen["zz"] - along @ image[:, -1], 0.0))
        scale = max(abs(values[0]), abs(values[-1]))
        gap = values[0] - values[1] if size > 1 else scale
        error = rest * abs(vectors[-1, 0])
        if rest <= 1e-7 * scale or (size > 1 and error <= tol * gap):
            # A rest this small is rounding: the space is closed.
            sums = np.array([seen[f"s{i}"] for i in range(size)])
            leading = vectors[:, 0] * np.copysign(1.0, sums @ vectors[:, 0])
            score = F.greatest(_combined(leading, "w"), F.lit(0.0))
            discard(links)
            return stored.select("node", score.alias("score"))
        kept = np.eye(size) if size < BASIS else vectors[:, :KEPT]
        fresh = (F.col("z") - _combined(along, "w")) / F.lit(rest)
        basis = F.col("w") if size < BASIS else F.array(*[_combined(column, "w") for column in kept.T])
        current = stored.select("node", "parts", F.concat(basis, F.array(fresh)).alias("w"))
        gram, image = kept.T @ gram @ kept, kept.T @ image @ kept
    raise RuntimeError(f"the leading vector did not settle within {max_iter} products")


def _bordered(matrix: np.ndarray, column: list[float]) -> np.ndarray:
    """A symmetric matrix with one row and column more."""
    size = len(column)
    out = np.empty((size, size))
    out[: size - 1, : size - 1] = matrix
    out[-1, :] = out[:, -1] = column
    return out



CENTRALITIES = {
    "betweenness": betweenness_centrality,
    "betweenness_draws": betweenness_by_draws,
    "closeness": closeness_centrality,
    "closeness_sketch": closeness_by_sketches,
    "degree": degree_centrality,
    "eigenvector": eigenvector_centrality,
}


def centrality(nodes: DataFrame, edges: DataFrame, kind: str = "betweenness", **options) -> DataFrame:
    """Centrality ``(node, score)`` of the given kind."""
    if kind not in CENTRALITIES:
        raise ValueError(f"unknown centrality {kind!r}")
    return CENTRALITIES[kind](nodes, edges, **options)


def ranked(scores: DataFrame) -> DataFrame:
    """Scores from the highest down, by name on ties; compared after rounding to nine places, as sums differ in their last bits."""
    return scores.orderBy(F.round("score", 9).desc(), F.col("node").asc())


def top_nodes(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest-ranked nodes."""
    return ranked(scores).limit(n)

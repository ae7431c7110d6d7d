"""Mixing sources to target weights by iterative proportional fitting.

Token masses are summed by cell (one category of each dimension, such as source, language and topic). Raking scales
the cells dimension by dimension until the token shares of all categories meet their targets: this gives the weights.
A probability is at most 1, so probabilities are raked again with that bound inside: each step scales the cells of a
category so that with the bound the expected tokens are its target share of the budget. A fixed hash of the id decides.
A category that has fewer tokens than its target is taken whole, and the others of its dimension share the rest by
their targets; shares that stay off their targets are logged. With ``bounded=False`` the probability is
``min(1, c * weight of its cell)`` with ``c`` set to the budget, and shares of clipped cells fall short.

Values without a target, nulls among them, form the category ``(other)``, which gets the share that the targets leave.
So the number of cells is bounded by the targets given, whatever the data: only cells come to the driver.

Defined cases: targets of categories without tokens are spread over the others in proportion; if no category with
tokens has a target, the dimension is left as it is. Documents without tokens have the probability of their cell, and
belong to no cell's mass; a cell without mass has weight 1. Repeated rows count as often as they occur and are kept or
left together, as equal ids have equal lots; a null id has the lot of the empty string. Other columns are kept; those
named like the added ones are replaced.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import match
from .arrow import own_names

OTHER = "(other)"
SWEEPS = 25
#: Rounds of raking under the bound at most; it ends when all margins are met to this share of the budget.
ROUNDS, CLOSE = 1000, 1e-7
#: Factors stay within this range where targets of several dimensions cannot be met together.
RANGE = 1e9
#: Expected shares this far off their targets are logged.
OFF = 1e-3
Targets = Mapping[str, Mapping[str, float]]


def shares(targets: Mapping[str, float]) -> dict[str, float]:
    """Targets with the share of the other values."""
    return {**targets, OTHER: max(0.0, 1.0 - sum(targets.values()))}


def category(value: Column, targets: Mapping[str, float]) -> Column:
    text = value.cast("string")
    return F.when(text.isin(*targets), text).otherwise(OTHER)


def rake(mass: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Weights by cell: after scaling by them each dimension's shares are its targets. codes: cells x dimensions."""
    total, scaled = mass.sum(), mass.astype(float)
    for _ in range(sweeps):
        for d, target in enumerate(targets):
            now = np.bincount(codes[:, d], scaled, len(target))
            wanted = np.where(now > 0, target, 0.0)
            if wanted.sum() > 0:
                factor = np.divide(wanted / wanted.sum() * total, now, out=np.zeros_like(now), where=now > 0)
                scaled = scaled * factor[codes[:, d]]
    return np.divide(scaled, mass, out=np.ones_like(scaled), where=mass > 0)


def scale(mass: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """c so that min(1, c * weight) has the expected mass ``budget``; infinite if all that has a weight is less."""
    order = np.argsort(-weight, kind="stable")
    m, w = mass[order].astype(float), weight[order]
    full = np.concatenate([[0.0], np.cumsum(m)])[:-1]  # mass of the cells of larger weight, taken whole
    rest = np.cumsum((m * w)[::-1])[::-1]
    found = np.divide(budget - full, rest, out=np.full_like(rest, np.inf), where=rest > 0)
    fits = np.flatnonzero((rest > 0) & (np.where(rest > 0, found, 0.0) * w <= 1))
    return max(found[fits[0]], 0.0) if len(fits) else np.inf


def probabilities(mass: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """min(1, c * weight) with the expected mass ``budget``, or all that has a weight where that is less."""
    c = scale(mass, weight, budget)
    return np.minimum(1.0, c * weight) if np.isfinite(c) else (weight > 0).astype(float)


def reachable(mass: np.ndarray, target: np.ndarray, budget: float) -> np.ndarray:
    """Tokens of each category: in proportion to the targets, but no more than there are."""
    wanted = np.divide(target, mass, out=np.zeros(len(mass)), where=mass > 0)
    return mass * probabilities(mass, wanted, budget)


def bounded_probabilities(mass: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], budget: float) -> np.ndarray:
    """Probabilities by cell with the expected mass ``budget`` and each dimension's reachable shares. codes: cells x dimensions."""
    factors = np.ones(len(mass))
    margins = []
    for d, target in enumerate(targets):
        held = np.bincount(codes[:, d], mass, len(target))
        if target[held > 0].sum() > 0:
            goals = reachable(held, target, budget)
            margins.append([(np.flatnonzero(codes[:, d] == c), goals[c]) for c in np.flatnonzero(held > 0)])
    for _ in range(ROUNDS):
        for margin in margins:
            for cells, goal in margin:
                now = factors[cells]
                c = scale(mass[cells], now, goal)
                if not np.isfinite(c):  # taken whole
                    c = 1 / now[now > 0].min() if now.any() else 1.0
                factors[cells] = np.where((now > 0) & (goal > 0), np.clip(now * c, 1 / RANGE, RANGE), 0.0)
        taken = mass * np.minimum(1.0, factors)
        if max((abs(taken[cells].sum() - goal) for margin in margins for cells, goal in margin), default=0.0) <= CLOSE * budget:
            break
    return probabilities(mass, factors, budget)


def expected_shares(mass: np.ndarray, codes: np.ndarray, chance: np.ndarray, d: int, size: int) -> np.ndarray:
    """Expected token shares of a dimension's categories."""
    taken = np.bincount(codes[:, d], mass * chance, size)
    return taken / taken.sum() if taken.sum() > 0 else taken


def lot(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def mix(
    docs: DataFrame, targets: Targets, rate: float, doc_id: str = "doc_id", tokens: str = "tokens", seed: int = 0,
    sweeps: int = SWEEPS, bounded: bool = True,
) -> DataFrame:
    """Add weight, probability and kept, in place of columns so named. Other columns are kept.

    ``targets``: by column, the token share of each value; ``rate``: of all tokens. Null and unlisted values are one category,
    the rest. Null tokens count as none; an empty table stays empty.
    """
    names = own_names(*targets)
    placed = docs.drop("weight", "probability", "kept").withColumns(
        {name: category(F.col(d), targets[d]) for name, d in zip(names, targets)}
    )
    cells = placed.groupBy(*names).agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("double").alias("_mass")).orderBy(*names).collect()
    wanted = [shares(t) for t in targets.values()]
    index = [{value: i for i, value in enumerate(t)} for t in wanted]
    mass = np.array([c["_mass"] for c in cells], float)
    codes = np.array([[index[d][c[n]] for d, n in enumerate(names)] for c in cells], int).reshape(len(cells), len(names))
    goals = [np.array(list(t.values())) for t in wanted]
    weight = rake(mass, codes, goals, sweeps) if len(cells) else mass
    if bounded and len(cells):
        chance = bounded_probabilities(mass, codes, goals, rate * mass.sum())
        for d, (column, goal) in enumerate(zip(targets, goals)):
            got = expected_shares(mass, codes, chance, d, len(goal))
            missed = {v: (round(float(s), 4), round(float(g), 4)) for v, s, g in zip(wanted[d], got, goal) if abs(s - g) > OFF}
            if missed:
                logging.getLogger(__name__).warning("%s: expected shares off their targets (share, target): %s", column, missed)
    else:
        chance = probabilities(mass, weight, rate * mass.sum()) if len(cells) else mass
    kind = ", ".join(f"{n} string" for n in names) + ", weight double, probability double"
    rows = [(*(c[n] for n in names), float(w), float(p)) for c, w, p in zip(cells, weight, chance)]
    found = docs.sparkSession.createDataFrame(rows, kind)
    return (
        match(placed, F.broadcast(found), names, "left")
        .withColumn("kept", lot(F.col(doc_id), seed) < F.col("probability"))
        .drop(*names)
    )


def sql(docs: str, targets: Targets, rate: float, doc_id: str = "doc_id", seed: int = 0, sweeps: int = SWEEPS) -> str:
    """Weight, probability and kept for each row of the DuckDB relation ``docs`` (with a column tokens)."""
    names = list(targets)

    def folded(d: str) -> str:
        listed = ", ".join(f"'{v}'" for v in targets[d])
        return f"CASE WHEN {d} IN ({listed}) THEN {d} ELSE '{OTHER}' END AS c_{d}"

    steps, last = [], "cells"
    for sweep in range(sweeps):
        for d in names:
            wanted = "CASE c_" + d + " " + " ".join(f"WHEN '{v}' THEN {s!r}" for v, s in shares(targets[d]).items()) + " END::DOUBLE"
            this = f"s{sweep}_{d}"
            steps.append(
                f"{this}a AS MATERIALIZED (SELECT *, sum(scaled) OVER (PARTITION BY c_{d}) AS now, {wanted} AS target,"
                f" row_number() OVER (PARTITION BY c_{d}) AS first FROM {last})"
            )
            steps.append(
                f"{this}b AS MATERIALIZED (SELECT sum(target) AS wanted FROM {this}a WHERE first = 1 AND now > 0)"
            )
            steps.append(
                f"{this} AS MATERIALIZED (SELECT * EXCLUDE (scaled, now, target, first, wanted), CASE WHEN wanted > 0 AND now > 0 THEN"
                f" scaled * (target / wanted * total / now) ELSE scaled END AS scaled FROM {this}a, {this}b)"
            )
            last = this
    cols = ", ".join(f"c_{d}" for d in names)
    on = " AND ".join(f"p.c_{d} = w.c_{d}" for d in names)
    return f"""
WITH placed AS MATERIALIZED (SELECT *, {", ".join(map(folded, names))} FROM ({docs})),
masses AS MATERIALIZED (SELECT {cols}, coalesce(sum(tokens), 0)::DOUBLE AS mass FROM placed GROUP BY ALL),
cells AS MATERIALIZED (SELECT *, sum(mass) OVER () AS total, mass AS scaled FROM masses),
{", ".join(steps)},
weighted AS MATERIALIZED (SELECT {cols}, mass, total, CASE WHEN mass > 0 THEN scaled / mass ELSE 1 END AS weight FROM {last}),
ordered AS (SELECT *, row_number() OVER (ORDER BY weight DESC, {cols}) AS place FROM weighted),
sums AS (SELECT *, coalesce(sum(mass) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole,
  sum(mass * weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ordered),
scales AS (SELECT min_by(({rate!r} * total - whole) / rest, place) AS scale FROM sums
  WHERE rest > 0 AND ({rate!r} * total - whole) / rest * weight <= 1),
chances AS (SELECT {cols}, weight, CASE WHEN scale IS NULL THEN (weight > 0)::INT ELSE least(1.0, greatest(scale, 0) * weight) END
  AS probability FROM weighted, scales)
SELECT p.* EXCLUDE ({cols}), w.weight, w.probability,
  ('0x' || substr(md5(coalesce({doc_id}::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < w.probability AS kept
FROM placed p JOIN chances w ON {on}"""

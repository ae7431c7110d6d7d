"""Connected components by contraction: every round gives each node the smallest label near it and contracts the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, cut_measured, discard

#: Times a round doubles the way along labels of labels; a chain shrinks by four to this power.
DOUBLINGS = 2


def _onward(labels: DataFrame, further: DataFrame) -> DataFrame:
    """Labels replaced by the labels that ``further`` gives them, where it does."""
    moved = further.select(F.col("node").alias("label"), F.col("label").alias("_further"))
    return labels.join(moved, "label", "left").select("node", F.coalesce("_further", "label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label): each node of ``links`` (a, b) with the smallest node it is linked with.

    Only tables move: no node, link or component comes to the driver. A round at least halves the nodes that are left,
    and chains shrink faster, so rounds grow with the logarithm of the largest component.
    """
    plain = links.select("a", "b").where("a <> b")
    both = plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges, seen = cut_measured(both, n=F.count("*"))
    found = None
    while seen["n"]:
        near = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("label")))
        step = near
        for _ in range(DOUBLINGS):
            step = _onward(step, step)
        step = cut(step)
        found = step if found is None else cut(_onward(found, step))
        a, b = (step.select(F.col("node").alias(name), F.col("label").alias(f"_{name}")) for name in ("a", "b"))
        fewer = edges.join(a, "a").join(b, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
        last = edges
        edges, seen = cut_measured(fewer, n=F.count("*"))
        discard(last, near)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if found is None else found

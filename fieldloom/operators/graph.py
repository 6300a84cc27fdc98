"""Connected components of an edge table, by jobs over tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.runtime import BROADCAST_CELLS, discard, materialise, sized


def roots(edges: DataFrame, cells: int) -> DataFrame:
    """node, comp (a root) of every node of ``edges`` (a, b, in both directions).

    Every node points to the smallest of itself and its neighbours; pointers are
    doubled until all of them end at nodes that point to themselves.
    """
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")), "labels")
    while True:
        known = sized(labels.select(F.col("node").alias("comp"), F.col("comp").alias("far")), cells)
        new = materialise(labels.join(known, "comp").select("node", F.col("far").alias("comp"), (F.col("far") != F.col("comp")).alias("moved")), "labels")
        discard(labels)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        labels = new


def components(edges: DataFrame, cells: int = BROADCAST_CELLS) -> DataFrame:
    """node, comp (the smallest node reachable) of every node of ``edges`` (a, b).

    In each phase nodes are gathered under ``roots``, and the edges are drawn
    anew between roots, until none is left. A root that keeps edges has a node
    below it, or a neighbour below a smaller root, under which it falls in the
    next phase. So two phases halve the nodes at least, and phases are
    logarithmic in their number whatever the order of ids along a chain. Nodes
    may be of any type that has an order. Labels
    of at most ``cells`` values reach the edges by broadcast, larger ones by
    shuffling. Null ends and loops are ignored; no edges give no rows.
    """
    clean = edges.select("a", "b").where("a is not null and b is not null and a != b")
    left = materialise(clean.union(clean.select("b", "a")).distinct(), "edges")
    phases = []
    while not phases or not left.isEmpty():
        phases.append(roots(left, cells))
        known, before = sized(phases[-1], cells), left
        for end in ("a", "b"):
            left = left.join(known.select(F.col("node").alias(end), F.col("comp").alias(f"root_{end}")), end)
        left = materialise(left.where("root_a != root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
        discard(before)
    labels = phases.pop()
    while phases:
        known = sized(labels.select(F.col("node").alias("comp"), F.col("comp").alias("now")), cells)
        labels = materialise(phases.pop().join(known, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp")), "labels")
    return labels


def merged(comp: DataFrame | None, links: DataFrame, cells: int = BROADCAST_CELLS) -> DataFrame:
    """``comp`` (node, comp) after ``links`` (a, b) between its components.

    A node that ``comp`` lacks is a component of its own. Only the links are
    searched for components; the nodes then take their component's new name.
    """
    if comp is None:
        return components(links, cells)
    if links.isEmpty():
        return comp
    top = components(links, cells)
    every = comp.union(top.select("node", F.col("node").alias("comp")))
    renamed = every.join(sized(top, cells).select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left")
    return materialise(renamed.groupBy("node").agg(F.min(F.coalesce("now", "comp")).alias("comp")), "components")

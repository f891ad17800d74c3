"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, write_between


def _hooked(links: DataFrame) -> DataFrame:
    """(node, parent): each node hooked to its lowest neighbour if that is lower than itself."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("next")))
    return both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("parent"))


def _jumped(parents: DataFrame) -> DataFrame:
    """Each node points where its parent points."""
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"))


def _shortened(parents: DataFrame) -> DataFrame:
    """Every node pointing at the root of its tree: paths halve with each jump until none is left."""
    before = None
    while True:
        parents = write_between(_jumped(_jumped(parents)), "parents")
        if before is not None:
            forget(before)
        before = parents
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        if parents.join(up, "parent").where("grand <> parent").isEmpty():
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in `links` (columns a, b); component is the lowest node.

    Each round hooks every node to its lowest neighbour, brings all paths to length one by
    pointer jumping, and replaces the ends of the links by their roots; links inside one tree
    vanish. A root that still has links is lower than all its neighbours and each neighbour
    was hooked away, so at least half of the linked nodes go in a round: the rounds grow with
    the logarithm of the nodes, the jumps with that of the longest path. Every step is
    written to the shared folder. Links with a null end, self-links and repeats count for
    nothing; an empty table gives none.
    """
    ordered = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nodes = ordered.select(F.col("a").alias("node")).unionByName(ordered.select(F.col("b").alias("node"))).distinct()
    left = write_between(ordered.where("a <> b").distinct(), "links")
    labels = write_between(nodes.select("node", F.col("node").alias("component")), "nodes")
    while not left.isEmpty():
        parents = _shortened(_hooked(left))
        a, b = (parents.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_to")) for c in ("a", "b"))
        old = left, labels
        moved = left.join(a, "a").join(b, "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        left = write_between(moved.where("a <> b").distinct(), "links")
        to = parents.select(F.col("node").alias("component"), "parent")
        labels = write_between(labels.join(to, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "nodes")
        forget(parents, *old)
    forget(left)
    return labels

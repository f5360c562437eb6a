"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that a link names; the component is its smallest node.

    Each round every node points to its smallest neighbour, if that is smaller; pointers are followed to their roots in
    doubling steps, and links between different roots are what the next round works on: half the nodes at most. Links
    are joined once a round, as they shrink; all else are joins and minima of (node, root). A node with very many links
    is reduced map-side, and its join is split. Links with a null end are ignored; no links, no rows.
    """
    known = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near"))))
    edges = materialise(known.distinct(), "edges")
    found = None
    while True:
        least = edges.select(nodes.alias("x")).groupBy("x.node").agg(F.min("x.near").alias("near"))
        root = materialise(least.select("node", F.least("node", "near").alias("root")), "roots")
        while True:
            ahead = root.select(F.col("node").alias("root"), F.col("root").alias("further"))
            step = materialise(root.join(ahead, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "roots")
            release(root)
            root = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
            root._folder = step._folder
        if found is None:
            found = step.select("node", F.col("root").alias("component"))
        else:
            further = step.select(F.col("node").alias("component"), "root")
            found = materialise(found.join(further, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")
        near = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = materialise(near.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return found


def joined_components(component: DataFrame, links: DataFrame) -> DataFrame:
    """``component`` (node, component) after more links (a, b), which may name new nodes: only links between different
    components are looked at again."""
    for end in "ab":
        links = links.join(component.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    above = connected_components(links.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    known = component.join(above.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
    fresh = above.join(component, "node", "left_anti").select("node", "component")
    return known.select("node", F.coalesce("further", "component").alias("component")).unionByName(fresh)

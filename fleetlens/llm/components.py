"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import pinned


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is the smallest node that the contraction reached, one per component.

    Each round maps every node to the smallest of itself and its neighbours (a partial aggregate, so a node with many
    links costs no more than others) and contracts the links; nodes at least halve, so rounds grow with the logarithm.
    Links stay distributed and each round is checkpointed. Self-links, repeated links and NULL ends are ignored. An
    empty table gives an empty result.
    """
    edges = edges.select("a", "b").filter("a <> b").distinct()
    edges = pinned(edges)
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = pinned(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                      .select("node", F.least("node", "least").alias("root")))
        if found is None:
            found = step
        else:
            hop = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = pinned(found.join(hop, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        edges = pinned(
            edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found

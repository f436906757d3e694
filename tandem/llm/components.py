"""Connected components of a link table by repeated contraction.

Each round sends a node to the node of its closed neighbourhood that comes
first in a hashed order, and replaces every edge by the edge of the new nodes.
The hashed order differs by round, so no numbering of the nodes makes long
chains shrink slowly: each round removes a constant share of the nodes. All
steps are joins and combinable minima; a hub with many links is pre-aggregated
before the shuffle, and its join side can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tandem.llm.common import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): one row for each node that has a link; root names its component.

    Links go both ways; links of a node with itself and repeated links change
    nothing. An empty link table gives an empty result.
    """
    edges = _tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), "links")
    labels, turn = None, 0
    while not edges.isEmpty():
        parents = stored(_first_neighbour(edges, turn), "parents")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:
            moved = parents.select(F.col("node").alias("root"), F.col("parent").alias("_next"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        edges = _tidy(
            edges.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), "links"
        )
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stored(labels, "labels")


def _tidy(edges: DataFrame, name: str) -> DataFrame:
    ordered = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(ordered.distinct(), name)


def _first_neighbour(edges: DataFrame, turn: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))
    near = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("_best"))
    return near.select("node", F.least("_best", rank("node")).getField("v").alias("parent"))

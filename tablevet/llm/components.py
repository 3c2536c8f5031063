"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablevet.sources.scratch import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of an edge ``a, b``; a component's name is its smallest node.

    A union-find in rounds: every node hooks the larger of its neighbours to the smallest
    one it knows, then every node hooks its smaller neighbours to the smallest of them, until
    the edges form one star for each component.  Each round is written to
    the shared folder, so a lost executor costs its own tasks only.  Minima are combined before
    the shuffle; a hub's edges are joined with a stored table, which Spark can split.

    Loops, repeated edges and edges in either direction are fine; a null end makes no edge.
    """
    current = _edges(edges)
    while not _are_stars(current):
        current = _round(current)
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)


def contracted(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges ``a, b`` of the same components after a fixed number of rounds, for more edges to be added."""
    current = _edges(edges)
    for _ in range(rounds):
        current = _round(current)
    return current


def joined_so_far(edges: DataFrame) -> DataFrame:
    """``node, component`` without further rounds: nodes of one name are joined, though a component may have several."""
    ends = edges.selectExpr("b AS node", "a AS component").union(edges.selectExpr("a AS node", "a AS component"))
    return ends.groupBy("node").agg(F.min("component").alias("component"))


def _edges(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return staged(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .select(low.alias("a"), high.alias("b"))
        .distinct()
    )


def _round(edges: DataFrame) -> DataFrame:
    return staged(_small_star(staged(_large_star(edges))))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v"))
    nearest = staged(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
    return both.filter("v > u").join(nearest, "u").selectExpr("m AS a", "v AS b")


def _small_star(edges: DataFrame) -> DataFrame:
    nearest = staged(edges.groupBy("b").agg(F.min("a").alias("m")))
    hooked = edges.join(nearest, "b").filter("a != m").selectExpr("m AS a", "a AS b")
    return hooked.union(nearest.selectExpr("m AS a", "b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one edge and is no smaller end: so it stays, and its smaller end is its component's least node."""
    ends = edges.selectExpr("a AS node", "1 AS as_root", "0 AS as_leaf").union(edges.selectExpr("b AS node", "0 AS as_root", "1 AS as_leaf"))
    counted = ends.groupBy("node").agg(F.max("as_root").alias("as_root"), F.sum("as_leaf").alias("as_leaf"))
    return counted.agg(F.count_if((F.col("as_leaf") > 1) | (F.col("as_leaf") > 0) & (F.col("as_root") > 0))).first()[0] == 0

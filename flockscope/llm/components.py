"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscope.llm.common import write_shared


def _seen(edges: DataFrame) -> DataFrame:
    """``(n, o)``: every node with each of its neighbours."""
    return edges.select(F.col("u").alias("n"), F.col("v").alias("o")).union(
        edges.select(F.col("v").alias("n"), F.col("u").alias("o")))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on edges ``(u, v)`` with u > v, which may repeat.

    Large: every node ties its larger neighbours to the smallest node it sees.
    Small: every node ties its smaller neighbours and itself to the smallest.
    Neither makes more edges than it gets, and one for each node.
    """
    seen = _seen(edges) if large else edges.select(F.col("u").alias("n"), F.col("v").alias("o"))
    low = seen.groupBy("n").agg(F.min("o").alias("m")).withColumn("m", F.least("m", "n"))
    tied = seen.join(low, "n")
    if large:
        return tied.where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    tied = tied.select(F.col("o").alias("u"), F.col("m").alias("v")).union(
        low.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return tied.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around their smallest nodes, which no further round changes.

    They are if every node with a smaller neighbour has that one alone and no larger one.
    """
    below = F.when(F.col("o") < F.col("n"), F.col("o"))
    sides = _seen(edges).groupBy("n").agg(F.min(below).alias("lo"), F.max(below).alias("hi"),
                                          F.bool_or(F.col("o") > F.col("n")).alias("above"))
    return not sides.agg(F.bool_or((F.col("lo") != F.col("hi")) | (F.col("lo").isNotNull() & F.col("above")))).first()[0]


def star_edges(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)`` but the roots; root = smallest node.

    Rounds repeat until the edges are stars, which the method reaches in a
    number of rounds that grows with the logarithm of the graph, so there is no
    round limit. Every round is written to the shared folder. Links may repeat;
    no links: no rows.
    """
    edges = write_shared(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    settled = edges.isEmpty()
    while not settled:
        edges = write_shared(_stars(_stars(edges, True), False), "links")
        settled = _settled(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``, the roots included (see ``star_edges``)."""
    edges = star_edges(links)
    return edges.union(edges.select(F.col("root").alias("node"), "root").distinct())

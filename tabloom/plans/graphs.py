"""Connected components by alternating stars.

A large star hangs every neighbour larger than a node on the node's smallest neighbour, a small star the
others; after a number of rounds that grows with the logarithm of the longest chain, all that is left is one
star for each component.  Only edges move: a hub's neighbours are never gathered in a row or a task, as its smallest
neighbour reaches them by broadcast where it has very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.plans.skew import join_weighted
from tabloom.session import cut_lineage


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m, n): every node's smallest neighbour or itself, and its number of edges."""
    return cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))


def _hung(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every edge's far end hung on the near end's smallest neighbour."""
    hung = join_weighted(edges, least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v")


def _print_of(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, from undirected (u, v) edges; loops name lone nodes."""
    known = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stars, before = known.where("u <> v"), None
    while (now := _print_of(stars)) != before:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _smallest(both)
        # Larger neighbours only; the smaller ones of a node are theirs to hang.
        large = cut_lineage(_hung(both.where("v > u"), least).distinct())
        least = _smallest(large)
        small = _hung(large, least).unionByName(least.select("u", F.col("m").alias("v")))
        stars, before = cut_lineage(small.distinct()), now
    nodes = known.select("u").unionByName(known.select(F.col("v").alias("u"))).distinct()
    # A node has one edge by now, to the smallest of its component.
    found = nodes.join(stars, "u", "left")
    return found.select(F.col("u").alias("id"), F.coalesce("v", "u").alias("component"))

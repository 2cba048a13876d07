"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldpulse.llm.shared import hot_join, materialize


#: So many edges have minima of at most 8 MB, 16 bytes for each of two vertices.
FEW_EDGES = 250_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _handed(many: DataFrame, least: DataFrame, small: bool) -> DataFrame:
    """``many`` with each vertex's minimum: broadcast where the edges, so the vertices too, are few; else hot vertices' alone."""
    return many.join(F.broadcast(least), "a") if small else hot_join(many, least, "a")


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Each vertex hands its larger neighbours to the least of itself and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    handed = _handed(around.filter("b > a"), least, small).select(F.col("b").alias("a"), F.col("m").alias("b"))
    # Few repeats aren't worth an exchange; the next step drops them.
    return handed if small else handed.distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """Each vertex hands itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    handed = _handed(down, least, small).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """``(v, component)`` for every vertex of the edges ``(a, b)``; the component is its least vertex.

    A round is two partial minimums and two joins, and rounds grow with the logarithm of the longest
    path. A vertex may hold a large part of all edges: its minimum is broadcast, so they stay where they are. Up to
    ``few`` edges, which are counted, all minima are. The edges are a stored table after each step; the end is seen by their
    count and checksum.
    """
    edges = materialize(edges.select("a", "b").filter("a != b").distinct(), "components")
    before, now = None, tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    while now != before:
        small = now[0] <= few
        edges = materialize(_small_star(materialize(_large_star(edges, small), "components"), small), "components")
        before, now = now, tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    return edges.select(F.col("a").alias("v"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("v"), F.col("b").alias("component"))).distinct()

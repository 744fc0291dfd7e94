"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgrid.session import settle


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of a link ``a, b``; the component is its smallest node.

    Each round hangs the larger neighbours of a node on its smallest one, then
    its smaller ones, and writes the links; stars need two rounds, chains a
    logarithmic number. Minima combine before their shuffle and the joins have
    one row per node on one side, so a node with any number of links is split.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large.where("a != b"), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least.hint("merge"), "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = settle(small, "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

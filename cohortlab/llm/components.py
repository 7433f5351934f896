"""Connected components of a link table by alternating large-star and small-star steps; each step is one grouped join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _size(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.

    ``links`` has two columns of one type, in any order and with repeats. The number of steps grows with the
    logarithm of the longest path. Every step is written to the shared folder, so a lost executor costs no more than one; the step before it is deleted.
    """
    scratch = scratch or Scratch(links.sparkSession)
    a, b = links.columns
    low, high = F.least(a, b), F.greatest(a, b)
    edges = scratch.keep(links.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    before = None
    while (now := _size(edges)) != before:
        before = now
        # large star: every larger neighbour of u is hung on the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are hung on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now_edges = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(edges)
        edges = now_edges
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

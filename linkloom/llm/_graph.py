"""Connected components of an edge table, without the driver seeing edges or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._stage import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of `edges(a, b)`.

    Alternates large-star and small-star steps until the edge set stands still.  Minima are
    combined before each shuffle, so a node with very many neighbours is no hot group.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "low", "a")
        small = small.select(F.col("x").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        before_this, edges = edges, staged(small, "edges")
        discard(before_this)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

"""Connected components of a large graph by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the component's smallest node) for each node that isn't a root; ``edges``: a, b with a > b.

    Each round writes its edges, so no lineage grows, and their number never exceeds the first one's. Minima are
    pre-aggregated; joins meet a hot node on one side only, which Spark splits.
    """
    edges = stage(edges, "edges")
    before = _mark(edges)
    while before[0]:
        edges = stage(_small(_large(edges)), "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written

MAX_ROUNDS = 100


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `links`; the component is its smallest node.

    Alternating large-star and small-star rounds.  The smallest neighbour is a pre-aggregated minimum
    joined back to the links, so no node's neighbours are gathered anywhere and a node with any number
    of links is only a skewed join key.  Links with a null end and self-links are left out.  Every round
    is a table in the shared folder, and a round's tables go when the next one is written.
    """
    edges = written(_ordered(links.select(F.col(a).alias("u"), F.col(b).alias("v")), "u", "v"), "cc-edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        large = written(_ordered(_star(_both(edges), larger=True), "u", "v"), "cc-large")
        small = written(_ordered(_star(large, larger=False), "u", "v"), "cc-small")
        discard(edges, large)
        edges = small
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            # all stars: every link leads from the component's smallest node
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
                edges.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
        seen = now
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links with u < v."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours on the smallest neighbour: the larger ones (of links in both directions), or all
    smaller ones and the node itself (of links u < v)."""
    if larger:
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return edges.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v")
    low = edges.groupBy("v").agg(F.min("u").alias("m"))
    hung = edges.join(low, "v").select(F.col("m"), F.col("u"), F.col("v"))
    return hung.select(F.col("m").alias("u"), F.col("u").alias("v")).union(
        hung.select(F.col("m").alias("u"), F.col("v").alias("v")))

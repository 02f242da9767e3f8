"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import write_once


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every neighbour of a node (larger ones, or smaller ones with the node) points at the least of them.

    The minimum is a map-side aggregate, so a node with very many neighbours costs one row for each task; the join back
    has no aggregate above it, so adaptive execution may cut such a node's rows.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns node and root (the smallest node reachable) of every node that ``links`` (u, v: longs) names.

    Links with a null end or equal ends say nothing. Repeated links count once. Each round's table is written to the
    shared scratch folder, so a lost executor costs one round at most. Rounds grow with the logarithm of the longest
    chain; the loop ends when a round changes nothing and raises if ``most_rounds`` were not enough.
    """
    edges = write_once(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        wide = write_once(_star(edges, large=True).distinct(), "star")
        edges = write_once(_star(wide, large=False).distinct(), "star")
        # Order-free digest of the edge set: unchanged over a whole round means every component is one star.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

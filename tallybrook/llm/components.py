"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import staged, unstage


def _hung(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) with v < u."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the larger (or smaller) neighbours of each node below the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("__m")).select(F.col("u").alias("__u"), F.least("__m", "u").alias("m"))
    near = both.join(least, F.col("u") == F.col("__u"))
    if large:
        return _hung(near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return _hung(near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("__u").alias("u"), F.col("m").alias("v"))))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (columns u, v); a component is named by its least node.

    Self-links and repeated links don't matter; without links there are no rows. The table of links stays distributed and is
    written to the shared folder each round; only its row count and a checksum reach the driver.
    """
    edges, state = staged(_hung(links), "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now or not now[0]:
            break
        state, old = now, edges
        edges = staged(_star(staged(_star(old, True), "links"), False), "links")
        unstage(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

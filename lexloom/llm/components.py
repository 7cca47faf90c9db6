"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Every node hangs its larger (large) or its other smaller neighbours (small) on its smallest neighbour or itself."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """`links` has longs a and b; returns (node, component), the component being its smallest node, for linked nodes.

    The number of rounds grows with the logarithm of the longest path. Hot nodes do not gather their neighbours: each
    round is a partial aggregate (the smallest neighbour) and a join on the node, which adaptive execution may split.
    Nulls and self-links are left out; without links the result is empty."""
    now = settled(links.filter("a != b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), name)
    while True:
        after = settled(_stars(_stars(now, True), False), name)
        # Finished when the stars are flat: each node has one centre, and no centre hangs on another.
        ends = after.select("a", F.lit(1).alias("up"), F.lit(0).alias("centre")).unionByName(after.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("centre")))
        if not ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).filter("up > 1 or up = 1 and centre = 1").limit(1).count():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        now = after

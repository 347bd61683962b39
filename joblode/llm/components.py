"""Connected components of links between numbered nodes, as joins and grouped minima.

Alternates large-star and small-star steps: every node hands its smallest known
neighbour on. Each step is a grouped minimum, which is combined before the
shuffle, and a join that Spark may split, so a node with a third of all links
is no single task's work. Links are written after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.session import staged


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links (u, v) with each v tied to the least node that its u knows. ``links``: u > v, no repeats."""
    if small:  # neighbours at most as large as the node
        near = links.select("u", "v")
        least = near.groupBy("u").agg(F.min("v").alias("least"))
        moved = near.join(least, "u")
        out = moved.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            moved.select("u", F.col("least").alias("v")))
    else:  # larger neighbours
        near = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        out = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node of its component for each node that has a link and is not the least.

    ``links``: (u, v), in any order and number.
    """
    links = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .filter("u <> v").distinct(), "links")
    before = None
    while True:
        links = staged(_star(_star(links, False), True), "links")
        # Sums over all links: equal sums of hashes in two rounds mean that no link has moved.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("least"))
        before = now

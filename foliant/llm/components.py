"""Connected components of a link table: alternating large and small stars, stored after every round.

No node, link or component goes to the driver; it sees one count and checksum per round. A node with very many links
is grouped by a minimum, which is combined before the shuffle, and joined back, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a AND b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them. ``a < b`` in ``edges``."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    kept = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.unionByName(kept).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component`` (smallest node it reaches) for every node that has a link to another node.

    NULL ends and links of a node to itself are no links; an empty table gives an empty result. Ids may be numbers or
    strings.
    """
    ordered = edges.where(F.col(left) != F.col(right)).select(
        F.least(left, right).alias("a"), F.greatest(left, right).alias("b")
    )
    now, before = written(ordered.distinct(), "links"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        before = state
        now = written(_small_star(_large_star(now)), "stars")

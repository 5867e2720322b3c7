"""The collection tree: depth and path, closure and member counts, by joins that double their reach and are stored each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import written


def collection_tree(collections: DataFrame, separator: str = "/") -> DataFrame:
    """Depth and name path of every collection below a root; orphans and cycles are left out.

    Every collection points at an ancestor and holds the names in between. A round joins it with that ancestor, which doubles
    the reach, so the number of rounds follows the logarithm of the depth. What still points somewhere after as many rounds as
    the number of collections allows hangs on a cycle.
    """
    start = collections.select("id", "name", "parent_id", F.col("parent_id").alias("up"), F.lit(0).alias("depth"), F.col("name").alias("path"))
    rows = written(start, "tree")
    rounds = rows.count().bit_length()
    for _ in range(rounds):
        if rows.where("up IS NOT NULL").isEmpty():
            break
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        longer = rows.where("up IS NOT NULL").join(above, "up").select(
            "id", "name", "parent_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth") + 1).alias("depth"),
            F.concat("_path", F.lit(separator), "path").alias("path"),
        )
        rows = written(rows.where("up IS NULL").unionByName(longer), "tree")
    return rows.where("up IS NULL").drop("up")


def collection_closure(collections: DataFrame) -> DataFrame:
    """(ancestor, descendant) pairs, each collection being its own descendant, as a stored table.

    Pairs are joined with themselves, which doubles their depth, until no new pair appears; so the number of rounds
    follows the logarithm of the depth, and cycles end. Build it once per snapshot of the collections.
    """
    own = collections.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"))
    known = collections.select("id")
    edges = collections.where(F.col("parent_id").isNotNull()).join(known.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi")
    pairs = written(own.unionByName(edges.select(F.col("parent_id").alias("ancestor"), F.col("id").alias("descendant"))).distinct(), "closure")
    size = pairs.count()
    while True:
        lower = pairs.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("_below"))
        pairs = written(pairs.join(lower, "descendant").select("ancestor", F.col("_below").alias("descendant")).distinct(), "closure")
        grown = pairs.count()
        if grown == size:
            return pairs
        size = grown


def subtree(closure: DataFrame, root_id: int) -> DataFrame:
    """Ids of one collection and everything below it, from the stored closure."""
    return closure.where(F.col("ancestor") == root_id).select(F.col("descendant").alias("id"))


def collection_counts(papers: DataFrame, collections: DataFrame) -> DataFrame:
    """Papers per collection: direct members, and members of the whole subtree."""
    member = papers.select("id", F.explode("collection_ids").alias("descendant")).distinct()
    pairs = member.join(collection_closure(collections), "descendant")
    return pairs.groupBy(F.col("ancestor").alias("collection_id")).agg(
        F.count_if(F.col("ancestor") == F.col("descendant")).alias("direct"),
        F.countDistinct("id").alias("with_descendants"),
    )

"""Existence tests and deduplication. Rows without a key never match anything and are never merged.

A key may be very common on the side of the rows (one DOI printed in a third of all documents). The other side of
these joins is a stored table with one row per key, read right before the join: then adaptive execution can split the
rows of a common key over many tasks. An aggregate directly below the join would prevent that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import written


def _spread(key: str, row_id: str) -> Column:
    """Join key that gives each row without a value a key of its own, so that they do not all meet in one task."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col(row_id).cast("string")))


def lookup(rows: DataFrame, table: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left join on a text key that is NULL in many rows. ``table`` has one row per key."""
    right = table.withColumnRenamed(key, "_key")
    return rows.withColumn("_key", _spread(key, row_id)).join(right, "_key", "left").drop("_key")


def without(rows: DataFrame, table: DataFrame, key: str, row_id: str) -> DataFrame:
    """Rows whose key is not in ``table``; rows without a key stay."""
    right = table.select(F.col(key).alias("_key"))
    return rows.withColumn("_key", _spread(key, row_id)).join(right, "_key", "left_anti").drop("_key")


def known(table: DataFrame, key: str, flag: str) -> DataFrame:
    """The keys of a table, which are unique in it, with a flag for ``lookup``."""
    return table.where(F.col(key).isNotNull()).select(key, F.lit(True).alias(flag))


def new_by_doi(items: DataFrame, papers: DataFrame, row_id: str = "seq", fold_case: bool = False) -> DataFrame:
    """Items whose DOI is not in the library; the test is exact unless ``fold_case`` is set."""
    if not fold_case:
        return without(items, papers, "doi", row_id)
    folded = items.withColumn("_doi", F.lower("doi"))
    return without(folded, papers.select(F.lower("doi").alias("_doi")), "_doi", row_id).drop("_doi")


def new_by_path(items: DataFrame, papers: DataFrame, row_id: str = "seq") -> DataFrame:
    return without(items, papers, "file_path", row_id)


def mark_repeats(items: DataFrame, key: str = "doi", order: str = "seq", flag: str = "repeat") -> DataFrame:
    """Flag every row after the first with the same key.

    Firsts are found by a pre-aggregated minimum, and only keys that do repeat are joined back.
    """
    counted = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    firsts = written(counted.where(F.col("_n") > 1).drop("_n"), "repeated")
    rows = lookup(items, firsts, key, order)
    return rows.withColumn(flag, F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def dedupe_batch(items: DataFrame, key: str = "doi", order: str = "seq") -> DataFrame:
    return mark_repeats(items, key, order, "_repeat").where(~F.col("_repeat")).drop("_repeat")


def skip_processed(items: DataFrame, processed: DataFrame, key: str = "item", row_id: str = "seq") -> DataFrame:
    return without(items, processed, key, row_id)


def unique_violations(papers: DataFrame) -> DataFrame:
    """(id, field) of rows that share a DOI or a path with an earlier row and would be refused."""
    parts = [
        mark_repeats(papers.select("id", field), field, "id", "again")
        .where("again")
        .select("id", F.lit(field).alias("field"))
        for field in ("doi", "file_path")
    ]
    return parts[0].unionByName(parts[1])

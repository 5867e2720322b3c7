"""Counts and distinct lists over the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("succeeded", "needs_review", "failed", "duplicate")


def paper_count(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("*").alias("papers"))


def needs_review_count(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count_if("needs_review").alias("needs_review"))


def all_tags(papers: DataFrame) -> DataFrame:
    return papers.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def all_ids(papers: DataFrame) -> DataFrame:
    return papers.select("id").orderBy("id")


def all_paths(papers: DataFrame) -> DataFrame:
    return papers.select("file_path")


def library_status(papers: DataFrame, indexed: DataFrame) -> DataFrame:
    """The three counts in one row, from one pass over each table."""
    lib = papers.select(F.lit(1).alias("p"), F.col("needs_review").cast("int").alias("r"), F.lit(0).alias("i"))
    docs = indexed.select(F.lit(0).alias("p"), F.lit(0).alias("r"), F.lit(1).alias("i"))
    both = lib.unionByName(docs)
    zero = F.lit(0)
    return both.agg(
        F.coalesce(F.sum("p"), zero).alias("papers"),
        F.coalesce(F.sum("r"), zero).alias("needs_review"),
        F.coalesce(F.sum("i"), zero).alias("indexed"),
    )


def import_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of one import. A paper that needs review also counts as succeeded."""
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.agg(
        F.count("outcome").alias("done"),
        F.count("*").alias("total"),
        F.count_if(F.col("outcome").isin("succeeded", "needs_review")).alias("succeeded"),
        is_("needs_review").alias("needs_review"),
        is_("failed").alias("failed"),
        is_("duplicate").alias("duplicates"),
    )


def reason_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'failed'").groupBy("reason").agg(F.count("*").alias("n"))

"""Library tables as DataFrames, made from the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.tree import collection_closure
from foliant.plans.views import view
from foliant.sources.schema import PAPER_COLUMNS


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "papers_v")
    return raw.withColumn("collection_ids", F.array(F.col("collection_id").cast("bigint"))).select(*PAPER_COLUMNS)


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "collections_v")


_CLOSURES: dict[tuple[str, str], DataFrame] = {}


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored closure of the collections, built once per application like the index."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CLOSURES:
        _CLOSURES[key] = collection_closure(collections(spark, sf_dir))
    return _CLOSURES[key]


def books(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Both book sources; short ISBNs repeat in the first source of a large library."""
    return [view(spark, sf_dir, "book_records_a_v"), view(spark, sf_dir, "book_records_b_v")]


def flat(papers_like: DataFrame) -> DataFrame:
    """Lists joined to text, so that results compare as scalars."""
    lists = {c: F.array_join(F.col(c), ";") for c in ("authors", "keywords", "tags") if c in papers_like.columns}
    if "collection_ids" in papers_like.columns:
        lists["collection_ids"] = F.array_join(F.col("collection_ids").cast("array<string>"), ";")
    return papers_like.withColumns(lists)


#: The oracle's view of a whole paper row, lists joined to text.
FLAT_PAPER = """id, doi, title, array_to_string(authors, ';') AS authors, journal, year, volume, issue, pages, abstract,
  array_to_string(keywords, ';') AS keywords, array_to_string(tags, ';') AS tags, CAST(collection_id AS STRING) AS collection_ids,
  file_path, date_added, date_modified, metadata_source, needs_review, open_access, isbn, document_type"""
SLIM_PAPER = FLAT_PAPER.replace("abstract,\n  array_to_string(keywords, ';') AS keywords, ", "")

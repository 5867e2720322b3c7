"""Filters, listings and orderings over the paper table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.naming import base_name
from foliant.functions.text import first_filled, strip_ws
from foliant.operators.tree import subtree

HEAVY_COLUMNS = ("abstract", "keywords")


@dataclass(frozen=True)
class Filters:
    """The optional restrictions of a listing or search. ``0`` and ``None`` are no bound."""

    year_from: int | None = None
    year_to: int | None = None
    journal: str | None = None
    tags: tuple[str, ...] = ()
    collection_id: int | None = None
    needs_review_only: bool = False
    document_type: str | None = None


def by_year(papers: DataFrame, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    if year_from:
        papers = papers.where(F.col("year") >= year_from)
    if year_to:
        papers = papers.where(F.col("year") <= year_to)
    return papers


def by_journal(papers: DataFrame, part: str) -> DataFrame:
    """Contains, ignoring case; ``%`` and ``_`` act as wildcards."""
    literal = part.replace("\\", "\\\\")
    return papers.where(F.col("journal").ilike(f"%{literal}%"))


def by_review(papers: DataFrame) -> DataFrame:
    return papers.where("needs_review")


def by_type(papers: DataFrame, document_type: str) -> DataFrame:
    return papers.where(F.col("document_type") == document_type)


def by_any_tag(papers: DataFrame, tags: list[str] | tuple[str, ...]) -> DataFrame:
    return papers.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


def by_subtree(papers: DataFrame, closure: DataFrame, collection_id: int) -> DataFrame:
    """Papers in a collection or in any collection below it. ``closure`` is the stored one of the snapshot.

    The test of a paper's list against the subtree is a semi-join on its members; no job runs while it is planned.
    """
    member = papers.select("id", F.explode("collection_ids").alias("_c"))
    below = subtree(closure, collection_id).withColumnRenamed("id", "_c")
    return papers.join(member.join(below, "_c", "left_semi").select("id"), "id", "left_semi")


def apply_filters(papers: DataFrame, filters: Filters, closure: DataFrame | None = None) -> DataFrame:
    papers = by_year(papers, filters.year_from, filters.year_to)
    if filters.journal:
        papers = by_journal(papers, filters.journal)
    if filters.needs_review_only:
        papers = by_review(papers)
    if filters.document_type is not None:
        papers = by_type(papers, filters.document_type)
    if filters.tags:
        papers = by_any_tag(papers, filters.tags)
    if filters.collection_id is not None:
        if closure is None:
            raise ValueError("a collection filter needs the closure of the collections")
        papers = by_subtree(papers, closure, filters.collection_id)
    return papers


def newest_first(papers: DataFrame) -> DataFrame:
    return papers.orderBy(F.desc("date_added"), "id")


def list_slim(papers: DataFrame) -> DataFrame:
    """Every paper without its long texts, newest first."""
    return newest_first(papers.drop(*HEAVY_COLUMNS))


def page_of_papers(papers: DataFrame, offset: int, limit: int) -> DataFrame:
    return newest_first(papers).offset(offset).limit(limit)


def get_by_ids(papers: DataFrame, wanted: DataFrame, slim: bool = False) -> DataFrame:
    """Papers of a (pos, id) list in list order; ids without a paper are dropped."""
    rows = papers.drop(*HEAVY_COLUMNS) if slim else papers
    return wanted.select("pos", "id").join(rows, "id").orderBy("pos")


def sort_listing(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Order as the columns of the result list do; ordering by authors changes nothing."""
    if key == "authors":
        return rows
    columns = {
        "title": F.lower("title"),
        "journal": F.lower("journal"),
        "year": F.coalesce(F.col("year"), F.lit(0)),
    }
    if key == "score":
        columns["score"] = F.coalesce(F.col("score"), F.lit(0.0))
    order = columns[key]
    return rows.orderBy(order.desc() if descending else order.asc(), "id")


def family_names(authors: Column) -> Column:
    """First two family names, with ``et al.`` for longer lists."""
    short = F.array_join(F.transform(F.slice(authors, 1, 2), lambda a: strip_ws(F.substring_index(a, ",", 1))), ", ")
    return F.when(F.size(authors) > 2, F.concat(short, F.lit(" et al."))).otherwise(short)


def display_rows(papers: DataFrame) -> DataFrame:
    year = F.when(F.coalesce(F.col("year"), F.lit(0)) == 0, F.lit("")).otherwise(F.col("year").cast("string"))
    return papers.select(
        "id",
        first_filled(F.col("title"), base_name(F.col("file_path"))).alias("title"),
        family_names(F.col("authors")).alias("authors"),
        "journal",
        year.alias("year"),
    )

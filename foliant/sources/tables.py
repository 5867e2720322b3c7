"""Readers and writers of the library tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import filled, strip_ws
from foliant.sources.schema import COLLECTIONS, PAPER_COLUMNS, PAPERS

_JSON_LISTS = {
    "authors": "array<string>",
    "keywords": "array<string>",
    "tags": "array<string>",
    "collection_ids": "array<bigint>",
}


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAPERS).parquet(path)


def decode_papers(raw: DataFrame) -> DataFrame:
    """Paper rows from the stored form: lists as JSON text, flags as 0/1, the two late columns maybe absent."""
    defaults: dict[str, Column] = {"isbn": F.lit(None).cast("string"), "document_type": F.lit("article")}
    out = []
    for name in PAPER_COLUMNS:
        if name not in raw.columns:
            col = defaults[name]
        elif name in _JSON_LISTS:
            empty = F.array().cast(_JSON_LISTS[name])
            col = F.coalesce(F.from_json(F.col(name), _JSON_LISTS[name]), empty)
        elif name in ("needs_review", "open_access"):
            col = F.coalesce(F.col(name), F.lit(0)) != 0
        elif name == "document_type":
            col = F.coalesce(F.col(name), defaults[name])
        else:
            col = F.col(name)
        out.append(col.alias(name))
    return raw.select(*out)


def encode_papers(papers: DataFrame) -> DataFrame:
    """The stored form of paper rows."""
    lists = {c: F.to_json(c) for c in _JSON_LISTS}
    flags = {c: F.col(c).cast("int") for c in ("needs_review", "open_access")}
    return papers.withColumns({**lists, **flags})


def write_papers(papers: DataFrame, path: str, now: str) -> DataFrame:
    """Write a new snapshot. ``now`` stamps the whole batch; an existing ``date_added`` is kept."""
    stamped = papers.withColumns(
        {"date_added": F.coalesce(filled(F.col("date_added")), F.lit(now)), "date_modified": F.lit(now)}
    )
    stamped.write.parquet(path)
    return read_papers(papers.sparkSession, path)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    return by_name(spark.read.schema(COLLECTIONS).parquet(path))


def by_name(collections: DataFrame) -> DataFrame:
    return collections.select("id", "name", "parent_id").orderBy("name", "id")


def read_import_list(spark: SparkSession, path: str, mode: str) -> DataFrame:
    return import_list(spark.read.text(path), mode)


def import_list(lines: DataFrame, mode: str) -> DataFrame:
    """One item per line, trimmed, blank lines dropped."""
    if mode not in ("pdfs", "dois", "urls"):
        raise ValueError(f"unknown import mode {mode}")
    item = strip_ws(F.col("value"))
    return lines.withColumn("item", item).where("item <> ''").drop("value").withColumn("mode", F.lit(mode))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id BIGINT, url STRING, html STRING").parquet(path)


def category_list(categories: DataFrame) -> DataFrame:
    """Categories with a name; the description falls back to the name."""
    name = strip_ws(F.col("name"))
    text = F.coalesce(filled(strip_ws(F.col("description"))), name)
    return categories.withColumns({"name": name, "description": text}).where("name <> ''")

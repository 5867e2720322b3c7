"""Queries over loading, filters, listings and orderings (inventory A1, A2, A4-A6, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import listing as op
from foliant.plans.inputs import FLAT_PAPER, SLIM_PAPER, closure, collections, flat, papers
from foliant.plans.registry import query
from foliant.plans.views import spark_sql, table, view
from foliant.sources import tables

_SLIM = "id, doi, title, journal, year, date_added"
_SHORT = ["id", "doi", "title", "journal", "year", "date_added"]


@query("load_papers", f"SELECT {FLAT_PAPER} FROM papers_v")
def load_papers(spark, sf_dir):
    stored = tables.encode_papers(papers(spark, sf_dir)).drop("isbn")
    return flat(tables.decode_papers(stored))


@query("load_collections", "SELECT id, name, parent_id FROM collections_v ORDER BY name")
def load_collections(spark, sf_dir):
    return tables.by_name(collections(spark, sf_dir))


@query("load_pages", "SELECT page_id, url, html FROM @pages")
def load_pages(spark, sf_dir):
    return tables.read_pages(spark, f"{sf_dir}/pages.parquet")


_LINES = """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '   ' WHEN event_id % 7 = 1 THEN '' ELSE concat('  10.1234/abc.', CAST(user_id AS STRING), ' ') END AS value
FROM @events
"""


@query("load_import_list", f"SELECT event_id, trim(value) AS item, 'dois' AS mode FROM ({_LINES}) t WHERE trim(value) <> ''")
def load_import_list(spark, sf_dir):
    return tables.import_list(spark_sql(spark, sf_dir, _LINES), "dois")


_CATEGORIES = """
SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN '  ' ELSE concat(' cat', CAST(label AS STRING)) END AS name,
  CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN ' ' ELSE concat(' about ', CAST(label AS STRING), ' ') END AS description
FROM @embeddings
"""


@query("load_categories", f"""
SELECT vec_id, trim(name) AS name, coalesce(nullif(trim(description), ''), trim(name)) AS description
FROM ({_CATEGORIES}) t WHERE trim(name) <> ''
""")
def load_categories(spark, sf_dir):
    return tables.category_list(spark_sql(spark, sf_dir, _CATEGORIES))


@query("filter_year", f"SELECT {_SLIM} FROM papers_v WHERE year >= 2000 AND year <= 2010")
def filter_year(spark, sf_dir):
    return op.by_year(papers(spark, sf_dir), 2000, 2010).select(*_SHORT)


@query("filter_journal", f"SELECT {_SLIM} FROM papers_v WHERE journal ILIKE '%OF s_c1%'")
def filter_journal(spark, sf_dir):
    return op.by_journal(papers(spark, sf_dir), "OF s_c1").select(*_SHORT)


@query("filter_needs_review", f"SELECT {_SLIM} FROM papers_v WHERE needs_review")
def filter_needs_review(spark, sf_dir):
    return op.by_review(papers(spark, sf_dir)).select(*_SHORT)


@query("filter_document_type", f"SELECT {_SLIM} FROM papers_v WHERE document_type = 'book'")
def filter_document_type(spark, sf_dir):
    return op.by_type(papers(spark, sf_dir), "book").select(*_SHORT)


@query("filter_tags_any", f"SELECT {_SLIM} FROM papers_v WHERE list_has_any(tags, ['tag3', 'fr'])")
def filter_tags_any(spark, sf_dir):
    return op.by_any_tag(papers(spark, sf_dir), ["tag3", "fr"]).select(*_SHORT)


SUBTREE = """
WITH RECURSIVE below AS (SELECT CAST({root} AS BIGINT) AS id UNION
  SELECT c.id FROM collections_v c JOIN below b ON c.parent_id = b.id)
"""


@query("filter_collection_subtree", SUBTREE.format(root=3) + f"SELECT {_SLIM} FROM papers_v WHERE collection_id IN (SELECT id FROM below)")
def filter_collection_subtree(spark, sf_dir):
    return op.by_subtree(papers(spark, sf_dir), closure(spark, sf_dir), 3).select(*_SHORT)


@query("list_slim", f"SELECT {SLIM_PAPER} FROM papers_v ORDER BY date_added DESC, id")
def list_slim(spark, sf_dir):
    return flat(op.list_slim(papers(spark, sf_dir)))


@query("get_by_ids", f"""
SELECT pos, {FLAT_PAPER} FROM papers_v JOIN (SELECT 1000000000 - doc_id AS pos, doc_id + 1000000000 * toxic AS wanted FROM @labels) w ON wanted = id
ORDER BY pos
""")
def get_by_ids(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").select(
        (F.lit(1000000000) - F.col("doc_id")).alias("pos"), (F.col("doc_id") + 1000000000 * F.col("toxic")).alias("id")
    )
    return flat(op.get_by_ids(papers(spark, sf_dir), wanted))


@query("page_of_papers", f"SELECT {_SLIM} FROM papers_v ORDER BY date_added DESC, id LIMIT 50 OFFSET 100")
def page_of_papers(spark, sf_dir):
    return op.page_of_papers(papers(spark, sf_dir), 100, 50).select(*_SHORT)


@query("sort_listing", f"SELECT {_SLIM} FROM papers_v ORDER BY coalesce(year, 0) DESC, id")
def sort_listing(spark, sf_dir):
    return op.sort_listing(papers(spark, sf_dir), "year", descending=True).select(*_SHORT)


@query("display_row", r"""
SELECT id, coalesce(nullif(title, ''), regexp_extract(file_path, '[^/]*$')) AS title,
  concat(array_to_string(list_transform(authors[1:2], lambda a: trim(string_split(a, ',')[1])), ', '),
         CASE WHEN len(authors) > 2 THEN ' et al.' ELSE '' END) AS authors,
  journal, CASE WHEN coalesce(year, 0) = 0 THEN '' ELSE CAST(year AS STRING) END AS year
FROM papers_v
""")
def display_row(spark, sf_dir):
    return op.display_rows(papers(spark, sf_dir))


@query("load_fulltext_pages", "SELECT id, len(page_texts) AS n_pages, length(array_to_string(page_texts, chr(10))) AS n_chars FROM fulltext_v")
def load_fulltext_pages(spark, sf_dir):
    pages = view(spark, sf_dir, "fulltext_v")
    return pages.select(
        "id",
        F.size("page_texts").cast("bigint").alias("n_pages"),
        F.length(F.array_join("page_texts", "\n")).cast("bigint").alias("n_chars"),
    )

"""Queries over deduplication and resolution against bulk records (inventory D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import dedupe, identifiers, resolve
from foliant.operators import pages as web
from foliant.operators import titles as title_op
from foliant.plans.identifiers import FULLTEXT_DOI, FULLTEXT_ISBN, JUNK, ws, year_of
from foliant.plans.inputs import FLAT_PAPER, books, flat, papers
from foliant.plans.pages import PAGE_METADATA
from foliant.plans.registry import query
from foliant.plans.views import spark_sql, view
from foliant.session import written

_INCOMING = """SELECT seq, nullif(item, '10.1234/abc.7') AS doi, concat('/lib/src', CAST(seq % 10 AS STRING), '/', CAST(seq % 700 AS STRING), '.pdf') AS file_path FROM import_queue_v"""


@query("new_by_doi", f"SELECT seq, doi FROM ({_INCOMING}) q WHERE doi IS NULL OR doi NOT IN (SELECT doi FROM papers_v WHERE doi IS NOT NULL)")
def new_by_doi(spark, sf_dir):
    return dedupe.new_by_doi(spark_sql(spark, sf_dir, _INCOMING), papers(spark, sf_dir)).select("seq", "doi")


@query("new_by_path", f"SELECT seq, file_path FROM ({_INCOMING}) q WHERE file_path NOT IN (SELECT file_path FROM papers_v)")
def new_by_path(spark, sf_dir):
    return dedupe.new_by_path(spark_sql(spark, sf_dir, _INCOMING), papers(spark, sf_dir)).select("seq", "file_path")


@query("dedupe_batch", f"""
SELECT seq, doi FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY seq) AS n FROM ({_INCOMING}) q) t WHERE doi IS NULL OR n = 1
""")
def dedupe_batch(spark, sf_dir):
    return dedupe.dedupe_batch(spark_sql(spark, sf_dir, _INCOMING)).select("seq", "doi")


@query("skip_processed", "SELECT seq, item FROM import_queue_v WHERE item NOT IN (SELECT doi FROM papers_v WHERE doi IS NOT NULL)")
def skip_processed(spark, sf_dir):
    done = papers(spark, sf_dir).where("doi IS NOT NULL").select(F.col("doi").alias("item"))
    return dedupe.skip_processed(view(spark, sf_dir, "import_queue_v"), done).select("seq", "item")


_CLASHING = """
SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('10.1/', lang, CAST(n_chars % 400 AS STRING)) END AS doi,
  concat('/lib/', source, CAST(doc_id % 90 AS STRING)) AS file_path FROM @documents
"""


@query("unique_violations", f"""
SELECT id, 'doi' AS field FROM (SELECT id, doi, row_number() OVER (PARTITION BY doi ORDER BY id) AS n FROM ({_CLASHING}) a) t WHERE doi IS NOT NULL AND n > 1
UNION ALL SELECT id, 'file_path' FROM (SELECT id, row_number() OVER (PARTITION BY file_path ORDER BY id) AS n FROM ({_CLASHING}) b) u WHERE n > 1
""")
def unique_violations(spark, sf_dir):
    return dedupe.unique_violations(spark_sql(spark, sf_dir, _CLASHING))


# --- records -------------------------------------------------------------------------------------------------

_TYPE = """CASE WHEN {t} IN ('book', 'monograph', 'reference-book', 'edited-book', 'book-set') THEN 'book'
  WHEN {t} IN ('book-chapter', 'book-section', 'book-part', 'book-track') THEN 'book-chapter'
  WHEN {t} = 'proceedings-article' THEN 'proceedings' ELSE 'article' END"""
META_COLUMNS = "doi, title, authors, journal, year, volume, issue, pages, abstract, keywords, metadata_source, needs_review, isbn, document_type"
_AUTHORS = """list_filter(list_transform(CAST(m->'$.author' AS JSON[]), lambda a: CASE WHEN coalesce(a->>'$.family', '') <> ''
  THEN trim(concat(a->>'$.family', ', ', coalesce(a->>'$.given', '')), ', ') ELSE coalesce(a->>'$.given', '') END), lambda x: x <> '')"""
ARTICLES = f"""
art AS MATERIALIZED (SELECT doi, title, array_to_string(a, ';') AS authors, journal, year, volume, issue, pages, abstract, keywords,
    'crossref' AS metadata_source, (title = '' OR len(a) = 0) AS needs_review, coalesce(list_filter(i, lambda x: x LIKE '978%' OR x LIKE '979%')[1], i[1]) AS isbn,
    {_TYPE.format(t='kind')} AS document_type
  FROM (SELECT doi, coalesce(m->>'$.title[0]', '') AS title, {_AUTHORS} AS a,
      coalesce(m->>'$.container-title[0]', m->>'$.publisher', '') AS journal, CAST(m->>'$.published.date-parts[0][0]' AS INT) AS year,
      coalesce(m->>'$.volume', '') AS volume, coalesce(m->>'$.issue', '') AS issue, coalesce(m->>'$.page', '') AS pages,
      {ws("regexp_replace(coalesce(m->>'$.abstract', ''), '<[^>]+>', '', 'g')")} AS abstract,
      array_to_string(CAST(m->'$.subject' AS VARCHAR[]), ';') AS keywords, lower(m->>'$.type') AS kind,
      list_transform(CAST(m->'$.ISBN' AS VARCHAR[]), lambda x: replace(replace(upper(x), '-', ''), ' ', '')) AS i
    FROM (SELECT doi, CAST(record AS JSON)->'$.message' AS m FROM article_records_v) r) p)
"""
_BOOK_REST = "'' AS volume, '' AS issue"
BOOKS = f"""
book_a AS (SELECT min(record) AS record, isbn FROM book_records_a_v GROUP BY isbn),
book_b AS (SELECT min(record) AS record, isbn FROM book_records_b_v GROUP BY isbn),
books AS MATERIALIZED (
  SELECT CAST(NULL AS VARCHAR) AS doi, concat(v->>'$.title', CASE WHEN coalesce(v->>'$.subtitle', '') <> '' THEN concat(': ', v->>'$.subtitle') ELSE '' END) AS title,
    array_to_string(list_filter(list_transform(CAST(v->'$.authors' AS JSON[]), lambda a: a->>'$.name'), lambda x: x <> ''), ';') AS authors,
    coalesce(v->>'$.publishers[0].name', '') AS journal, {year_of("v->>'$.publish_date'")} AS year, {_BOOK_REST},
    coalesce(nullif(v->>'$.number_of_pages', '0'), '') AS pages,
    {ws("regexp_replace(CASE WHEN json_type(v->'$.description') = 'OBJECT' THEN v->>'$.description.value' ELSE v->>'$.description' END, '<[^>]+>', '', 'g')")} AS abstract,
    array_to_string(list_transform(CAST(v->'$.subjects' AS JSON[]), lambda s: CASE WHEN json_type(s) = 'OBJECT' THEN s->>'$.name' ELSE s->>'$' END)[1:20], ';') AS keywords,
    'openlibrary' AS metadata_source, FALSE AS needs_review, isbn, 'book' AS document_type
  FROM (SELECT isbn, CAST(record AS JSON) AS v FROM book_a)
  UNION ALL
  SELECT NULL, v->>'$.title', array_to_string(CAST(v->'$.authors' AS VARCHAR[]), ';'), v->>'$.publisher', {year_of("v->>'$.publishedDate'")}, '', '',
    coalesce(nullif(v->>'$.pageCount', '0'), ''), {ws("regexp_replace(v->>'$.description', '<[^>]+>', '', 'g')")},
    array_to_string(CAST(v->'$.categories' AS VARCHAR[]), ';'), 'googlebooks', FALSE, isbn, 'book'
  FROM (SELECT isbn, CAST(record AS JSON)->'$.items[0].volumeInfo' AS v FROM book_b) WHERE isbn NOT IN (SELECT isbn FROM book_a))
"""
OA = """
oa AS (SELECT doi, coalesce(nullif(CAST(record AS JSON)->>'$.best_oa_location.url_for_pdf', ''),
  nullif(CAST(record AS JSON)->>'$.best_oa_location.url', '')) AS oa_url FROM oa_records_v)
"""
GUESS = f"""
SELECT CAST(NULL AS VARCHAR) AS doi, CASE WHEN junk THEN file_name ELSE {ws('xmp_title')} END AS title,
  CASE WHEN junk THEN '' ELSE xmp_author END AS authors, '' AS journal, CAST(NULL AS INT) AS year, '' AS volume, '' AS issue, '' AS pages, '' AS abstract, '' AS keywords,
  CASE WHEN junk THEN 'filename' ELSE 'xmp' END AS metadata_source, TRUE AS needs_review, CAST(NULL AS VARCHAR) AS isbn, 'article' AS document_type
"""


def flat_lists(df):
    return df.withColumns({c: F.array_join(c, ";") for c in ("authors", "keywords")})


@query("parse_article_records", f"WITH {ARTICLES} SELECT {META_COLUMNS} FROM art")
def parse_article_records(spark, sf_dir):
    return flat_lists(resolve.parse_article_records(view(spark, sf_dir, "article_records_v")))


_KINDS = """
SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'Book' WHEN 1 THEN 'monograph' WHEN 2 THEN 'reference-book' WHEN 3 THEN 'edited-book'
  WHEN 4 THEN 'book-set' WHEN 5 THEN 'book-chapter' WHEN 6 THEN 'book-section' WHEN 7 THEN 'book-part' WHEN 8 THEN 'book-track'
  WHEN 9 THEN 'proceedings-article' ELSE event_type END AS kind FROM @events
"""


@query("document_type", f"SELECT event_id, {_TYPE.format(t='lower(kind)')} AS document_type FROM ({_KINDS}) t")
def document_type(spark, sf_dir):
    return spark_sql(spark, sf_dir, _KINDS).select("event_id", resolve.document_type(F.col("kind")).alias("document_type"))


@query("resolve_by_doi", f"""
WITH {ARTICLES} SELECT seq, q.doi AS asked, title, authors, journal, year, isbn, document_type
FROM ({_INCOMING}) q LEFT JOIN art ON q.doi = art.doi
""")
def resolve_by_doi(spark, sf_dir):
    rows = resolve.resolve_by_doi(spark_sql(spark, sf_dir, _INCOMING), view(spark, sf_dir, "article_records_v"))
    names = ("title", "journal", "year", "isbn", "document_type")
    authors = F.array_join("article.authors", ";").alias("authors")
    return rows.select("seq", F.col("doi").alias("asked"), authors, *[F.col(f"article.{n}") for n in names])


@query("resolve_by_isbn", f"""
WITH {BOOKS}, asked AS (SELECT id, {FULLTEXT_ISBN} AS isbn FROM fulltext_v)
SELECT id, asked.isbn AS asked, title, authors, journal, year, pages, abstract, keywords, metadata_source FROM asked LEFT JOIN books ON asked.isbn = books.isbn
""")
def resolve_by_isbn(spark, sf_dir):
    asked = written(identifiers.extract_isbn(view(spark, sf_dir, "fulltext_v")).select("id", "isbn"), "found")
    rows = resolve.resolve_by_isbn(asked, *books(spark, sf_dir), row_id="id").select("id", F.col("isbn").alias("asked"), "book.*")
    return flat_lists(rows).drop("doi", "volume", "issue", "needs_review", "isbn", "document_type")


@query("resolve_metadata", f"""
WITH {ARTICLES}, {BOOKS}, found AS (SELECT id, {FULLTEXT_DOI} AS found_doi, {FULLTEXT_ISBN} AS found_isbn, file_name, xmp_title, xmp_author,
  lower({ws('xmp_title')}) IN {JUNK} AS junk FROM fulltext_v)
SELECT id, {META_COLUMNS} FROM found JOIN art ON found_doi = art.doi
UNION ALL SELECT id, {META_COLUMNS} FROM found JOIN books ON found_isbn = isbn WHERE found_doi IS NULL OR found_doi NOT IN (SELECT doi FROM art)
UNION ALL SELECT id, {META_COLUMNS} FROM (SELECT found.id, g.* FROM found, LATERAL ({GUESS}) g
  WHERE (found_doi IS NULL OR found_doi NOT IN (SELECT doi FROM art)) AND (found_isbn IS NULL OR found_isbn NOT IN (SELECT isbn FROM books)))
""")
def resolve_metadata(spark, sf_dir):
    found = identifiers.extract_isbn(identifiers.extract_doi(view(spark, sf_dir, "fulltext_v")))
    # The texts are read once; what was found in them is read by the look-ups.
    asked = written(found.select("id", "doi", "isbn", "file_name", "xmp_title", "xmp_author"), "found")
    rows = resolve.resolve_metadata(asked, view(spark, sf_dir, "article_records_v"), *books(spark, sf_dir), row_id="id")
    return flat_lists(rows.select("id", "meta.*"))


@query("best_oa_location", f"WITH {OA} SELECT doi, oa_url, CASE WHEN oa_url IS NULL THEN 'no_oa_pdf' END AS reason FROM oa")
def best_oa_location(spark, sf_dir):
    return resolve.best_oa_location(view(spark, sf_dir, "oa_records_v"))


NOW = "2025-01-01T00:00:00+00:00"


def _fetched(spark, sf_dir):
    keyed = papers(spark, sf_dir).where("doi IS NOT NULL").select("id", "doi")
    rows = resolve.resolve_by_doi(keyed, view(spark, sf_dir, "article_records_v"), "id")
    return rows.where("article IS NOT NULL").select("id", "article.*")


def _new(column: str, value: str | None = None) -> str:
    return f"coalesce(nullif({value or 'art.' + column}, ''), p.{column}) AS {column}"


@query("merge_lookup", f"""
WITH {ARTICLES}, p AS (SELECT {FLAT_PAPER} FROM papers_v)
SELECT p.id, {_new('doi')}, {_new('title')}, {_new('authors')}, {_new('journal')}, coalesce(art.year, p.year) AS year, {_new('volume')}, {_new('issue')},
  {_new('pages')}, {_new('abstract')}, {_new('keywords')}, p.tags, p.collection_ids, p.file_path, p.date_added,
  CASE WHEN art.doi IS NOT NULL THEN '{NOW}' ELSE p.date_modified END AS date_modified, coalesce(art.metadata_source, p.metadata_source) AS metadata_source,
  CASE WHEN art.doi IS NOT NULL THEN FALSE ELSE p.needs_review END AS needs_review, p.open_access, {_new('isbn')},
  coalesce(nullif(art.document_type, 'article'), p.document_type) AS document_type
FROM p LEFT JOIN art ON p.doi = art.doi
""")
def merge_lookup(spark, sf_dir):
    return flat(resolve.merge_lookup(papers(spark, sf_dir), _fetched(spark, sf_dir), NOW))


# Pages that carry the DOI of a library paper and an abstract.
_ABSTRACT_PAGES = """SELECT page_id, concat('10.1234/abc.', CAST(page_id % 100 AS STRING)) AS doi, concat('Abstract ', CAST(page_id AS STRING)) AS abstract FROM pages_meta_v"""


@query("abstract_fallback", f"""
SELECT id, CASE WHEN id % 2 = 0 THEN abstract ELSE coalesce(page_abstract, '') END AS abstract
FROM papers_v LEFT JOIN (SELECT doi, min_by(abstract, page_id) AS page_abstract FROM ({_ABSTRACT_PAGES}) a GROUP BY doi) USING (doi)
""")
def abstract_fallback(spark, sf_dir):
    fetched = papers(spark, sf_dir).withColumn("abstract", F.when(F.col("id") % 2 == 0, F.col("abstract")).otherwise(""))
    return resolve.abstract_fallback(fetched, spark_sql(spark, sf_dir, _ABSTRACT_PAGES)).select("id", "abstract")


# Verified page metadata of every page, as the page import sees it; some pages carry a DOI of the library.
PAGE_INPUT = """SELECT m.page_id AS seq, CASE WHEN page_id % 6 = 3 THEN concat('10.1234/abc.', CAST(page_id AS STRING)) ELSE m.doi END AS doi"""
PAGE_REASON = "CASE WHEN pdf_url IS NOT NULL OR (doi IS NOT NULL AND oa_url IS NOT NULL) THEN NULL WHEN doi IS NOT NULL THEN 'no_oa_pdf' ELSE 'no_doi_no_pdf' END"


@query("resolve_page_import", PAGE_METADATA + f""", {ARTICLES}, {OA}, asked AS ({PAGE_INPUT}, pdf_url, open_access, title FROM meta m),
state AS (SELECT asked.*, oa_url, art.title AS art_title, doi IN (SELECT doi FROM papers_v WHERE doi IS NOT NULL) AS dup
  FROM asked LEFT JOIN oa USING (doi) LEFT JOIN art USING (doi))
SELECT seq, coalesce(dup, FALSE) AS duplicate, {PAGE_REASON} AS reason,
  CASE WHEN {PAGE_REASON} IS NULL THEN coalesce(art_title, CASE WHEN pdf_url IS NOT NULL THEN title ELSE concat(replace(doi, '/', '_'), '.pdf') END) END AS title,
  CASE WHEN pdf_url IS NOT NULL THEN open_access ELSE TRUE END AS open_access
FROM state
""")
def resolve_page_import(spark, sf_dir):
    found = web.page_metadata(view(spark, sf_dir, "pages_meta_v"))
    of_library = F.concat(F.lit("10.1234/abc."), F.col("page_id").cast("string"))
    rows = found.withColumn("doi", F.when(F.col("page_id") % 6 == 3, of_library).otherwise(F.col("doi")))
    done = resolve.page_import_outcomes(
        rows.withColumnRenamed("page_id", "seq"),
        papers(spark, sf_dir),
        view(spark, sf_dir, "article_records_v"),
        view(spark, sf_dir, "oa_records_v"),
    )
    return done.select("seq", "duplicate", "reason", F.col("meta.title").alias("title"), "open_access")


# Records whose titles are near, or far from, the first lines of the documents.
TITLE_RECORDS = """
SELECT concat('10.1234/abc.', CAST(doc_id AS STRING)) AS doi,
  CASE doc_id % 3 WHEN 0 THEN upper(split_part(text, chr(10), 1)) WHEN 1 THEN concat(split_part(text, chr(10), 1), ' second edition')
    ELSE concat('On ', lang, ' ', split_part(text, chr(10), 3)) END AS title
FROM @documents
"""


@query("fuzzy_title_match")
def fuzzy_title_match(spark, sf_dir):
    titles = identifiers.candidate_titles(view(spark, sf_dir, "fulltext_v")).select(F.col("candidate_title").alias("title"))
    return title_op.fuzzy_title_match(titles, spark_sql(spark, sf_dir, TITLE_RECORDS))



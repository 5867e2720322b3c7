"""Derived input views over the given tables, in the SQL subset Spark and DuckDB share.

``@name`` stands for a given table; the Spark side replaces it by the parquet path, DuckDB by the view name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["papers_v"] = """
SELECT d.doc_id AS id,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL
       ELSE concat('10.1234/abc.', CAST(d.doc_id AS STRING)) END AS doi,
  split_part(d.text, chr(10), 1) AS title,
  split(CASE WHEN d.doc_id % 13 = 0 THEN concat('Solo', CAST(d.doc_id % 17 AS STRING), ', Ann')
             WHEN d.doc_id % 2 = 0 THEN concat('Fam', CAST(d.doc_id % 17 AS STRING), ', Ann;Second, Bo')
             ELSE concat('Given Last', CAST(d.doc_id % 17 AS STRING), ';Second, Bo;Third, Cy') END, ';') AS authors,
  CASE WHEN d.doc_id % 19 = 0 THEN '' ELSE concat('Journal of ', d.source) END AS journal,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(1990 + d.doc_id % 35 AS INT) END AS year,
  CAST(1 + d.doc_id % 40 AS STRING) AS volume,
  CAST(1 + d.doc_id % 12 AS STRING) AS issue,
  '' AS pages,
  CASE WHEN instr(d.text, chr(10)) > 0 THEN substr(d.text, instr(d.text, chr(10)) + 1) ELSE d.text END AS abstract,
  split(concat(d.source, ' corpus,', d.lang), ',') AS keywords,
  split(concat('tag', CAST(d.doc_id % 9 AS STRING), ',', d.lang), ',') AS tags,
  CASE WHEN d.doc_id % 3 = 0 THEN 1 + d.doc_id % 5
       WHEN d.doc_id % 3 = 1 THEN 100 + d.doc_id % 25
       ELSE 1000 + d.doc_id % 10 END AS collection_id,
  concat('/lib/', d.source, '/', CAST(d.doc_id AS STRING), '.pdf') AS file_path,
  concat('2024-01-', lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0'), 'T', lpad(CAST(d.doc_id % 24 AS STRING), 2, '0'), ':00:00+00:00') AS date_added,
  concat('2024-02-', lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0'), 'T00:00:00+00:00') AS date_modified,
  CASE WHEN d.doc_id % 10 = 0 THEN 'filename' WHEN d.doc_id % 10 = 1 THEN 'xmp' ELSE 'crossref' END AS metadata_source,
  coalesce(l.quality, 1) = 0 AS needs_review,
  d.doc_id % 3 = 0 AS open_access,
  CAST(NULL AS STRING) AS isbn,
  CASE WHEN d.doc_id % 7 = 0 THEN 'book' WHEN d.doc_id % 7 = 1 THEN 'book-chapter'
       WHEN d.doc_id % 7 = 2 THEN 'proceedings' ELSE 'article' END AS document_type
FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id
"""

# What the search index takes of a paper, with its text: columns of papers_v that need no labels.
_INDEXED = ("title", "authors", "year", "abstract", "keywords", "date_modified")


def _column(name: str) -> str:
    """The expression of a column of papers_v."""
    found = re.search(rf"(?:^SELECT |,\n  )((?:(?!,\n  ).)*?) AS {name}(?:,\n|\nFROM)", VIEWS["papers_v"].strip(), re.S)
    return f"{found.group(1)} AS {name}"


VIEWS["indexed_v"] = f"""
SELECT d.doc_id AS id, {', '.join(map(_column, _INDEXED))}, d.text AS fulltext FROM @documents d
"""

VIEWS["collections_v"] = """
SELECT CAST(1 + r_regionkey AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id FROM @region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), n_name, CAST(1 + n_regionkey AS BIGINT) FROM @nation
UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT), s_name, CAST(100 + s_nationkey AS BIGINT) FROM @supplier
UNION ALL SELECT CAST(9999999 AS BIGINT), 'orphan', CAST(8888888 AS BIGINT)
"""

VIEWS["idline_v"] = """
SELECT doc_id, text,
  CASE doc_id % 6
    WHEN 0 THEN concat('(https://doi.org/10.1234/abc.', CAST(doc_id AS STRING), ').')
    WHEN 1 THEN concat('ISBN-13: 978-0-306-4', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), '-7')
    WHEN 2 THEN concat('c 2019 9780306', lpad(CAST(doc_id AS STRING), 6, '0'), ' print')
    WHEN 3 THEN concat('doi 10.55555/x(', CAST(doc_id AS STRING), ')y', chr(160), 'Received 2019; ISBN 0-306-40615-X')
    WHEN 4 THEN concat(chr(160), 'Published <jats:p>March 18', CAST(10 + doc_id % 90 AS STRING), '</jats:p>')
    ELSE 'no identifier here 10.12/short' END AS line
FROM @documents
"""

VIEWS["idtext_v"] = """
SELECT doc_id, concat(text, chr(10), line) AS text FROM idline_v
"""

# Whole texts in pages of 1,000 characters. The identifier stands before the text, or after its first line.
VIEWS["fulltext_v"] = """
SELECT i.doc_id AS id,
  regexp_extract_all(concat(CASE WHEN i.doc_id % 12 < 6 THEN '' ELSE concat(split_part(i.text, chr(10), 1), chr(10)) END,
    i.line, chr(10), i.text), '(?s)(.{1,1000})', 1) AS page_texts,
  CASE i.doc_id % 4 WHEN 0 THEN 'Untitled' WHEN 1 THEN '' ELSE concat('XMP title ', CAST(i.doc_id AS STRING)) END AS xmp_title,
  CASE WHEN i.doc_id % 8 = 2 THEN '' ELSE 'Writer, A' END AS xmp_author,
  CASE WHEN i.doc_id % 12 = 5 THEN concat('doi:10.9999/xs.', CAST(i.doc_id AS STRING), ';') ELSE '' END AS xmp_subject,
  CASE WHEN i.doc_id % 12 >= 10 THEN concat('k1, 10.9999/xk.', CAST(i.doc_id AS STRING), ' k2') ELSE '' END AS xmp_keywords,
  concat('scan_', CAST(i.doc_id AS STRING), '.pdf') AS file_name
FROM idline_v i
"""

VIEWS["pages_meta_v"] = """
SELECT page_id,
  CASE WHEN page_id % 6 = 4 THEN concat(url, '/10.7777/url.', CAST(page_id AS STRING)) ELSE url END AS url,
  replace(html, '<meta charset="utf-8">', concat('<meta charset="utf-8">',
    CASE page_id % 6
      WHEN 0 THEN concat('<meta name="citation_doi" content="https://doi.org/10.1111/hw.', CAST(page_id AS STRING), '">',
        '<meta name="citation_title" content=" HW title ', CAST(page_id AS STRING), ' ">',
        '<meta name="citation_author" content="Fam, Ann"><meta name="citation_author" content="Second, Bo">',
        '<meta name="citation_journal_title" content="HW Journal"><meta name="citation_publication_date" content="2019/05/01">',
        '<meta name="citation_firstpage" content="11"><meta name="citation_lastpage" content="19">',
        '<meta name="citation_keywords" content="alpha, beta,,gamma">',
        '<meta name="citation_pdf_url" content="https://x.example.org/pdf/', CAST(page_id AS STRING), '">')
      WHEN 1 THEN concat('<meta name="DC.identifier" content="doi:10.2222/dc.', CAST(page_id AS STRING), '">',
        '<meta name="dc.title" content="DC title ', CAST(page_id AS STRING), '"><meta name="DC.creator" content="Dee, Cy">',
        '<meta name="DC.date" content="2001-02-03">')
      WHEN 2 THEN concat('<script type="application/ld+json">{"@type":"ScholarlyArticle","identifier":"10.3333/ld.', CAST(page_id AS STRING),
        '","headline":"LD title","author":[{"name":"L. D. Author"}],"isPartOf":{"name":"LD Journal"},"datePublished":"1999-12-31"}</script>')
      WHEN 3 THEN '<meta property="og:title" content="OG title"><meta property="og:description" content="OG text">'
      WHEN 5 THEN concat('<meta name="citation_book_title" content="A Book"><meta name="citation_isbn" content="978-0-306-40615-7">',
        '<meta name="citation_firstpage" content="3">')
      ELSE '' END)) AS html
FROM @pages
"""

VIEWS["article_records_v"] = """
SELECT doi, concat('{"message":{"DOI":"', doi, '","title":[', CASE WHEN id % 23 = 0 THEN '' ELSE concat('"Work ', CAST(id AS STRING), '"') END,
  '],"author":[{"family":"Fam', CAST(id % 17 AS STRING), '","given":"Ann"},{"given":"Mono"}],',
  CASE WHEN id % 4 = 0 THEN '"publisher":"Pub House"' ELSE '"container-title":["J. Tests"]' END,
  ',"published":{"date-parts":[[', CAST(1990 + id % 35 AS STRING), ',1]]},"volume":"', CAST(id % 40 AS STRING),
  '","abstract":"<jats:p>About ', CAST(id AS STRING), '</jats:p>","subject":["s1","s2"],"ISBN":["0-306-40615-2","978-0-306-40615-7"],"type":"',
  CASE id % 4 WHEN 0 THEN 'monograph' WHEN 1 THEN 'book-chapter' WHEN 2 THEN 'proceedings-article' ELSE 'journal-article' END, '"}}') AS record
FROM (SELECT doc_id AS id, concat('10.1234/abc.', CAST(doc_id AS STRING)) AS doi FROM @documents WHERE doc_id % 12 <> 6) t
"""

VIEWS["crawl_log_v"] = """
SELECT url,
  CAST(CASE page_id % 7 WHEN 0 THEN 302 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 301 ELSE 200 END AS INT) AS status,
  CASE page_id % 7 WHEN 0 THEN 'https://x.example.org/SSO/in' WHEN 3 THEN 'https://x.example.org/new' ELSE '' END AS location,
  CASE page_id % 7 WHEN 4 THEN 'application/pdf;charset=x' WHEN 5 THEN 'text/html' ELSE '' END AS content_type
FROM @pages
"""

# Recorded answers for the addresses in pages_meta_v and the document addresses named on those pages.
VIEWS["answers_v"] = """
SELECT m.url, c.status, c.location, c.content_type
FROM pages_meta_v m JOIN @pages p ON m.page_id = p.page_id JOIN crawl_log_v c ON p.url = c.url
UNION ALL
SELECT concat('https://x.example.org/pdf/', CAST(page_id AS STRING)),
  CAST(CASE WHEN page_id % 5 = 0 THEN 403 WHEN page_id % 5 = 1 THEN NULL ELSE 200 END AS INT),
  '', CASE WHEN page_id % 5 = 2 THEN 'text/html' ELSE 'application/pdf' END
FROM @pages WHERE page_id % 6 = 0
"""

VIEWS["import_queue_v"] = """
SELECT event_id AS seq, concat('10.1234/abc.', CAST(user_id AS STRING)) AS item,
  CASE event_type WHEN 'view' THEN 'pdfs' WHEN 'error' THEN 'urls' ELSE 'dois' END AS mode
FROM @events
"""

VIEWS["oa_records_v"] = """
SELECT doi, CASE k % 4 WHEN 0 THEN concat('{"best_oa_location":{"url_for_pdf":"https://oa.example.org/', doi, '.pdf","url":"https://oa.example.org/l"}}')
  WHEN 1 THEN concat('{"best_oa_location":{"url_for_pdf":null,"url":"https://oa.example.org/', doi, '"}}')
  WHEN 2 THEN '{"best_oa_location":null}' ELSE '{}' END AS record
FROM (SELECT doc_id AS k, concat('10.1234/abc.', CAST(doc_id AS STRING)) AS doi FROM @documents) t
"""

# One category per label, represented by its first vector.
VIEWS["categories_v"] = """
SELECT CAST(label AS BIGINT) AS category_id, concat('cat', CAST(label AS STRING)) AS name, min_by(embedding, vec_id) AS embedding
FROM @embeddings GROUP BY label
"""

VIEWS["book_records_a_v"] = """
SELECT concat('97803064', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), '7') AS isbn,
  concat('{"title":"Book ', CAST(doc_id AS STRING), '"', CASE WHEN doc_id % 4 = 1 THEN ',"subtitle":"A Sub"' ELSE '' END,
    ',"authors":[{"name":"Ann Fam"},{"name":""}],"publishers":[{"name":"Pub House"}],"publish_date":"March ', CAST(1900 + doc_id % 99 AS STRING),
    '","description":', CASE WHEN doc_id % 8 = 1 THEN '{"value":"<p>Inner</p>"}' ELSE '"Plain <b>text</b>"' END,
    ',"subjects":[{"name":"s1"},"s2"],"number_of_pages":', CAST(100 + doc_id % 50 AS STRING), '}') AS record
FROM @documents WHERE doc_id % 6 = 1 AND doc_id % 5 <> 0
"""

VIEWS["book_records_b_v"] = """
SELECT concat('9780306', lpad(CAST(doc_id AS STRING), 6, '0')) AS isbn,
  concat('{"items":[{"volumeInfo":{"title":"Vol ', CAST(doc_id AS STRING), '","authors":["B. One","C. Two"],"publisher":"P2","publishedDate":"',
    CAST(1950 + doc_id % 60 AS STRING), '-01-02","description":"<i>About</i>","categories":["c1"],"pageCount":', CAST(doc_id % 300 AS STRING), '}}]}') AS record
FROM @documents WHERE doc_id % 6 = 2
"""

VIEWS["edits_v"] = """
SELECT user_id AS id,
  CASE event_type WHEN 'view' THEN 'title' WHEN 'click' THEN 'journal' WHEN 'purchase' THEN 'volume' WHEN 'signup' THEN 'issue' ELSE 'abstract' END AS field,
  concat('edit ', CAST(event_id AS STRING)) AS value, event_id AS seq
FROM @events
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
_TABLE = re.compile(rf"@({'|'.join(TABLES.split())})\b")
_VIEW = re.compile(r"\b(\w+_v)\b")


def _needed(sql: str, found: list[str] | None = None) -> list[str]:
    """Views a statement uses, with their own inputs first."""
    found = [] if found is None else found
    for name in dict.fromkeys(_VIEW.findall(sql)):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found.append(name)
    return found


def with_views(sql: str, materialised: bool = False) -> str:
    """Prefix a statement with the CTEs of the derived views it names."""
    names = _needed(sql)
    if not names:
        return sql
    how = "AS MATERIALIZED" if materialised else "AS"
    ctes = ", ".join(f"{n} {how} ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{ctes}, {body[len(head):]}"
    return f"WITH {ctes} {body}"


def duck_sql(sql: str) -> str:
    return _TABLE.sub(r"\1", with_views(sql))


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = with_views(sql)
    return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, f"SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

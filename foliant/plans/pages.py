"""Queries over web-page metadata (inventory C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import pages as op
from foliant.plans.identifiers import norm_doi, ws, year_of
from foliant.plans.registry import query
from foliant.plans.views import table, view

# Meta tags in DuckDB, one row per tag; only double-quoted attributes occur in these pages.
TAGS = r"""
WITH tag AS (SELECT page_id, url, CAST(p - 1 AS INT) AS pos,
    nullif(regexp_extract(t, '\bname="([^"]*)"', 1), '') AS name, nullif(regexp_extract(t, '\bproperty="([^"]*)"', 1), '') AS property,
    CASE WHEN contains(t, 'content="') THEN trim(regexp_extract(t, 'content="([^"]*)"', 1)) END AS content
  FROM (SELECT page_id, url, unnest(m) AS t, generate_subscripts(m, 1) AS p
        FROM (SELECT page_id, url, regexp_extract_all(html, '<meta[^>]*>') AS m FROM pages_meta_v))),
head AS (SELECT page_id, url,
    {scalars}
    coalesce(list(content ORDER BY pos) FILTER (WHERE name = 'citation_author' AND content <> ''), []) AS hw_authors,
    coalesce(list(content ORDER BY pos) FILTER (WHERE name = 'citation_keywords' AND content <> ''), []) AS hw_kw,
    coalesce(list(content ORDER BY name <> 'DC.creator', name <> 'dc.creator', pos)
             FILTER (WHERE name IN ('DC.creator', 'dc.creator', 'DC.CREATOR') AND content <> ''), []) AS dc_authors
  FROM tag GROUP BY page_id, url)
"""
_HW = "doi pdf_url title book_title journal_title publication_date volume issue firstpage lastpage abstract isbn".split()
_DC = "identifier title source date".split()


def _first(column: str, kind: str, key: str) -> str:
    return f"nullif(min_by(content, pos) FILTER (WHERE {kind} = '{key}' AND content IS NOT NULL), '') AS {column},"


TAGS = TAGS.replace(
    "{scalars}",
    "\n    ".join(
        [_first(f"t_{n}", "name", f"citation_{n}") for n in _HW]
        + [_first(f"dc_{n}{i}", "name", v) for n in _DC for i, v in enumerate((f"DC.{n}", f"dc.{n}", f"DC.{n.upper()}"))]
        + [_first("og_title", "property", "og:title"), _first("og_abstract", "property", "og:description")]
    ),
)


def _dc(name: str) -> str:
    return f"coalesce(dc_{name}0, dc_{name}1, dc_{name}2)"


_KEYWORDS = f"""array_to_string(list_filter(list_transform(flatten(list_transform(hw_kw, lambda k: string_split(k, ','))),
  lambda x: {ws('x')}), lambda x: x <> ''), ';')"""
_RANGE = "CASE WHEN t_firstpage IS NULL THEN '' WHEN t_lastpage IS NULL THEN t_firstpage ELSE concat(t_firstpage, '–', t_lastpage) END"
_ISBN = "replace(replace(upper(t_isbn), '-', ''), ' ', '')"
_HW_BOOK = "(t_isbn IS NOT NULL AND (t_book_title IS NOT NULL OR t_journal_title IS NULL))"
_LD = rf"""
ld AS (SELECT page_id, b->>'$."@type"' AS kind,
    CASE WHEN json_type(b->'$.identifier') = 'VARCHAR' THEN {norm_doi("b->>'$.identifier'")} END AS ld_doi,
    CASE WHEN contains(b->>'$.url', '/pdf/') THEN b->>'$.url' END AS ld_pdf_url,
    coalesce(nullif(b->>'$.name', ''), nullif(b->>'$.headline', '')) AS ld_title,
    coalesce(array_to_string(list_transform(CAST(b->'$.author' AS JSON[]), lambda a: a->>'$.name'), ';'), '') AS ld_authors,
    coalesce(nullif(b->>'$.isPartOf.name', ''), nullif(b->>'$.publisher.name', '')) AS ld_journal,
    {year_of("b->>'$.datePublished'")} AS ld_year
  FROM (SELECT page_id, CAST(nullif(regexp_extract(html, '(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script', 1), '') AS JSON) AS b
        FROM pages_meta_v))
"""


@query("meta_tags", TAGS + """
SELECT page_id, pos, 'name' AS kind, name AS key, content FROM tag WHERE name IS NOT NULL
UNION ALL SELECT page_id, pos, 'property', property, content FROM tag WHERE property IS NOT NULL
""")
def meta_tags(spark, sf_dir):
    return op.meta_tags(view(spark, sf_dir, "pages_meta_v"))


@query("highwire_fields", TAGS + f"""
SELECT page_id, {norm_doi('t_doi')} AS hw_doi, t_pdf_url AS hw_pdf_url, t_title AS hw_title, array_to_string(hw_authors, ';') AS hw_authors,
  coalesce(t_book_title, t_journal_title) AS hw_journal, {year_of('t_publication_date')} AS hw_year, t_volume AS hw_volume,
  t_issue AS hw_issue, t_abstract AS hw_abstract, {_KEYWORDS} AS hw_keywords
FROM head
""")
def highwire_fields(spark, sf_dir):
    found = op.highwire_fields(view(spark, sf_dir, "pages_meta_v")).drop("html", "url", "tags", "hw_pages", "hw_isbn", "hw_book")
    return found.withColumns({c: F.array_join(c, ";") for c in ("hw_authors", "hw_keywords")})


@query("page_range", TAGS + f"SELECT page_id, {_RANGE} AS pages FROM head")
def page_range(spark, sf_dir):
    return op.highwire_fields(view(spark, sf_dir, "pages_meta_v")).select("page_id", F.col("hw_pages").alias("pages"))


@query("highwire_book_rule", TAGS + f"SELECT page_id, {_ISBN} AS isbn, {_HW_BOOK} AS is_book FROM head")
def highwire_book_rule(spark, sf_dir):
    found = op.highwire_fields(view(spark, sf_dir, "pages_meta_v"))
    return found.select("page_id", F.col("hw_isbn").alias("isbn"), F.col("hw_book").alias("is_book"))


@query("dublin_core_fields", TAGS + f"""
SELECT page_id, {norm_doi(_dc('identifier'))} AS dc_doi, {_dc('title')} AS dc_title, array_to_string(dc_authors, ';') AS dc_authors,
  {_dc('source')} AS dc_journal, {year_of(_dc('date'))} AS dc_year FROM head
""")
def dublin_core_fields(spark, sf_dir):
    found = op.dublin_core_fields(view(spark, sf_dir, "pages_meta_v")).drop("html", "url", "tags")
    return found.withColumn("dc_authors", F.array_join("dc_authors", ";"))


@query("json_ld_fields", TAGS + f", {_LD} SELECT page_id, ld_doi, ld_pdf_url, ld_title, ld_authors, ld_journal, ld_year FROM ld")
def json_ld_fields(spark, sf_dir):
    found = op.json_ld_fields(view(spark, sf_dir, "pages_meta_v")).drop("html", "url", "ld_isbn", "ld_book")
    return found.withColumn("ld_authors", F.array_join("ld_authors", ";"))


@query("open_graph_fields", TAGS + "SELECT page_id, og_title, og_abstract FROM head")
def open_graph_fields(spark, sf_dir):
    return op.open_graph_fields(view(spark, sf_dir, "pages_meta_v")).select("page_id", "og_title", "og_abstract")


_URL_DOI = norm_doi(r"""regexp_extract(url, '(10\.\d{4,9}/[^\s"<>{|}\\^\[\]`]+)', 1)""")


@query("doi_from_url", f"SELECT page_id, {_URL_DOI} AS doi FROM pages_meta_v")
def doi_from_url(spark, sf_dir):
    return view(spark, sf_dir, "pages_meta_v").select("page_id", op.doi_from_url(F.col("url")).alias("doi"))


PAGE_METADATA = TAGS + f""", {_LD},
meta AS (SELECT page_id, url,
  coalesce({norm_doi('t_doi')}, {norm_doi(_dc('identifier'))}, ld_doi, {_URL_DOI}) AS doi,
  coalesce(t_pdf_url, ld_pdf_url) AS pdf_url, t_pdf_url IS NOT NULL AS open_access,
  coalesce(t_title, {_dc('title')}, ld_title, og_title, '') AS title,
  CASE WHEN len(hw_authors) > 0 THEN array_to_string(hw_authors, ';') WHEN len(dc_authors) > 0 THEN array_to_string(dc_authors, ';')
       ELSE ld_authors END AS authors,
  coalesce(t_book_title, t_journal_title, {_dc('source')}, ld_journal, '') AS journal,
  coalesce({year_of('t_publication_date')}, {year_of(_dc('date'))}, ld_year) AS year,
  coalesce(t_volume, '') AS volume, coalesce(t_issue, '') AS issue, {_RANGE} AS pages, coalesce(t_abstract, og_abstract, '') AS abstract,
  {_KEYWORDS} AS keywords, {_ISBN} AS isbn,
  CASE WHEN {_HW_BOOK} OR coalesce(kind = 'Book', FALSE) THEN 'book' ELSE 'article' END AS document_type,
  'scrape' AS metadata_source, TRUE AS needs_review
FROM head JOIN ld USING (page_id))
"""


def flat_metadata(df):
    return df.withColumns({c: F.array_join(c, ";") for c in ("authors", "keywords")})


@query("page_metadata", PAGE_METADATA + "SELECT * FROM meta")
def page_metadata(spark, sf_dir):
    return flat_metadata(op.page_metadata(view(spark, sf_dir, "pages_meta_v")))


@query("classify_url", """
SELECT page_id, p.url, CASE WHEN starts_with(c.content_type, 'application/pdf') OR lower(p.url) LIKE '%.pdf' THEN 'pdf' ELSE 'landing_page' END AS kind
FROM @pages p JOIN (SELECT DISTINCT ON (url) url, content_type FROM crawl_log_v ORDER BY url, status, location, content_type) c ON p.url = c.url
""")
def classify_url(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return op.classify_urls(urls, op.one_answer(view(spark, sf_dir, "crawl_log_v")))


ANSWER_OK = """CASE WHEN {s} IS NULL THEN FALSE
  WHEN {s} IN (301, 302) THEN NOT regexp_matches(lower({l}), 'login|sso|auth|signin|access')
  WHEN {s} IN (401, 403) THEN FALSE WHEN {s} = 200 THEN starts_with({t}, 'application/pdf') ELSE TRUE END"""


@query("verify_pdf_url", f"SELECT page_id, {ANSWER_OK.format(s='status', l='location', t='content_type')} AS ok FROM @pages JOIN crawl_log_v USING (url)")
def verify_pdf_url(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").join(view(spark, sf_dir, "crawl_log_v"), "url")
    ok = op.document_url_ok(F.col("status"), F.col("location"), F.col("content_type"))
    return rows.select("page_id", ok.alias("ok"))


@query("verified_page_metadata", PAGE_METADATA + f"""
SELECT page_id, doi, title, CASE WHEN ok THEN pdf_url END AS pdf_url, CASE WHEN pdf_url IS NOT NULL AND NOT ok THEN FALSE ELSE open_access END AS open_access
FROM (SELECT meta.*, {ANSWER_OK.format(s='a.status', l='a.location', t='a.content_type')} AS ok
      FROM meta LEFT JOIN answers_v a ON meta.pdf_url = a.url) t
""")
def verified_page_metadata(spark, sf_dir):
    found = op.page_metadata(view(spark, sf_dir, "pages_meta_v"))
    checked = op.verify_pdf_urls(found, op.one_answer(view(spark, sf_dir, "answers_v")))
    return checked.select("page_id", "doi", "title", "pdf_url", "open_access")

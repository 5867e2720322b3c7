"""Queries over identifiers, titles and author lists (inventory B, J3) and text loading (A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.text import first_filled
from foliant.operators import identifiers as op
from foliant.plans.registry import query
from foliant.plans.views import spark_sql, view

# The same fixed patterns as foliant.functions.ids, quoted for DuckDB.
_SPACE = "\\s\u00a0\u2000-\u200a\u202f\u205f\u3000"
_DOI = r"""'\b(10\.\d{4,9}/[^@"<>{|}\\^\[\]`]+)'""".replace("@", _SPACE)
_DOI_ANY = _DOI.replace(r"\b", "")
_TAIL = """'[.,;)>"'']+$'"""
_ISBN = r"""'(?i)(?:ISBN(?:-1[03])?[:\s]*)((?:97[89][- ]?)?(?:\d[- ]?){9}[\dX])'"""
_ISBN_BARE = r"""'\b(97[89]\d{10})\b'"""
_YEAR = r"""'\b(1[89]\d\d|20\d\d)\b'"""


def doi_of(text: str) -> str:
    return f"nullif(regexp_replace(regexp_extract({text}, {_DOI}, 1), {_TAIL}, ''), '')"


def ws(text: str) -> str:
    return rf"regexp_replace({text}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def norm_doi(text: str) -> str:
    bare = rf"regexp_replace(regexp_replace({ws(text)}, '^https?://(?:dx\.)?doi\.org/', ''), {_TAIL}, '')"
    return f"nullif(regexp_extract({bare}, {_DOI_ANY}, 1), '')"


def year_of(text: str) -> str:
    return f"TRY_CAST(regexp_extract({text}, {_YEAR}, 1) AS INT)"


LEAD = "array_to_string(page_texts[1:3], chr(10))"
FULLTEXT_DOI = f"""coalesce({doi_of(f"array_to_string(string_split({LEAD}, chr(10))[1:100], chr(10))")},
    {doi_of("page_texts[1]")}, {doi_of("xmp_subject")}, {doi_of("xmp_keywords")})"""
FULLTEXT_ISBN = f"""replace(replace(upper(coalesce(nullif(regexp_extract({LEAD}, {_ISBN}, 1), ''),
    nullif(regexp_extract({LEAD}, {_ISBN_BARE}, 1), ''))), '-', ''), ' ', '')"""
CANDIDATE = f"""coalesce(list_max(list_transform(list_filter(list_transform(
      list_filter(list_transform(string_split(page_texts[1], chr(10)), lambda x: {ws('x')}), lambda x: x <> '')[1:20],
      lambda x, i: {{'n': length(x), 'r': -i, 'line': x}}), lambda s: s.n >= 20 AND contains(s.line, ' ')), lambda s: s)).line, '')"""


@query("load_text", f"""
SELECT id, array_to_string(page_texts, chr(10)) AS fulltext, {LEAD} AS lead_text, page_texts[1] AS first_page FROM fulltext_v
""")
def load_text(spark, sf_dir):
    return op.document_text(view(spark, sf_dir, "fulltext_v"))


@query("extract_doi", f"SELECT id, {FULLTEXT_DOI} AS doi FROM fulltext_v")
def extract_doi(spark, sf_dir):
    return op.extract_doi(view(spark, sf_dir, "fulltext_v")).select("id", "doi")


@query("extract_isbn", f"SELECT id, {FULLTEXT_ISBN} AS isbn FROM fulltext_v")
def extract_isbn(spark, sf_dir):
    return op.extract_isbn(view(spark, sf_dir, "fulltext_v")).select("id", "isbn")


_RAW_DOIS = """
SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN concat('  https://doi.org/10.1234/abc.', CAST(doc_id AS STRING), '. ')
  WHEN 1 THEN concat('http://dx.doi.org/10.4321/x(', CAST(doc_id AS STRING), ')')
  WHEN 2 THEN concat('doi:10.5555/', substr(lang, 1, 1), CAST(doc_id AS STRING), ';)')
  WHEN 3 THEN concat('10.12/', CAST(doc_id AS STRING)) ELSE concat('10.9999/', source) END AS raw FROM @documents
"""


@query("normalise_doi", f"SELECT doc_id, {norm_doi('raw')} AS doi FROM ({_RAW_DOIS}) t")
def normalise_doi(spark, sf_dir):
    return spark_sql(spark, sf_dir, _RAW_DOIS).select("doc_id", ids.normalise_doi(F.col("raw")).alias("doi"))


@query("valid_doi", rf"SELECT doc_id, regexp_matches(trim(raw), '^10\.\d{{4,9}}/') AS valid FROM ({_RAW_DOIS}) t")
def valid_doi(spark, sf_dir):
    return spark_sql(spark, sf_dir, _RAW_DOIS).select("doc_id", ids.valid_doi(F.trim("raw")).alias("valid"))


_RAW_ISBNS = """
SELECT doc_id, concat('978-0 306-', CAST(doc_id AS STRING), '-x') AS raw,
  split(CASE doc_id % 4 WHEN 0 THEN '0-306-40615-2;978-0-306-40615-7' WHEN 1 THEN concat('0 ', CAST(doc_id AS STRING), ';1')
        WHEN 2 THEN concat('979-', CAST(doc_id AS STRING)) ELSE '0-1;9-2;978-3' END, ';') AS isbns FROM @documents
"""


@query("normalise_isbn", f"SELECT doc_id, replace(replace(upper(raw), '-', ''), ' ', '') AS isbn FROM ({_RAW_ISBNS}) t")
def normalise_isbn(spark, sf_dir):
    return spark_sql(spark, sf_dir, _RAW_ISBNS).select("doc_id", ids.normalise_isbn(F.col("raw")).alias("isbn"))


@query("pick_isbn", f"""
SELECT doc_id, coalesce(list_filter(c, lambda x: x LIKE '978%' OR x LIKE '979%')[1], c[1]) AS isbn
FROM (SELECT doc_id, list_transform(isbns, lambda x: replace(replace(upper(x), '-', ''), ' ', '')) AS c FROM ({_RAW_ISBNS}) t) u
""")
def pick_isbn(spark, sf_dir):
    return spark_sql(spark, sf_dir, _RAW_ISBNS).select("doc_id", ids.pick_isbn(F.col("isbns")).alias("isbn"))


@query("parse_year", f"SELECT doc_id, {year_of('text')} AS year FROM idtext_v")
def parse_year(spark, sf_dir):
    return view(spark, sf_dir, "idtext_v").select("doc_id", ids.parse_year(F.col("text")).alias("year"))


@query("strip_markup", f"SELECT doc_id, {ws("regexp_replace(text, '<[^>]+>', '', 'g')")} AS plain FROM idtext_v")
def strip_markup(spark, sf_dir):
    return view(spark, sf_dir, "idtext_v").select("doc_id", ids.strip_markup(F.col("text")).alias("plain"))


@query("candidate_title", f"SELECT id, {CANDIDATE} AS candidate_title FROM fulltext_v")
def candidate_title(spark, sf_dir):
    return op.candidate_titles(view(spark, sf_dir, "fulltext_v")).select("id", "candidate_title")


JUNK = "('untitled', 'untitled document', 'microsoft word', 'word document', '')"


@query("junk_title", f"SELECT id, lower({ws('xmp_title')}) IN {JUNK} AS junk FROM fulltext_v")
def junk_title(spark, sf_dir):
    return view(spark, sf_dir, "fulltext_v").select("id", ids.junk_title(F.col("xmp_title")).alias("junk"))


@query("guess_metadata", f"""
SELECT id, CASE WHEN junk THEN file_name ELSE {ws('xmp_title')} END AS title,
  CASE WHEN junk THEN '' ELSE xmp_author END AS authors,
  CASE WHEN junk THEN 'filename' ELSE 'xmp' END AS metadata_source, TRUE AS needs_review
FROM (SELECT *, lower({ws('xmp_title')}) IN {JUNK} AS junk FROM fulltext_v) t
""")
def guess_metadata(spark, sf_dir):
    guessed = op.guess_metadata(view(spark, sf_dir, "fulltext_v"))
    return guessed.withColumn("authors", F.array_join("authors", ";"))


_RAW_AUTHORS = """
SELECT doc_id, concat(' Fam', CAST(doc_id % 17 AS STRING), ', Ann ;; ', source, ',B;') AS raw,
  split(concat('a, b,,', source, '|', lang, ' ,c'), '[|]') AS kw FROM @documents
"""


@query("split_authors", f"""
SELECT doc_id, len(a) AS n_authors, array_to_string(a, '|') AS authors, array_to_string(a, '; ') AS joined
FROM (SELECT doc_id, list_filter(list_transform(string_split(raw, ';'), lambda x: {ws('x')}), lambda x: x <> '') AS a
      FROM ({_RAW_AUTHORS}) t) u
""")
def split_authors(spark, sf_dir):
    split = spark_sql(spark, sf_dir, _RAW_AUTHORS).select("doc_id", ids.split_authors(F.col("raw")).alias("a"))
    return split.select(
        "doc_id",
        F.size("a").cast("bigint").alias("n_authors"),
        F.array_join("a", "|").alias("authors"),
        ids.join_authors(F.col("a")).alias("joined"),
    )


@query("split_keywords", f"""
SELECT doc_id, array_to_string(list_filter(list_transform(flatten(list_transform(string_split(kw, '|'), lambda k: string_split(k, ','))),
  lambda x: {ws('x')}), lambda x: x <> ''), '|') AS keywords
FROM (SELECT doc_id, concat('a, b,,', source, '|', lang, ' ,c') AS kw FROM @documents) t
""")
def split_keywords(spark, sf_dir):
    raw = spark_sql(spark, sf_dir, _RAW_AUTHORS)
    return raw.select("doc_id", F.array_join(ids.split_keywords(F.col("kw")), "|").alias("keywords"))


@query("first_by_priority", """
SELECT id, coalesce(nullif(xmp_subject, ''), nullif(xmp_keywords, ''), nullif(xmp_author, ''), file_name) AS value FROM fulltext_v
""")
def first_by_priority(spark, sf_dir):
    ordered = [F.col(c) for c in ("xmp_subject", "xmp_keywords", "xmp_author", "file_name")]
    return view(spark, sf_dir, "fulltext_v").select("id", first_filled(*ordered).alias("value"))

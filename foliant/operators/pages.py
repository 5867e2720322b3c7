"""Bibliographic metadata of web pages: five sources in order of trust, each filling what is still missing.

All of it is projection over one row per page, so a page table of any size is read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import html, ids
from foliant.functions.text import extracted, filled, first_filled, no_strings, or_empty, spread_out
from foliant.operators.dedupe import lookup
from foliant.session import written

# Words of a sign-in address, and the linked-data types that describe a work.
SIGN_IN_WORDS = ["login", "sso", "auth", "signin", "access"]
ARTICLE_TYPES = ["ScholarlyArticle", "Article", "CreativeWork"]
BOOK_TYPE = "Book"


def with_tags(pages: DataFrame) -> DataFrame:
    """Pages with their parsed ``tags``; the operators below parse them when they are not there yet."""
    return pages if "tags" in pages.columns else pages.withColumn("tags", html.meta_tags(F.col("html")))


def meta_tags(pages: DataFrame) -> DataFrame:
    """One row per named meta tag: (page_id, pos, kind, key, content)."""
    rows = spread_out(with_tags(pages).select("page_id", "tags"), F.col("tags"), "t", "pos")
    both = F.array(
        F.struct(F.lit("name").alias("kind"), F.col("t.name").alias("key")),
        F.struct(F.lit("property").alias("kind"), F.col("t.property").alias("key")),
    )
    named = spread_out(rows, F.filter(both, lambda k: k["key"].isNotNull()), "k")
    return named.select("page_id", "pos", "k.kind", "k.key", F.col("t.content").alias("content"))


def page_range(first: Column, last: Column) -> Column:
    both = F.concat(first, F.lit("–"), last)
    return F.when(filled(first).isNull(), F.lit("")).when(filled(last).isNull(), first).otherwise(both)


def highwire_fields(pages: DataFrame) -> DataFrame:
    """Fields of the ``citation_*`` tags, with prefix ``hw_``; NULL or empty list where there is none."""
    pages = with_tags(pages)
    tag = lambda name: html.first_content(F.col("tags"), name)
    every = lambda name: html.all_contents(F.col("tags"), name)
    book = F.coalesce(tag("citation_book_title"), F.lit(""))
    journal = tag("citation_journal_title")
    isbn = ids.normalise_isbn(tag("citation_isbn"))
    is_book = isbn.isNotNull() & ((book != "") | journal.isNull())
    return pages.withColumns(
        {
            "hw_doi": ids.normalise_doi(tag("citation_doi")),
            "hw_pdf_url": tag("citation_pdf_url"),
            "hw_title": tag("citation_title"),
            "hw_authors": every("citation_author"),
            "hw_journal": first_filled(book, journal),
            "hw_year": ids.parse_year(tag("citation_publication_date")),
            "hw_volume": tag("citation_volume"),
            "hw_issue": tag("citation_issue"),
            "hw_pages": page_range(tag("citation_firstpage"), tag("citation_lastpage")),
            "hw_abstract": tag("citation_abstract"),
            "hw_keywords": ids.split_keywords(every("citation_keywords")),
            "hw_isbn": isbn,
            "hw_book": is_book,
        }
    )


def dublin_core_fields(pages: DataFrame) -> DataFrame:
    """Fields of the ``DC.*`` tags in their three spellings, with prefix ``dc_``."""
    pages = with_tags(pages)
    tags = F.col("tags")
    scalar = lambda name: F.coalesce(*[html.first_content(tags, v) for v in html.variants(name)])
    creators = F.concat(*[html.all_contents(tags, v) for v in html.variants("DC.creator")])
    return pages.withColumns(
        {
            "dc_doi": ids.normalise_doi(scalar("DC.identifier")),
            "dc_title": scalar("DC.title"),
            "dc_authors": creators,
            "dc_journal": scalar("DC.source"),
            "dc_year": ids.parse_year(scalar("DC.date")),
        }
    )


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _is(node: Column, kind: str) -> Column:
    return F.schema_of_variant(node).startswith(kind)


def _member(node: Column, name: str) -> Column:
    return F.try_variant_get(node, f"$.{name}", "variant")


def _items(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>")


def _kind(node: Column) -> Column:
    return _text(node, "$['@type']")


def json_ld_fields(pages: DataFrame) -> DataFrame:
    """Fields of the first usable linked-data block, with prefix ``ld_``.

    A list gives its first article-like member; a single object may also be a book.
    """
    blocks = F.transform(html.linked_data_blocks(F.col("html")), lambda b: F.try_parse_json(b))
    listed = lambda v: F.get(F.filter(_items(v), lambda x: _kind(x).isin(ARTICLE_TYPES)), F.lit(0))
    single = lambda v: F.when(_kind(v).isin([*ARTICLE_TYPES, BOOK_TYPE]), v)
    chosen = F.transform(blocks, lambda v: F.when(_is(v, "ARRAY"), listed(v)).when(_is(v, "OBJECT"), single(v)))
    pages = pages.withColumn("_ld", F.get(F.filter(chosen, lambda v: v.isNotNull()), F.lit(0)))
    node = F.col("_ld")
    pages = pages.withColumns({f"_{n}": _member(node, n) for n in ("identifier", "author", "isPartOf", "publisher")})
    ident, author = F.col("_identifier"), F.col("_author")

    def isbn_of(item: Column) -> Column:
        kind = first_filled(_kind(item), _text(item, "$.propertyID"))
        value = filled(ids.normalise_isbn(_text(item, "$.value")))
        return F.when(_is(item, "OBJECT") & F.contains(F.upper(kind), F.lit("ISBN")), value)

    isbns = F.transform(F.when(_is(ident, "ARRAY"), _items(ident)), isbn_of)
    people = F.when(_is(author, "OBJECT"), F.array(author)).when(_is(author, "ARRAY"), _items(author))
    names = F.filter(
        F.transform(people, lambda a: F.when(_is(a, "OBJECT"), _text(a, "$.name"))),
        lambda n: F.coalesce(n, F.lit("")) != "",
    )
    part_of = F.when(_is(F.col("_isPartOf"), "OBJECT"), _text(F.col("_isPartOf"), "$.name"))
    publisher = F.when(_is(F.col("_publisher"), "OBJECT"), _text(F.col("_publisher"), "$.name"))
    url = _text(node, "$.url")
    isbn = F.get(F.filter(isbns, lambda x: x.isNotNull()), F.lit(0))
    found = pages.withColumns(
        {
            "ld_doi": F.when(_is(ident, "STRING"), ids.normalise_doi(_text(ident, "$"))),
            "ld_isbn": isbn,
            "ld_book": F.coalesce(_kind(node) == BOOK_TYPE, F.lit(False)),
            "ld_pdf_url": F.when(F.contains(url, F.lit("/pdf/")), url),
            "ld_title": first_filled(_text(node, "$.name"), _text(node, "$.headline")),
            "ld_authors": F.coalesce(names, no_strings()),
            "ld_journal": first_filled(part_of, publisher),
            "ld_year": ids.parse_year(_text(node, "$.datePublished")),
        }
    )
    return found.drop("_ld", "_identifier", "_author", "_isPartOf", "_publisher")


def open_graph_fields(pages: DataFrame) -> DataFrame:
    tag = lambda name: html.first_content(F.col("tags"), f"og:{name}", "property")
    return with_tags(pages).withColumns({"og_title": tag("title"), "og_abstract": tag("description")})


def doi_from_url(url: Column) -> Column:
    return ids.normalise_doi(extracted(url, ids.DOI_ANYWHERE))


def _first_list(*lists: Column) -> Column:
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in lists], no_strings())


def page_metadata(pages: DataFrame) -> DataFrame:
    """One metadata row per page from all sources. The document address is a candidate until it is verified."""
    c = F.col
    found = open_graph_fields(json_ld_fields(dublin_core_fields(highwire_fields(pages))))
    early_doi = first_filled(c("hw_doi"), c("dc_doi"))
    # Identifier lists of linked data are read only while no DOI is known.
    ld_isbn = F.when(early_doi.isNull() & c("hw_isbn").isNull(), c("ld_isbn"))
    pdf_url = first_filled(c("hw_pdf_url"), c("ld_pdf_url"))
    book = c("hw_book") | c("ld_book") | ld_isbn.isNotNull()
    return found.select(
        "page_id",
        "url",
        first_filled(early_doi, c("ld_doi"), doi_from_url(c("url"))).alias("doi"),
        pdf_url.alias("pdf_url"),
        c("hw_pdf_url").isNotNull().alias("open_access"),
        or_empty(first_filled(c("hw_title"), c("dc_title"), c("ld_title"), c("og_title"))).alias("title"),
        _first_list(c("hw_authors"), c("dc_authors"), c("ld_authors")).alias("authors"),
        or_empty(first_filled(c("hw_journal"), c("dc_journal"), c("ld_journal"))).alias("journal"),
        F.coalesce(c("hw_year"), c("dc_year"), c("ld_year")).alias("year"),
        or_empty(c("hw_volume")).alias("volume"),
        or_empty(c("hw_issue")).alias("issue"),
        c("hw_pages").alias("pages"),
        or_empty(first_filled(c("hw_abstract"), c("og_abstract"))).alias("abstract"),
        c("hw_keywords").alias("keywords"),
        F.coalesce(c("hw_isbn"), ld_isbn).alias("isbn"),
        F.when(book, F.lit("book")).otherwise(F.lit("article")).alias("document_type"),
        F.lit("scrape").alias("metadata_source"),
        F.lit(True).alias("needs_review"),
    )


def pages_at(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages at a list of addresses. The engine sends a short list to the page scan and joins a long one."""
    return pages.join(urls.select("url").distinct(), "url", "left_semi")


def one_page_per_url(metadata: DataFrame) -> DataFrame:
    """The metadata of the first page of each address."""
    row = F.struct(*metadata.columns)
    return metadata.groupBy("url").agg(F.min_by(row, "page_id").alias("m")).select("m.*")


def url_kind(url: Column, content_type: Column) -> Column:
    """``pdf`` by the recorded content type or the ending of the address, else ``landing_page``."""
    is_pdf = F.coalesce(content_type.startswith("application/pdf"), F.lit(False)) | F.lower(url).endswith(".pdf")
    return F.when(is_pdf, F.lit("pdf")).otherwise(F.lit("landing_page"))


def document_url_ok(status: Column, location: Column, content_type: Column) -> Column:
    """Whether a recorded answer lets a document address stand."""
    target = F.lower(or_empty(location))
    to_sign_in = F.lit(False)
    for w in SIGN_IN_WORDS:
        to_sign_in = to_sign_in | F.contains(target, F.lit(w))
    is_pdf = or_empty(content_type).startswith("application/pdf")
    return (
        F.when(status.isNull(), False)
        .when(status.isin(301, 302), ~to_sign_in)
        .when(status.isin(401, 403), False)
        .when(status == 200, is_pdf)
        .otherwise(True)
    )


def one_answer(crawl_log: DataFrame) -> DataFrame:
    """A stored table with one recorded answer per address."""
    answer = F.struct("status", "location", "content_type")
    rows = crawl_log.groupBy("url").agg(F.min(answer).alias("a"))
    return written(rows.select("url", "a.status", "a.location", "a.content_type"), "answers")


def classify_urls(urls: DataFrame, answers: DataFrame) -> DataFrame:
    """Add ``kind`` to addresses. ``answers`` has one row per address, as from ``one_answer``."""
    known = answers.select("url", "content_type")
    rows = urls.join(known, "url", "left")
    return rows.withColumn("kind", url_kind(F.col("url"), F.col("content_type"))).drop("content_type")


def verify_pdf_urls(metadata: DataFrame, answers: DataFrame, row_id: str = "page_id") -> DataFrame:
    """Drop document addresses that the recorded answers do not confirm; open access goes with them."""
    answers = answers.withColumnRenamed("url", "pdf_url")
    ok = document_url_ok(F.col("status"), F.col("location"), F.col("content_type"))
    rows = lookup(metadata, answers, "pdf_url", row_id)  # most pages name no document
    kept = F.when(ok, F.col("pdf_url"))
    access = F.when(F.col("pdf_url").isNotNull() & ~ok, F.lit(False)).otherwise(F.col("open_access"))
    return rows.withColumns({"pdf_url": kept, "open_access": access}).select(*metadata.columns)

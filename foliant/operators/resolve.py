"""Metadata from bulk records: one join per source, then the first source that answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.text import filled, first_filled, no_strings, or_empty
from foliant.operators.dedupe import known, lookup
from foliant.operators.updates import last_of_each
from foliant.session import written

META_TYPES = {
    "doi": "string", "title": "string", "authors": "array<string>", "journal": "string", "year": "int",
    "volume": "string", "issue": "string", "pages": "string", "abstract": "string", "keywords": "array<string>",
    "metadata_source": "string", "needs_review": "boolean", "isbn": "string", "document_type": "string",
}
# Record types and the kind of document they stand for, the number of subjects kept of a book.
BOOK_TYPES = ["book", "monograph", "reference-book", "edited-book", "book-set"]
CHAPTER_TYPES = ["book-chapter", "book-section", "book-part", "book-track"]
PROCEEDINGS_TYPES = ["proceedings-article"]
MAX_SUBJECTS = 20

_DATE = "STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
_ARTICLE = f"""STRUCT<message: STRUCT<title: ARRAY<STRING>, author: ARRAY<STRUCT<family: STRING, given: STRING>>,
  `container-title`: ARRAY<STRING>, publisher: STRING, published: {_DATE}, `published-print`: {_DATE},
  `published-online`: {_DATE}, volume: STRING, issue: STRING, page: STRING, abstract: STRING,
  subject: ARRAY<STRING>, ISBN: ARRAY<STRING>, type: STRING>>"""


def meta(**given: Column) -> Column:
    """The metadata struct every source fills; what a source lacks is empty."""
    empty = {"string": F.lit(""), "array<string>": no_strings(), "boolean": F.lit(False)}
    null_by_default = ("doi", "isbn", "year")
    fields = []
    for name, kind in META_TYPES.items():
        if name in given:
            col = given[name]
        elif name == "document_type":
            col = F.lit("article")
        else:
            col = F.lit(None) if name in null_by_default else empty[kind]
        fields.append(col.cast(kind).alias(name))
    return F.struct(*fields)


def document_type(record_type: Column) -> Column:
    kind = F.lower(or_empty(record_type))
    return (
        F.when(kind.isin(BOOK_TYPES), "book")
        .when(kind.isin(CHAPTER_TYPES), "book-chapter")
        .when(kind.isin(PROCEEDINGS_TYPES), "proceedings")
        .otherwise("article")
    )


def with_article(rows: DataFrame, record: str, name: str, doi: str = "doi") -> DataFrame:
    """Add the metadata struct of the article record in a column, NULL when there is no record."""
    rows = rows.withColumn("_message", F.from_json(F.col(record), _ARTICLE)["message"])
    return rows.withColumn(name, _article_meta(F.col(doi), F.col("_message"))).drop("_message")


def _article_meta(doi: Column, m: Column) -> Column:
    title = or_empty(F.get(m["title"], F.lit(0)))

    def author(a: Column) -> Column:
        family, given = or_empty(a["family"]), or_empty(a["given"])
        full = F.regexp_replace(F.concat(family, F.lit(", "), given), r"^[, ]+|[, ]+$", "")
        return F.when(family != "", full).otherwise(given)

    authors = F.coalesce(F.filter(F.transform(m["author"], author), lambda x: x != ""), no_strings())
    parts = F.coalesce(*[m[f"{d}"]["date-parts"] for d in ("published", "published-print", "published-online")])
    return F.when(
        m.isNotNull(),
        meta(
            doi=filled(doi),
            title=title,
            authors=authors,
            journal=or_empty(F.coalesce(F.get(m["container-title"], F.lit(0)), m["publisher"])),
            year=F.get(F.get(parts, F.lit(0)), F.lit(0)),
            volume=or_empty(m["volume"]),
            issue=or_empty(m["issue"]),
            pages=or_empty(m["page"]),
            abstract=ids.strip_markup(or_empty(m["abstract"])),
            keywords=F.coalesce(m["subject"], no_strings()),
            metadata_source=F.lit("crossref"),
            needs_review=(title == "") | (F.size(authors) == 0),
            isbn=ids.pick_isbn(m["ISBN"]),
            document_type=document_type(m["type"]),
        ),
    )


def _titled(title: Column, subtitle: Column) -> Column:
    return F.when(filled(subtitle).isNull(), or_empty(title)).otherwise(
        F.concat(or_empty(title), F.lit(": "), subtitle)
    )


def _count_text(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("")).otherwise(n.cast("string"))


def _book_meta_a(isbn: Column, v: Column) -> Column:
    """Metadata of a record of the first book source. Description and subjects come as text or as objects."""
    text = lambda node, path: F.try_variant_get(node, path, "string")
    names = F.transform(F.try_variant_get(v, "$.authors", "array<variant>"), lambda a: text(a, "$.name"))
    subjects = F.transform(
        F.try_variant_get(v, "$.subjects", "array<variant>"),
        lambda s: F.when(F.schema_of_variant(s).startswith("OBJECT"), text(s, "$.name")).otherwise(text(s, "$")),
    )
    description = F.coalesce(text(v, "$.description.value"), text(v, "$.description"))
    return F.when(
        v.isNotNull(),
        meta(
            title=_titled(text(v, "$.title"), text(v, "$.subtitle")),
            authors=F.coalesce(F.filter(names, lambda n: or_empty(n) != ""), no_strings()),
            journal=or_empty(text(v, "$.publishers[0].name")),
            year=ids.parse_year(or_empty(text(v, "$.publish_date"))),
            pages=_count_text(F.try_variant_get(v, "$.number_of_pages", "int")),
            abstract=ids.strip_markup(or_empty(description)),
            keywords=F.coalesce(F.slice(F.filter(subjects, lambda s: s.isNotNull()), 1, MAX_SUBJECTS), no_strings()),
            metadata_source=F.lit("openlibrary"),
            isbn=isbn,
            document_type=F.lit("book"),
        ),
    )


_BOOK_B = """STRUCT<items: ARRAY<STRUCT<volumeInfo: STRUCT<title: STRING, subtitle: STRING, authors: ARRAY<STRING>,
  publisher: STRING, publishedDate: STRING, description: STRING, categories: ARRAY<STRING>, pageCount: INT>>>>"""


def _book_meta_b(isbn: Column, item: Column) -> Column:
    """Metadata of the first item of a record of the second book source."""
    info = item["volumeInfo"]
    return F.when(
        item.isNotNull(),
        meta(
            title=_titled(info["title"], info["subtitle"]),
            authors=F.coalesce(info["authors"], no_strings()),
            journal=or_empty(info["publisher"]),
            year=ids.parse_year(or_empty(info["publishedDate"])),
            pages=_count_text(info["pageCount"]),
            abstract=ids.strip_markup(or_empty(info["description"])),
            keywords=F.coalesce(info["categories"], no_strings()),
            metadata_source=F.lit("googlebooks"),
            isbn=isbn,
            document_type=F.lit("book"),
        ),
    )


def unique_records(records: DataFrame, key: str) -> DataFrame:
    """A stored table with one record per key, the smallest when a dump repeats a key. The lookups below expect that."""
    return written(records.groupBy(key).agg(F.min("record").alias("record")), "records")


def asked_records(records: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """As ``unique_records``, for the keys that some item asks for, letter case folded. Of the dump only these are moved."""
    asked = items.where(F.col(key).isNotNull()).select(F.lower(key).alias("_key")).distinct()
    folded = records.select(F.lower(key).alias("_key"), "record").join(asked, "_key", "left_semi")
    return unique_records(folded, "_key")


def _by_key(records: DataFrame, key: str, name: str) -> DataFrame:
    return records.select(key, F.col("record").alias(name))


def parse_article_records(records: DataFrame) -> DataFrame:
    return with_article(records, "record", "m").select("m.*")


def resolve_by_doi(items: DataFrame, articles: DataFrame, row_id: str = "seq", name: str = "article") -> DataFrame:
    """Add the metadata struct of the article record with the item's DOI, whatever its letter case.

    Only joined records are parsed. Of several records for one DOI the smallest text is used.
    """
    records = asked_records(articles, items, "doi").select(F.col("_key").alias("_folded"), F.col("record").alias("_record"))
    rows = lookup(items.withColumn("_folded", F.lower("doi")), records, "_folded", row_id)
    return with_article(rows.drop("_folded"), "_record", name).drop("_record")


def resolve_by_isbn(
    items: DataFrame, books_a: DataFrame, books_b: DataFrame, row_id: str = "seq", name: str = "book"
) -> DataFrame:
    """Add the metadata struct of the item's ISBN: the first book source, else the second.

    The sources may repeat an ISBN; the smallest record counts. Only records that items ask for are moved.
    """
    rows = items.withColumn("_folded", F.lower("isbn"))
    for side, source in (("_a", books_a), ("_b", books_b)):
        records = asked_records(source, items, "isbn").select(F.col("_key").alias("_folded"), F.col("record").alias(side))
        rows = lookup(rows, records, "_folded", row_id)
    rows = rows.drop("_folded")
    item_b = F.get(F.from_json(F.col("_b"), _BOOK_B)["items"], F.lit(0))
    rows = rows.withColumns({"_a": F.try_parse_json(F.col("_a")), "_b": item_b})
    both = F.coalesce(_book_meta_a(F.col("isbn"), F.col("_a")), _book_meta_b(F.col("isbn"), F.col("_b")))
    return rows.withColumn(name, both).drop("_a", "_b")


def guess_meta(file_name: Column, xmp_title: Column, xmp_author: Column) -> Column:
    """Metadata without any lookup: embedded title, else the file name."""
    title, author = ids.usable_title(xmp_title), filled(xmp_author)
    has_title = title.isNotNull()
    return meta(
        title=F.coalesce(title, or_empty(file_name)),
        authors=F.when(has_title & author.isNotNull(), F.array(author)).otherwise(no_strings()),
        metadata_source=F.when(has_title, F.lit("xmp")).otherwise(F.lit("filename")),
        needs_review=F.lit(True),
    )


def resolve_metadata(
    items: DataFrame,
    articles: DataFrame,
    books_a: DataFrame,
    books_b: DataFrame,
    row_id: str = "seq",
    title_matches: DataFrame | None = None,
) -> DataFrame:
    """Add ``meta`` to items with (doi, isbn, file_name, xmp_title, xmp_author): DOI record, ISBN record, guess.

    ``title_matches`` holds (row_id, record_doi, record) of documents whose title was found among the records.
    """
    rows = resolve_by_doi(items, articles, row_id)
    asked = rows.withColumn("_isbn", F.col("isbn")).withColumn("isbn", F.when(F.col("article").isNull(), F.col("isbn")))
    rows = resolve_by_isbn(asked, books_a, books_b, row_id).withColumn("isbn", F.col("_isbn")).drop("_isbn")
    sources = [F.col("article"), F.col("book")]
    if title_matches is not None:
        found = with_article(title_matches, "record", "matched", "record_doi").select(row_id, "matched")
        rows = rows.join(found, row_id, "left")
        sources.append(F.col("matched"))
    guess = guess_meta(F.col("file_name"), F.col("xmp_title"), F.col("xmp_author"))
    return rows.withColumn("meta", F.coalesce(*sources, guess)).drop("article", "book", "matched")


def _oa_url(record: Column) -> Column:
    place = lambda name: F.get_json_object(record, f"$.best_oa_location.{name}")
    return first_filled(place("url_for_pdf"), place("url"))


def best_oa_location(oa_records: DataFrame) -> DataFrame:
    """Best open document address per DOI, or the reason there is none. Of several records for one DOI, whatever its
    letter case, the smallest counts."""
    one = oa_records.where(F.col("doi").isNotNull()).groupBy(F.lower("doi")).agg(F.min("doi").alias("doi"), F.min("record").alias("record"))
    url = _oa_url(F.col("record"))
    return one.select("doi", url.alias("oa_url"), F.when(url.isNull(), F.lit("no_oa_pdf")).alias("reason"))


def with_oa_location(items: DataFrame, oa_records: DataFrame, row_id: str = "seq") -> DataFrame:
    """Add ``oa_url``, the best open document address of the item's DOI, whatever its letter case."""
    records = asked_records(oa_records, items, "doi").select(F.col("_key").alias("_folded"), F.col("record").alias("_oa"))
    rows = lookup(items.withColumn("_folded", F.lower("doi")), records, "_folded", row_id)
    return rows.withColumn("oa_url", _oa_url(F.col("_oa"))).drop("_folded", "_oa")


def merge_lookup(papers: DataFrame, fetched: DataFrame, now: str) -> DataFrame:
    """Papers with the non-empty fields of a fetched row (id and metadata fields) written over them. Of rows that repeat
    an id the last counts, by ``seq`` where there is one."""
    new = {c: f"_new_{c}" for c in META_TYPES}
    side = last_of_each(fetched.select("id", *META_TYPES, *(["seq"] if "seq" in fetched.columns else []))).select("id", *[F.col(c).alias(n) for c, n in new.items()], F.lit(True).alias("_hit"))
    rows = papers.join(side, "id", "left")

    def merged(c: str) -> Column:
        old, value = F.col(c), F.col(new[c])
        if c == "metadata_source":
            return F.when(F.col("_hit"), value).otherwise(old)
        if c == "needs_review":
            return F.when(F.col("_hit"), F.lit(False)).otherwise(old)
        if c == "document_type":
            value = F.nullif(filled(value), F.lit("article"))
        elif META_TYPES[c] == "array<string>":
            value = F.when(F.size(value) > 0, value)
        elif c == "year":
            value = F.nullif(value, F.lit(0))
        else:
            value = filled(value)
        return F.coalesce(value, old)

    rows = rows.withColumns({c: merged(c) for c in META_TYPES})
    stamp = F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("date_modified"))
    return rows.withColumn("date_modified", stamp).select(*papers.columns)


def abstract_fallback(fetched: DataFrame, page_rows: DataFrame, row_id: str = "id") -> DataFrame:
    """Fetched rows without an abstract take the one of the page with the same DOI."""
    usable = page_rows.where(F.col("doi").isNotNull() & (or_empty(F.col("abstract")) != ""))
    pages = usable.groupBy("doi").agg(F.min_by("abstract", "page_id").alias("_page_abstract"))
    rows = lookup(fetched, pages, "doi", row_id)
    return rows.withColumn("abstract", or_empty(first_filled(F.col("abstract"), F.col("_page_abstract")))).drop(
        "_page_abstract"
    )


def page_import_outcomes(
    metadata: DataFrame, papers: DataFrame, articles: DataFrame, oa_records: DataFrame, row_id: str = "seq"
) -> DataFrame:
    """Outcome of importing landing pages from their verified metadata.

    Adds ``ok``, ``reason``, ``duplicate``, ``meta`` and ``open_access``.
    """
    # Read by several look-ups below; the pages themselves are not part of it.
    rows = lookup(written(metadata, "page-rows"), known(papers, "doi", "_known"), "doi", row_id)
    rows = resolve_by_doi(rows, articles, row_id)
    rows = with_oa_location(rows, oa_records, row_id)
    has_pdf, has_oa = F.col("pdf_url").isNotNull(), F.col("oa_url").isNotNull()
    scraped = meta(**{c: F.col(c) for c in META_TYPES})
    file_name = F.concat(F.regexp_replace(or_empty(F.col("doi")), r'[/\\:*?"<>|]', "_"), F.lit(".pdf"))
    unresolved = guess_meta(file_name, F.lit(None).cast("string"), F.lit(None).cast("string"))
    reason = F.when(has_pdf | (F.col("doi").isNotNull() & has_oa), None).when(
        F.col("doi").isNotNull(), F.lit("no_oa_pdf")
    ).otherwise(F.lit("no_doi_no_pdf"))
    found = F.coalesce(F.col("article"), F.when(has_pdf, scraped).otherwise(unresolved))
    return rows.withColumns(
        {
            "duplicate": F.coalesce(F.col("_known"), F.lit(False)),
            "ok": reason.isNull(),
            "reason": reason,
            "open_access": F.when(has_pdf, F.col("open_access")).otherwise(F.lit(True)),
            "meta": F.when(reason.isNull(), found),
        }
    ).drop("_known", "article", "oa_url")

"""DOI, ISBN, year and title expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import SPACE, extracted, filled, or_empty, strip_ws

# Patterns and word lists that decide what counts as an identifier.
DOI_ANYWHERE = r"(10\.\d{4,9}/[^" + SPACE + r"\"<>{|}\\^\[\]`]+)"
DOI = r"\b" + DOI_ANYWHERE
DOI_START = r"^10\.\d{4,9}/"
DOI_TAIL = r"[.,;)>\"']+$"
DOI_RESOLVER = r"^https?://(?:dx\.)?doi\.org/"
ISBN_LABELLED = r"(?i)(?:ISBN(?:-1[03])?[:\s]*)((?:97[89][- ]?)?(?:\d[- ]?){9}[\dX])"
ISBN_BARE = r"\b(97[89]\d{10})\b"
YEAR = r"\b(1[89]\d\d|20\d\d)\b"
MARKUP = r"<[^>]+>"
JUNK_TITLES = ["untitled", "untitled document", "microsoft word", "word document", ""]
LEAD_PAGES = 3
LEAD_LINES = 100
TITLE_LINES = 20
TITLE_MIN_CHARS = 20


def first_doi(text: Column) -> Column:
    """First DOI of a text without its trailing punctuation, else NULL."""
    return filled(F.regexp_replace(F.regexp_extract(text, DOI, 1), DOI_TAIL, ""))


def normalise_doi(raw: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip_ws(raw), DOI_RESOLVER, ""), DOI_TAIL, "")
    return extracted(bare, DOI_ANYWHERE)


def valid_doi(doi: Column) -> Column:
    return doi.rlike(DOI_START)


def lead_text(page_texts: Column) -> Column:
    """The first pages as one text, a newline between pages."""
    return F.array_join(F.slice(page_texts, 1, LEAD_PAGES), "\n")


def first_page(page_texts: Column) -> Column:
    return or_empty(F.try_element_at(page_texts, F.lit(1)))


def tiered_doi(page_texts: Column, xmp_subject: Column, xmp_keywords: Column) -> Column:
    """First lines of the lead pages, else the whole first page, else embedded metadata."""
    lead = F.substring_index(lead_text(page_texts), "\n", LEAD_LINES)
    return F.coalesce(
        first_doi(lead), first_doi(first_page(page_texts)), first_doi(xmp_subject), first_doi(xmp_keywords)
    )


def normalise_isbn(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, "[- ]", ""))


def tiered_isbn(page_texts: Column) -> Column:
    lead = lead_text(page_texts)
    return normalise_isbn(F.coalesce(extracted(lead, ISBN_LABELLED), extracted(lead, ISBN_BARE)))


def pick_isbn(raw_list: Column) -> Column:
    """The first 13-digit form if there is one, else the first of the list."""
    clean = F.transform(raw_list, normalise_isbn)
    long_form = F.filter(clean, lambda x: x.startswith("978") | x.startswith("979"))
    return F.coalesce(F.get(long_form, F.lit(0)), F.get(clean, F.lit(0)))


def parse_year(text: Column) -> Column:
    return F.regexp_extract(text, YEAR, 1).try_cast("int")


def strip_markup(text: Column) -> Column:
    return strip_ws(F.regexp_replace(text, MARKUP, ""))


def candidate_title(page_text: Column) -> Column:
    """Longest of the first non-blank lines that looks like a title; the earlier line wins a tie."""
    lines = F.filter(F.transform(F.split(page_text, "\n"), strip_ws), lambda x: x != "")
    head = F.slice(lines, 1, TITLE_LINES)
    scored = F.transform(head, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("rank"), x.alias("line")))
    usable = F.filter(scored, lambda s: (s["n"] >= TITLE_MIN_CHARS) & F.contains(s["line"], F.lit(" ")))
    return or_empty(F.array_max(usable)["line"])


def junk_title(title: Column) -> Column:
    return F.lower(strip_ws(or_empty(title))).isin(JUNK_TITLES)


def usable_title(title: Column) -> Column:
    """The trimmed title, NULL when it is a placeholder of the writing tool."""
    return F.when(~junk_title(title), strip_ws(title))


def split_trimmed(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), strip_ws), lambda x: x != "")


def split_authors(text: Column) -> Column:
    return split_trimmed(text, ";")


def join_authors(authors: Column) -> Column:
    return F.array_join(authors, "; ")


def split_keywords(lists: Column) -> Column:
    """Several comma-separated texts to one flat list."""
    return F.flatten(F.transform(lists, lambda x: split_trimmed(x, ",")))



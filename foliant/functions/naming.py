"""File-name planning: where a document goes below the library root."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import or_empty, strip_ws

# Characters a file name may not hold, the length limit and the default layout.
ILLEGAL = r'[/:*?"<>|\\]'
MAX_PART = 80
DEFAULT_PATTERN = "{journal}/{year}/{author} ({year}) {title}.pdf"
UNRESOLVED_SOURCES = ["xmp", "filename"]


def fs_safe(text: Column, limit: int = MAX_PART) -> Column:
    return strip_ws(F.substring(F.regexp_replace(text, ILLEGAL, "_"), 1, limit))


def author_short(authors: Column) -> Column:
    """Family name of the first author, with ``et al`` for more than two authors."""
    lead = or_empty(F.get(authors, F.lit(0)))
    name = F.when(F.contains(lead, F.lit(",")), strip_ws(F.substring_index(lead, ",", 1))).otherwise(
        F.regexp_extract(lead, r"(\S+)", 1)
    )
    full = F.when(F.size(authors) > 2, F.concat(name, F.lit(" et al"))).otherwise(name)
    return F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, F.lit("Unknown")).otherwise(full)


def journal_safe(journal: Column) -> Column:
    return F.when(strip_ws(or_empty(journal)) == "", F.lit("Unsorted")).otherwise(fs_safe(journal))


def year_text(year: Column) -> Column:
    """The year as text; 0 and NULL both mean there is none."""
    return F.when(F.coalesce(year, F.lit(0)) == 0, F.lit("Unknown")).otherwise(year.cast("string"))


def patterned_path(pattern: str, journal: Column, year: Column, author: Column, title: Column) -> Column:
    """Fill a layout. Values are put between the literal parts, so braces inside a title stay as they are."""
    values = {"{journal}": journal, "{year}": year, "{author}": author, "{title}": title}
    parts = [p for p in re.split(r"(\{journal\}|\{year\}|\{author\}|\{title\})", pattern) if p]
    return F.concat(*[values.get(p, F.lit(p)) for p in parts])


def destination_path(
    root: str,
    source_name: Column,
    metadata_source: Column,
    journal: Column,
    year: Column,
    authors: Column,
    title: Column,
    pattern: str = DEFAULT_PATTERN,
) -> Column:
    planned = patterned_path(
        pattern, journal_safe(journal), year_text(year), fs_safe(author_short(authors)), fs_safe(or_empty(title))
    )
    relative = F.when(
        metadata_source.isin(UNRESOLVED_SOURCES), F.concat(F.lit("Unsorted/"), source_name)
    ).otherwise(planned)
    return F.concat(F.lit(root.rstrip("/") + "/"), relative)


def mirror_path(path: Column, root: str, second_root: str) -> Column:
    """The same relative path under a second root, NULL for paths outside the first."""
    base = root.rstrip("/") + "/"
    return F.when(
        path.startswith(base), F.concat(F.lit(second_root.rstrip("/") + "/"), F.substring(path, len(base) + 1, 1 << 30))
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)

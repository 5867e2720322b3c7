"""Tags and linked data of raw web pages as array expressions: pages stay one row each, nothing is exploded."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import filled, no_strings, strip_ws

# The shapes of tags and attributes.
# Scripts, styles and comments, whichever begins first: what looks like one of them inside another is text there.
UNSEEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
META = r"(?i)<meta\b[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>"
ATTRIBUTE = r"([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
LINKED_DATA = r"(?is)^<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"
# The named entities of the web, from the standard library's table.
ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
_ENTITY_TEXT = "\u0001".join(f"{name}\u0002{text}" for name, text in ENTITIES.items())
NAMED = r"(?s)^([A-Za-z][A-Za-z0-9]{1,31});(.*)$"
NUMBERED = r"(?is)^#(x[0-9a-f]{1,6}|[0-9]{1,7});(.*)$"
LAST_CHARACTER = 0x10FFFF


def decoded(text: Column) -> Column:
    """Decode ``&eacute;``, ``&#8211;`` and ``&#x2013;`` in one pass; what names no character stays as it is."""
    pieces = F.split(text, "&")
    table = F.str_to_map(F.lit(_ENTITY_TEXT), F.lit("\u0001"), F.lit("\u0002"))  # a constant, made once per plan

    def piece(p: Column) -> Column:
        number = F.lower(F.regexp_extract(p, NUMBERED, 1))
        digits = F.when(number.startswith("x"), F.substring(number, 2, 6)).otherwise(F.hex(number.try_cast("bigint")))
        code = F.conv(digits, 16, 10).try_cast("bigint")
        real = F.coalesce((code > 0) & (code <= LAST_CHARACTER) & ~code.between(0xD800, 0xDFFF), F.lit(False))
        char = F.decode(F.unhex(F.lpad(F.when(real, digits).otherwise("41"), 8, "0")), "UTF-32")
        named = F.try_element_at(table, F.regexp_extract(p, NAMED, 1))
        return (
            F.when(real, F.concat(char, F.regexp_extract(p, NUMBERED, 2)))
            .when(named.isNotNull(), F.concat(named, F.regexp_extract(p, NAMED, 2)))
            .otherwise(F.concat(F.lit("&"), p))
        )

    whole = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _attributes(tag: Column) -> Column:
    """Names (lower case) and raw values of the attributes of a tag, in order."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2))
    return F.struct(names.alias("names"), values.alias("values"))


def _value(attributes: Column, name: str) -> Column:
    """Value of an attribute, NULL when absent. The first of equal names counts."""
    at = F.nullif(F.array_position(attributes["names"], F.lit(name)), F.lit(0)).cast("int")
    return decoded(F.regexp_replace(F.get(attributes["values"], at - 1), "^[\"']|[\"']$", ""))


def meta_tags(html: Column) -> Column:
    """``array<struct<name, property, content>>`` in page order; content is trimmed, NULL when absent."""
    visible = F.regexp_replace(html, UNSEEN, "")
    tags = F.transform(F.regexp_extract_all(visible, F.lit(META), F.lit(0)), _attributes)
    return F.transform(
        tags,
        lambda t: F.struct(
            _value(t, "name").alias("name"),
            _value(t, "property").alias("property"),
            strip_ws(_value(t, "content")).alias("content"),
        ),
    )


def first_content(tags: Column, key: str, kind: str = "name") -> Column:
    """Content of the first tag of that name; an empty first tag means no value."""
    return filled(F.get(F.filter(tags, lambda t: t[kind] == key), F.lit(0))["content"])


def all_contents(tags: Column, key: str) -> Column:
    """Non-empty contents of every tag of that name."""
    mine = F.filter(tags, lambda t: (t["name"] == key) & (F.coalesce(t["content"], F.lit("")) != ""))
    return F.transform(mine, lambda t: t["content"])


def variants(name: str) -> list[str]:
    """A name as given, in lower and in upper case, each once."""
    return list(dict.fromkeys([name, name.lower(), name.upper()]))


def linked_data_blocks(html: Column) -> Column:
    elements = F.filter(F.regexp_extract_all(html, F.lit(UNSEEN), F.lit(0)), lambda e: e.rlike(LINKED_DATA))
    found = F.transform(elements, lambda e: F.regexp_extract(e, LINKED_DATA, 1))
    return F.when(F.contains(html, F.lit("application/ld+json")), found).otherwise(no_strings())

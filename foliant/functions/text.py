"""Small text expressions used everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What counts as white space inside a character class, with the blanks that PDFs and the web bring.
SPACE = "\\s\u00a0\u2000-\u200a\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Drop white space at both ends (``trim`` alone drops blanks only)."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def filled(c: Column) -> Column:
    """NULL for missing and empty text, so that ``coalesce`` can take the next source."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First non-empty of ordered sources, NULL when all are empty."""
    return F.coalesce(*[filled(c) for c in cols])


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, NULL when there is no match."""
    return filled(F.regexp_extract(c, pattern, group))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def spread_out(df: DataFrame, array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per element of a computed array; rows without elements give none.

    A plain ``explode`` makes the optimiser add a test of the array's size below it, which computes the array twice.
    The outer form followed by a filter computes it once.
    """
    if pos is None:
        return df.select("*", F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
    return df.select("*", F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())

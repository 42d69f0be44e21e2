"""Text column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketfeat.functions.markup import decode_entities


def python_strip(col: Column) -> Column:
    """Trim every kind of white space at both ends, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def normalize_title(col: Column) -> Column:
    """Lower case, only a-z, 0-9 and white space kept, runs of white space as one blank.

    Titles without any such character share the empty key.
    """
    kept = F.regexp_replace(F.lower(col), r"(?U)[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def normalize_url(col: Column) -> Column:
    """Key of a URL: trimmed, without trailing slashes, lower case."""
    return F.lower(F.regexp_replace(python_strip(col), r"/+$", ""))


def canonical_url(col: Column) -> Column:
    """URL without its query and without trailing slashes."""
    return F.regexp_replace(F.element_at(F.split(col, r"\?"), 1), r"/+$", "")


def symbol_clean(col: Column) -> Column:
    """Trim, upper case, without one exchange suffix."""
    return F.regexp_replace(F.upper(python_strip(col)), r"[.](KA|PK)$", "")


def primary_label(col: Column) -> Column:
    """First label of a pipe-separated list."""
    return F.element_at(F.split(col, r"\|"), 1)


def plain_text(html: Column) -> Column:
    """Text of an HTML fragment: tags dropped, entities decoded, trimmed."""
    return python_strip(decode_entities(F.regexp_replace(html, r"(?s)<[^>]*>", "")))

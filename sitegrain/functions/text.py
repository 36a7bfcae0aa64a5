"""Keyword and label expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_keywords(words: Iterable[str | None]) -> tuple[str, ...]:
    """Trimmed, lower-cased, distinct keywords in a stable order."""
    return tuple(sorted({w.strip().lower() for w in words if w and w.strip()}))


def mentions_any(text: Column, words: Iterable[str]) -> Column:
    """True where the lower-cased text holds at least one keyword; false for no keywords."""
    keys = clean_keywords(words)
    if not keys:
        return F.lit(False)
    # One alternation of quoted keywords instead of a chain of tests.
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(k) for k in keys)), F.lit(False))


def sql_strings(values: Iterable[str]) -> str:
    """Texts as a comma list of SQL literals."""
    quoted = (v.replace("\\", "\\\\").replace("'", "\\'") for v in values)
    return ", ".join(f"'{v}'" for v in quoted)


def category_text(name: str = "category_name", label: str = "category_label") -> Column:
    """The searchable text of a category: its name and label, blanks for nulls."""
    blank = F.lit("")
    return F.concat(F.coalesce(F.col(name), blank), F.lit(" | "), F.coalesce(F.col(label), blank))


def area_label(suburb: str = "sal_name_2021", region: str = "sa2_name_2021") -> Column:
    """``suburb • region``, whichever of the two exists, or a fixed text."""
    parts = F.concat_ws(" • ", *[F.nullif(F.col(c), F.lit("")) for c in (suburb, region)])
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("Unknown area"))

"""String predicates."""

from __future__ import annotations

from pyspark.sql import Column


def is_blank(text: Column) -> Column:
    """Whether a string is empty or white space only; null stays null."""
    return text.rlike(r"^\s*$")

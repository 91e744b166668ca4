"""Words of a text column by Spark functions."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, separators: str) -> Column:
    """The runs without ``separators`` (a character class) in lower-cased text; none of a null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"{separators}+"), "")

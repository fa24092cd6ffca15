"""Words of whole texts in Spark expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII separators and capitals (texts are lower-cased first).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


#: What stands between words, in a text that need not be lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def count_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    edges = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when(F.get(parts, F.size(parts) - F.lit(1)) == "", 1).otherwise(0)
    return F.greatest(F.size(parts) - edges, F.lit(0)).cast("long")

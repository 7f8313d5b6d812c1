"""Text functions as Column expressions, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def fingerprint(*fields: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", *fields), 256), 1, length)


def ascii_pattern(pattern: str) -> str:
    r"""``pattern`` for ``rlike`` as RE2 reads it: ``\b``, at its ends and beside a word's character only, by ASCII words, and ``[^\s]`` without ASCII blanks.

    Java takes accented letters and marks as parts of words in ``\b`` and the vertical tab as a blank."""
    if pattern.startswith(r"\b"):
        pattern = "(?<![0-9A-Za-z_])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + "(?![0-9A-Za-z_])"
    return pattern.replace(r"[^\s]", r"[^\t\n\f\r ]")

"""Seeded rewrites of texts: typos, mojibake, cuts, shortening, contrast words. All stay inside the JVM; the same seed gives the same text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each letter and a neighbour of it on a QWERTY keyboard.
KEYS = "abcdefghijklmnopqrstuvwxyz"
NEIGHBOURS = "snvfrdghujklbmiowetyuvczts"


def number(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 7), 16, 10).cast("long")


def mistype(word: Column, seed: str) -> Column:
    """One letter replaced by its neighbour, at a place that depends on seed and word; other characters stay."""
    at = (number(F.lit(seed), word) % F.greatest(F.length(word), F.lit(1)) + 1).cast("int")
    return F.concat(F.substring(word, F.lit(1), at - 1), F.translate(F.substring(word, at, F.lit(1)), KEYS, NEIGHBOURS), F.substring(word, at + 1, F.length(word)))


def mojibake(text: Column) -> Column:
    """UTF-8 bytes read as Latin-1."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def truncate(text: Column, seed: str, key: Column, least: int = 5) -> Column:
    return F.substring(text, F.lit(1), F.greatest(F.lit(least), (number(F.lit(seed), key) % F.greatest(F.length(text), F.lit(1))).cast("int")))


def corrupt(words: Column, degree: int, seed: str) -> Column:
    """``degree`` of the words mistyped: those whose hashes are smallest."""
    ranks = F.array_sort(F.transform(words, lambda w: F.md5(F.concat(F.lit(seed), w))))
    bar = F.try_element_at(ranks, F.least(F.lit(degree), F.size(words)))
    return F.transform(words, lambda w: F.when(F.md5(F.concat(F.lit(seed), w)) <= bar, mistype(w, seed)).otherwise(w))


def shorten(words: Column, stopwords: Sequence[str], gold: Column, protected: Column, most: int) -> Column:
    """At most ``most`` words: without stopwords, then without words that the gold text lacks; protected words stay."""
    stop = F.array(*map(F.lit, stopwords))
    first = F.filter(words, lambda w: F.array_contains(protected, w) | ~F.array_contains(stop, w))
    second = F.filter(first, lambda w: F.array_contains(protected, w) | F.array_contains(gold, w))
    return F.slice(F.when(F.size(words) <= most, words).when(F.size(first) <= most, first).otherwise(second), 1, most)


def swap(words: Column, target: Column, anchor: str) -> Column:
    return F.transform(words, lambda w: F.when(w == target, F.lit(anchor)).otherwise(w))

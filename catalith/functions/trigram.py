"""Trigram similarity of short strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarity from which two strings count as alike.
ALIKE = 0.3


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a string in lower case, each padded by two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigrams_of(text: str) -> list[str]:
    """The same of one string, on the driver."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(p[i : i + 3] for w in words for p in [f"  {w} "] for i in range(len(w) + 1)))


def similarity_of(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; ``a`` and ``b`` are arrays of ``trigrams``."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return similarity_of(trigrams(a), trigrams(b))


def distance(a: Column, b: Column) -> Column:
    return 1 - similarity(a, b)

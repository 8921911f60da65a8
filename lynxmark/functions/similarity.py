"""Likeness of two texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lynxmark.functions.text import java_trim


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(java_trim(c), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words; 0 with a null or without words."""
    x, y = token_set(a), token_set(b)
    both = F.size(F.array_union(x, y))
    return F.coalesce(F.when(both > 0, F.size(F.array_intersect(x, y)) / both), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are alike."""
    longer = F.greatest(F.length(F.coalesce(a, F.lit(""))), F.length(F.coalesce(b, F.lit(""))))
    return F.when(longer > 0, 1.0 - distance(a, b) / longer).otherwise(1.0)

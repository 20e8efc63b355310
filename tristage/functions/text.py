"""Column functions over page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def numbers(text: Column) -> Column:
    """Numbers with an optional decimal part, comma or point; groups of three digits may stand apart (row 041)."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]{1,3}(?:[ \u00a0][0-9]{3})+(?![0-9])(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "[ \u00a0]", ""), ",", ".").try_cast("double"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \n]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct items; 0 if both are empty (row 357)."""
    shared, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(0.0)).otherwise(shared / all_)


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller set that both have; null if a side is empty (row 199)."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one has no length (row 343)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))

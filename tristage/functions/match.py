"""Matches of patterns with their places, in built-in functions: what regexp_extract_all leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(df: DataFrame, condition: Column) -> DataFrame:
    """df's rows that meet the condition, as where() gives them, but on the columns that df has reckoned.

    Spark moves a where() below the columns it asks for and puts their expressions in their place, over all steps at
    once; where one step uses another several times, the work multiplies with each. A generator stays where it stands.
    """
    return df.withColumn("_only", F.explode(F.when(condition, F.array(F.lit(True))))).drop("_only")


def each(array: str) -> Column:
    """explode() of a column, likewise without a filter that Spark would put before it and move down."""
    return F.explode(F.when(F.size(array) > 0, F.col(array)))


def hits(text: Column, pattern: str, groups: list[str] | tuple[str, ...] = ()) -> Column:
    """An array of start, end, raw and the named groups, one struct for each match from left to right.

    The pieces between matches and the matches alternate, so running lengths give the offsets. A group that took no
    part is an empty string; a null text has no matches.
    """
    text = F.coalesce(text, F.lit(""))
    every = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    fields = ", ".join(f"{g}: string" for g in groups)
    kind = f"array<struct<start: int, end: int, raw: string{', ' + fields if fields else ''}>>"
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(every(0))).alias("_gap"), every(0).alias("raw"), *(every(i + 1).alias(g) for i, g in enumerate(groups)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + F.char_length(x["_gap"])
        end = start + F.char_length(x.raw)
        hit = F.struct(start.alias("start"), end.alias("end"), x.raw.alias("raw"), *(x[g].alias(g) for g in groups))
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(hit)).alias("out"))

    # texts without a match skip the walk
    return F.when(text.rlike(pattern), F.aggregate(zipped, zero, step, lambda acc: acc.out)).otherwise(F.array().cast(kind))


def before(text: Column, start: Column, n: int) -> Column:
    """At most n characters that stand before start."""
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def after(text: Column, end: Column, n: int) -> Column:
    return F.substring(text, end + 1, F.lit(n))


def snippet(text: Column, start: Column, end: Column, left: int = 30, right: int = 70) -> Column:
    """The match with what stands around it."""
    first = F.greatest(start - left, F.lit(0))
    return F.trim(F.substring(text, first + 1, end + right - first))

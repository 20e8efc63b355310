"""Column functions that bring marks, numbers, units and names to one spelling (rows 041 to 074)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit, its dimension, its size in the dimension's base unit.
UNITS = [("mm", "length", 0.001), ("cm", "length", 0.01), ("m", "length", 1.0), ("km", "length", 1000.0), ("g", "mass", 0.001), ("kg", "mass", 1.0), ("t", "mass", 1000.0)]


def number(text: Column) -> Column:
    """«29 200,00» as 29200.0; null if the text is no number (row 041)."""
    return F.regexp_replace(F.regexp_replace(text, "[ \u00a0\u202f]", ""), ",", ".").try_cast("double")


def location(text: Column) -> Column:
    """Numeric tokens joined by points, leading zeros gone (row 063)."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^0+([0-9])", "$1")), ".")


def fold(text: Column) -> Column:
    """Lower case, one letter for two that are mixed up, one dash (row 050)."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "ё", "е"), "[‐-―−]", "-")


def revision_key(name: Column) -> tuple[Column, Column]:
    """Base name and revision number of a file name (row 070)."""
    pattern = r"^(.*?)(?:[_ -]rev\.?([0-9]+))?\.[A-Za-z0-9]+$"
    number_ = F.regexp_extract(name, pattern, 2)
    return F.regexp_extract(name, pattern, 1), F.when(number_ == "", 0).otherwise(number_.cast("int"))


def edition_year(reference: Column, pivot: int = 30) -> Column:
    """The trailing year of a reference; two digits belong to 2000 up to the pivot (row 074)."""
    year = F.regexp_extract(reference, r"-([0-9]{4}|[0-9]{2})$", 1)
    n = year.cast("int")
    return F.when(F.length(year) == 4, n).when(F.length(year) == 2, F.when(n < pivot, 2000 + n).otherwise(1900 + n))


def convert(rows: DataFrame, value: str, found: str, wanted: str) -> DataFrame:
    """rows with `converted`, rounded to 6 places; null between dimensions (row 044). The unit table is fixed."""
    units = rows.sparkSession.createDataFrame(UNITS, "unit string, dimension string, size double")
    a = F.broadcast(units.select(F.col("unit").alias(found), F.col("dimension").alias("_a"), F.col("size").alias("_x")))
    b = F.broadcast(units.select(F.col("unit").alias(wanted), F.col("dimension").alias("_b"), F.col("size").alias("_y")))
    out = rows.join(a, found, "left").join(b, wanted, "left")
    return out.withColumn("converted", F.when(F.col("_a") == F.col("_b"), F.round(F.col(value) * F.col("_x") / F.col("_y"), 6))).drop("_a", "_b", "_x", "_y")


def masked_shingles(text: Column, n: int = 3) -> Column:
    """Distinct word n-grams with numbers as # (row 061)."""
    w = F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"[ \n]+"), lambda x: x != "")
    return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))

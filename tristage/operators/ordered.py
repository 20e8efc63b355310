"""Operators over an order: runs, gaps, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: list[str], place: str, number: str, gap: int = 5) -> DataFrame:
    """Runs with a constant offset between place and number and small gaps, longer than one (row 321). Rows without a
    number are skipped."""
    w = Window.partitionBy(*by).orderBy(place)
    offset = F.col(place) - F.col(number)
    new = F.coalesce((offset != F.lag(offset).over(w)) | (F.col(place) - F.lag(place).over(w) > gap), F.lit(True))
    island = rows.where(F.col(number).isNotNull()).withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "run").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("n > 1")


def check(rows: DataFrame, by: list[str], place: str, number: str, gap: int = 5) -> DataFrame:
    """rows with sheet_check and the number, which a conflict clears (row 322).

    A reading whose offset to its place equals that of the reading before or after it, at most gap places away, is
    CONFIRMED; if both of these agree against it, it is a CONFLICT; else UNCONFIRMED. Rows without a number: null.
    """
    w = Window.partitionBy(*by).orderBy(place)
    known = F.col(number).isNotNull()
    offset = F.when(known, F.struct(F.col(place).alias("p"), (F.col(place) - F.col(number)).alias("o")))
    before = F.last(offset, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first(offset, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = lambda c: F.when(F.abs(F.col(place) - c.p) <= gap, c.o)
    out = rows.withColumn("_o", F.col(place) - F.col(number)).withColumn("_b", before).withColumn("_f", behind)
    left, right = near(F.col("_b")), near(F.col("_f"))
    agree = F.coalesce(left == F.col("_o"), F.lit(False)) | F.coalesce(right == F.col("_o"), F.lit(False))
    state = F.when(agree, "CONFIRMED").when(F.coalesce(left == right, F.lit(False)), "CONFLICT").otherwise("UNCONFIRMED")
    out = out.withColumn("sheet_check", F.when(known, state)).drop("_o", "_b", "_f")
    return out.withColumn(number, F.when(F.col("sheet_check").eqNullSafe("CONFLICT"), None).otherwise(F.col(number)))


def accept_weak(rows: DataFrame, by: list[str], place: str, number: str, weak: str, gap: int = 5) -> DataFrame:
    """rows with weak readings taken for the number where the nearest strong reading before or after, at most gap places
    away, has the same offset (row 324). accepted tells which."""
    w = Window.partitionBy(*by).orderBy(place)
    strong = F.when(F.col(number).isNotNull(), F.struct(F.col(place).alias("p"), (F.col(place) - F.col(number)).alias("o")))
    out = rows.withColumn("_b", F.last(strong, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_f", F.first(strong, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    same = lambda c: F.coalesce((F.abs(F.col(place) - c.p) <= gap) & (c.o == F.col(place) - F.col(weak)), F.lit(False))
    taken = F.col(number).isNull() & F.col(weak).isNotNull() & (same(F.col("_b")) | same(F.col("_f")))
    return out.withColumn("accepted", taken).withColumn(number, F.when(taken, F.col(weak)).otherwise(F.col(number))).drop("_b", "_f")


def fill(rows: DataFrame, by: list[str], place: str, number: str, anchor: Column, most: int = 10) -> DataFrame:
    """rows with numbers inferred between two anchors of one offset at most `most` places apart, and `inferred` (row 323).

    anchor: the condition of a row that may hold a gap's end; it must have a number.
    """
    w = Window.partitionBy(*by).orderBy(place)
    at = F.when(anchor & F.col(number).isNotNull(), F.struct(F.col(place).alias("p"), (F.col(place) - F.col(number)).alias("o")))
    out = rows.withColumn("_b", F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_f", F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    inside = F.col(number).isNull() & (F.col("_b.o") == F.col("_f.o")) & (F.col("_f.p") - F.col("_b.p") <= most)
    inferred = F.coalesce(inside, F.lit(False))
    return out.withColumn("inferred", inferred).withColumn(number, F.when(inferred, F.col(place) - F.col("_b.o")).otherwise(F.col(number))).drop("_b", "_f")


def neighbours(rows: DataFrame, by: list[str], number: str, gap: int = 3) -> DataFrame:
    """Distinct numbers with those present just before and after, if not farther than gap (row 326)."""
    w = Window.partitionBy(*by).orderBy(number)
    out = rows.select(*by, number).distinct()
    near = lambda c: F.when(F.abs(c - F.col(number)) <= gap, c)
    return out.withColumn("previous", near(F.lag(number).over(w))).withColumn("following", near(F.lead(number).over(w)))

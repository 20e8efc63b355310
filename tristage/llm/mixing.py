"""Mixing sources to target weights.

Every document gets a key that looks random, the MD5 of seed, id and text. Within a source documents stand in order of
their keys; a source's budget takes as many whole epochs over it as fit, and of the next epoch the first words in that
order, so that the cut falls on the exact word. Prefix sums are distributed: keys are uniform, so their first hex digits
cut every source, however large, into slices of like size; slices are summed first, and a document's place is what
stands in the slices before its own and before it in its own.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

WORD = "[^\\x20\\x09-\\x0D]+"
#: Hex digits of the key that name a slice: 4,096 slices a source.
DIGITS = 3
_BY = ["_s", "_null"]


def sized(docs: DataFrame, seed: str = "11") -> DataFrame:
    """doc_id, source, size (words; 0 for a null text) and key of every document, as a written table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    return save(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key")), "sized")


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with sums of columns over all rows before each, in an order that leaves no ties open.

    Rows are dealt by ranges and written, so that ranges stay as they are; only one row a range meets in one task.
    """
    ranged = save(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = {name: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_b{i}") for i, (name, c) in enumerate(sums.items())}
    out = ranged.join(totals, "_range").select("*", *(c.alias(name) for name, c in place.items()))
    return out.drop("_range", *(f"_b{i}" for i in range(len(sums))))


def keyed(df: DataFrame) -> DataFrame:
    """With the source as two columns that are never null."""
    return df.withColumns({"_s": F.coalesce(F.col("source").cast("string"), F.lit("")), "_null": F.col("source").isNull()})


def sources(documents: DataFrame) -> DataFrame:
    """source and source_size, from sized()."""
    return documents.groupBy("source").agg(F.sum("size").alias("source_size"))


def cycled(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source and weight: weights in turn, sources by code point, null last."""
    order = [F.col("_null").asc(), F.col("_s").asc()]
    ranked = running(keyed(sizes.select("source")).withColumn("_one", F.lit(1)), order, {"_rank": "_one"})
    return ranked.select("source", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long").alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, percent: int = 150, epochs: int = 2) -> DataFrame:
    """source, source_size, target: percent of all words, shared by weight (positive integers).

    No target exceeds epochs times its source's size; what it can't take is shared again by weight among the others. In
    order of size over weight the sources that reach that limit come first, so prefix sums tell which ones do. A source
    without a weight has the target 0, and so has each if all are empty. If all reach their limit, the rest of the
    percentage stays untaken.
    """
    share = Fraction(percent, 100)
    up, down = share.numerator, share.denominator
    rows = keyed(sizes).join(keyed(weights).drop("source"), _BY, "left").withColumn("weight", F.coalesce(F.col("weight"), F.lit(0)).cast("long"))
    rows = rows.withColumn("_cap", F.col("source_size") * F.when(F.col("weight") > 0, epochs).otherwise(0))
    rows = rows.withColumn("_ratio", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")).otherwise(0.0))
    run = save(running(rows, [F.col("_ratio").asc(), F.col("_null").asc(), F.col("_s").asc()], {"_before": "_cap", "_passed": "weight"}), "targets")
    words, weight = (x or 0 for x in run.agg(F.sum("source_size"), F.sum("weight")).first())
    wide = lambda c: c.cast("decimal(19,0)")
    full = wide(F.lit(words * up) - down * F.col("_before")) * wide(F.col("weight")) >= wide(F.col("_cap")) * wide(F.lit(down) * (F.lit(weight) - F.col("_passed")))
    taken, passed = (x or 0 for x in run.where(full).agg(F.sum("_cap"), F.sum("weight")).first())
    rest = (F.col("weight") * F.lit(words * up - down * taken)).cast("double") / F.lit(float(down * max(weight - passed, 1)))
    return run.select("source", "source_size", F.when(full, F.col("_cap").cast("double")).otherwise(rest).alias("target"))


def mix(documents: DataFrame, goals: DataFrame) -> DataFrame:
    """documents (from sized()) with source_size, target, taken (words that the mix takes of it, repeats counted), epochs
    (how often it is taken whole) and part (words of one more time).

    A source's taken words are its target without its fraction. Null sources are one source; documents without words
    take none; repeated rows are documents each, and equal ones may change places; an empty table gives an empty result.
    """
    rows = keyed(documents).withColumn("_slice", F.substring("key", 1, DIGITS))
    by = [*_BY, "_slice"]
    slices = rows.groupBy(*by).agg(F.sum("size").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*_BY).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(*by, before.alias("_before")).join(keyed(goals).drop("source"), _BY)
    within = Window.partitionBy(*by).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("_before")
    out = rows.join(slices, by).withColumn("_start", start)
    budget, n = F.floor("target").cast("long"), F.col("source_size")
    epochs = F.when(n > 0, F.floor(budget / n).cast("long")).otherwise(0).cast("long")
    # the division is of doubles: mend the quotient where a budget is a multiple or next to one
    epochs = epochs - F.when(epochs * n > budget, 1).otherwise(0) + F.when((n > 0) & ((epochs + 1) * n <= budget), 1).otherwise(0)
    out = out.withColumn("epochs", epochs.cast("long"))
    left = budget - F.col("epochs") * n - F.col("_start")
    out = out.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    return out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).drop(*by, "_before", "_start")


def expand(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, with epoch (from 0), n_words and the text; of the
    last, if it is a part, the text up to its last word. doc_id must tell documents apart; other columns of docs stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = F.transform(F.sequence(F.lit(1), F.col("epochs")), lambda e: F.struct((e - 1).alias("epoch"), F.col("size").alias("n_words")))
    whole = F.when(F.col("epochs") > 0, whole).otherwise(F.array().cast("array<struct<epoch:bigint,n_words:bigint>>"))
    part = F.when(F.col("part") > 0, F.array(F.struct(F.col("epochs").alias("epoch"), F.col("part").alias("n_words")))).otherwise(F.array().cast("array<struct<epoch:bigint,n_words:bigint>>"))
    times = mixed.where("taken > 0").select("doc_id", "size", F.explode(F.concat(whole, part)).alias("_t")).select("doc_id", "size", "_t.*")
    rows = docs.drop("size", "epoch", "n_words").join(times, "doc_id")
    gaps, held = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    cut = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(F.slice(gaps, 1, F.col("n_words").cast("int")).alias("g"), F.slice(held, 1, F.col("n_words").cast("int")).alias("w")), lambda x: F.array(x.g, x.w))))
    return rows.withColumn("text", F.when(F.col("n_words") == F.col("size"), F.col("text")).otherwise(cut)).drop("size")

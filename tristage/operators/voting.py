"""From candidates to one value, or one set of values, for each parameter and stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def density(cands: DataFrame, page: list[str], code: str = "code") -> DataFrame:
    """page keys, density: distinct parameters found on a page. Counted before any filter (row 211)."""
    return cands.groupBy(*page).agg(F.countDistinct(code).alias("density"))


def weighted_vote(cands: DataFrame, by: list[str], page: list[str], value: str = "value", code: str = "code", dense: DataFrame | None = None) -> DataFrame:
    """One value for each group (row 212): the weight of a value is the sum of 1 + density over its distinct pages.

    Ties go to more pages, then to the smaller value. Pages are de-duplicated before they are summed, so that a page
    counts once however often it names the value; partial sums come before the one shuffle on the group. dense: the
    density of pages, if it was counted over more candidates than these.
    """
    seen = cands.select(*by, value, *page).distinct().join(density(cands, page, code) if dense is None else dense, page)
    votes = seen.groupBy(*by, value).agg(F.sum(1 + F.col("density")).alias("weight"), F.count("*").alias("pages"))
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), F.desc("pages"), F.asc(value))
    share = Window.partitionBy(*by)
    ranked = votes.withColumn("_rank", F.row_number().over(order)).withColumn("alternatives", F.count("*").over(share) - 1)
    return ranked.where("_rank = 1").drop("_rank")


def strongest_set(cands: DataFrame, by: list[str], binding: str, value: str = "value", page: list[str] | None = None, sheet: object = None) -> DataFrame:
    """Distinct values of the strongest binding of each group, ascending, and their support (row 214).

    binding: smaller is stronger; `sheet` names the one that counts only if nothing else is there. page: support counts
    distinct pages by them, else rows. Each binding is aggregated first, so no group's rows come to one task.
    """
    support = F.countDistinct(*page) if page else F.count("*")
    each = cands.groupBy(*by, binding).agg(F.sort_array(F.collect_set(value)).alias("values"), support.alias("support"))
    last = F.lit(False) if sheet is None else F.col(binding) == F.lit(sheet)
    best = each.groupBy(*by).agg(F.min(F.struct(last.alias("l"), F.col(binding).alias("b"), "values", "support")).alias("x"))
    return best.select(*by, F.col("x.b").alias(binding), F.col("x.values").alias("values"), F.col("x.support").alias("support"))


def doubtful(cands: DataFrame, by: list[str], raw: str = "raw", times: int = 3) -> DataFrame:
    """Rare readings one digit away from a reading seen `times` as often, of equal length (row 213)."""
    seen = cands.groupBy(*by, raw).agg(F.count("*").alias("n"))
    rare, often = seen.alias("r"), seen.alias("o")
    same = [F.col(f"r.{k}") == F.col(f"o.{k}") for k in by]
    apart = F.aggregate(F.zip_with(F.split(f"r.{raw}", ""), F.split(f"o.{raw}", ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    near = (F.length(f"r.{raw}") == F.length(f"o.{raw}")) & (F.col("o.n") >= times * F.col("r.n")) & (apart == 1)
    condition = near
    for c in same:
        condition = condition & c
    return rare.join(often, condition, "left_semi")


def totals(cands: DataFrame, file: str, kind: str, group: str, n: str) -> DataFrame:
    """Sum by file and kind, largest file of each group, sum over groups (row 227)."""
    by_file = cands.groupBy(group, file, kind).agg(F.sum(n).alias("n"))
    return by_file.groupBy(group, kind).agg(F.max("n").alias("n")).groupBy(kind).agg(F.sum("n").alias("total"))


def mode(rows: DataFrame, by: list[str], value: str, distance: str) -> DataFrame:
    """Most frequent value of each group; ties to the least distance, then to the smaller value (row 235)."""
    votes = rows.groupBy(*by, value).agg(F.count("*").alias("votes"), F.min(distance).alias("nearest"))
    order = Window.partitionBy(*by).orderBy(F.desc("votes"), F.asc("nearest"), F.asc(value))
    return votes.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def ambiguous(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups that name several values (row 233)."""
    return rows.groupBy(*by).agg(F.countDistinct(value).alias("values")).where("values > 1")


def top_pages(cands: DataFrame, by: list[str], page: list[str], key: str, limit: int = 3) -> DataFrame:
    """The pages of each group with most distinct keys (rows 222, 223); the limit is the feature."""
    counted = cands.groupBy(*by, *page).agg(F.countDistinct(key).alias("keys"))
    order = Window.partitionBy(*by).orderBy(F.desc("keys"), *page)
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def specific(rows: DataFrame, by: list[str], code: str, least: int = 2, share: float = 0.1) -> DataFrame:
    """The longest code on enough pages of a group, else the most common (row 240)."""
    counted = rows.groupBy(*by, code).agg(F.count("*").alias("n")).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    often = F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("_all"))
    order = Window.partitionBy(*by).orderBy(F.desc(often.cast("int")), F.desc(F.when(often, F.length(code)).otherwise(0)), F.desc("n"), F.asc(code))
    return counted.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_all")


def filtered_counts(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """How many rows of each group satisfy each condition (rows 245, 248, 251)."""
    return rows.groupBy(*by).agg(*(F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in flags.items()))

"""Which revisions and sources count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(rows: DataFrame, groups: DataFrame, by: list[str]) -> Column:
    on = F.lit(True)
    for k in by:
        on = on & rows[k].eqNullSafe(groups[f"_k_{k}"])
    return on


def latest_only(cands: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Candidates of the latest revision that names the value, not of the latest there is (row 218).

    The latest is found by partial sums before the shuffle, so a frequent value is not sorted in one task.
    """
    top = cands.groupBy(*by).agg(F.max(rank).alias("_top")).select(*(F.col(k).alias(f"_k_{k}") for k in by), "_top")
    return cands.join(top, _same(cands, top, by) & (cands[rank] == top["_top"]), "left_semi")


def prefer_source(cands: DataFrame, by: list[str], wanted: Column) -> DataFrame:
    """Candidates of wanted sources if a group has any, else all, flagged as fallback (row 219)."""
    rows = cands.withColumn("_is", F.coalesce(wanted, F.lit(False)))
    held = rows.groupBy(*by).agg(F.max("_is").alias("_any")).select(*(F.col(k).alias(f"_k_{k}") for k in by), "_any")
    out = rows.join(held, _same(rows, held, by)).where("_is or not _any")
    return out.withColumn("fallback", ~F.col("_any")).drop("_is", "_any", *(f"_k_{k}" for k in by))


def choose_max(cands: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Candidates with the largest value of their group (row 217)."""
    return latest_only(cands, by, value)


def conflicts(cands: DataFrame, chain: list[str], file: str, value: str = "value") -> DataFrame:
    """Chains whose files name different sets of values (row 220)."""
    sets = cands.groupBy(*chain, file).agg(F.sort_array(F.collect_set(value)).alias("values"))
    return sets.groupBy(*chain).agg(F.count("*").alias("files"), F.countDistinct("values").alias("sets")).where("sets > 1")


def consecutive(rows: DataFrame, chain: list[str], order: list[str], member: str) -> DataFrame:
    """Each member of a chain with the one that follows (row 192)."""
    w = Window.partitionBy(*chain).orderBy(*order)
    return rows.withColumn("next", F.lead(member).over(w)).where(F.col("next").isNotNull())


def maximal(rows: DataFrame, chain: list[str], ranks: list[str]) -> DataFrame:
    """Chains with the number of members that none surpasses, and whether one is left (row 317).

    A member surpasses another that it equals or exceeds in every rank and exceeds in one: a partial order, which has
    no sort key, so members meet within their chain only.
    """
    members = rows.select(*chain, *ranks).distinct()
    a, b = members.alias("a"), members.alias("b")
    over = F.lit(True)
    for k in chain:
        over = over & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    some = F.lit(False)
    for r in ranks:
        over, some = over & (F.col(f"b.{r}") >= F.col(f"a.{r}")), some | (F.col(f"b.{r}") > F.col(f"a.{r}"))
    left = a.join(b, over & some, "left_anti")
    status = F.when(F.col("maximal") == 1, "RESOLVED").otherwise("CLARIFICATION_REQUIRED")
    return left.groupBy(*chain).agg(F.count("*").alias("maximal")).withColumn("status", status)

"""From findings to what is handed over: checks, coverage, differences between versions, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def submission(findings: DataFrame, key: list[str], rank: Column, evidence: str, order: list[str]) -> DataFrame:
    """One check for each key (rows 347 to 350): the row of highest rank, with the evidence of all rows."""
    w = Window.partitionBy(*key).orderBy(F.desc("_rank"), *order)
    best = findings.withColumn("_rank", rank).withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_rank", "_place", evidence)
    union = findings.groupBy(*key).agg(F.sort_array(F.collect_set(evidence)).alias("evidence"), F.count("*").alias("merged"))
    return best.join(union, key)


def coverage(catalogue: DataFrame, findings: DataFrame, key: str, label: str) -> DataFrame:
    """One row for each catalogue entry with its best status (row 244)."""
    order = {"NO_VIOLATION": 1, "VIOLATION_PRESENT": 1, "COMPARISON_IMPOSSIBLE": 2}
    rank = F.lit(3)
    for name, n in order.items():
        rank = F.when(F.col(label) == name, n).otherwise(rank)
    best = findings.groupBy(key).agg(F.min(rank).alias("_rank"), F.count("*").alias("n_findings"))
    status = F.when(F.col("_rank") == 1, "COMPLETE").when(F.col("_rank") == 2, "NOT_COMPARABLE").when(F.col("_rank") == 3, "MISSING_EVIDENCE").otherwise("NOT_CHECKED")
    out = catalogue.join(best, key, "left")
    return out.withColumn("status", status).withColumn("n_findings", F.coalesce("n_findings", F.lit(0))).drop("_rank")


def difference(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """ADDED, REMOVED, CHANGED or UNCHANGED of each key between two versions (rows 319, 320, 359)."""
    a = before.select(*key, F.col(value).alias("was"), F.lit(True).alias("_a"))
    b = after.select(*key, F.col(value).alias("now"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.col("was").eqNullSafe(F.col("now")), "UNCHANGED").otherwise("CHANGED")
    return a.join(b, key, "full").withColumn("status", status).drop("_a", "_b")


def manifest(rows: DataFrame, by: list[str], line: Column) -> DataFrame:
    """A version id for each group: SHA-256 of its sorted lines (row 360). A group is one object's selection."""
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("version"), F.count("*").alias("n"))

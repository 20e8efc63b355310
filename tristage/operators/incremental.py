"""What changed between two registries, and whether a partial run is enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """New or different files (row 354)."""
    old = before.select(F.col(key), F.col(digest).alias("_old"))
    return now.join(old, key, "left").where(~F.col(digest).eqNullSafe(F.col("_old"))).drop("_old")


def lost_files(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Files that are gone (row 355)."""
    return before.join(now.select(key), key, "left_anti")


def keep(rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of files that did not change (row 353)."""
    return rows.join(changed.select(key).distinct(), key, "left_anti")


def plan(now: DataFrame, before: DataFrame, key: str, digest: str, stage: str) -> DataFrame:
    """One row (row 382): FULL without a previous run, or if files were lost or moved to another stage; else PARTIAL."""
    old = before.select(key, F.col(digest).alias("_d"), F.col(stage).alias("_s"), F.lit(1).alias("_old"))
    both = now.select(key, digest, stage, F.lit(1).alias("_new")).join(old, key, "full")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    here = F.col("_new").isNotNull()
    out = both.agg(
        n(F.col("_old").isNotNull()).alias("previous"),
        n(~here).alias("lost"),
        n(here & F.col("_old").isNotNull() & ~F.col(stage).eqNullSafe(F.col("_s"))).alias("restaged"),
        n(here & ~F.col(digest).eqNullSafe(F.col("_d"))).alias("changed"),
    )
    return out.withColumn("mode", F.when((F.col("previous") == 0) | (F.col("lost") > 0) | (F.col("restaged") > 0), "FULL").otherwise("PARTIAL"))

"""Registry of files by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, sha256, bytes, extension of every file under path (rows 001, 002)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))


def mark_duplicates(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """duplicate_of: the first of the rows with the same content, null for that row itself (row 001). The first is found
    by partial aggregation, so a content of many copies comes to no single task."""
    first = rows.groupBy(digest).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(digest, "_first")
    return rows.join(first, digest, "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col(order), F.col("_first"))).drop("_first")


def first_manifest(manifests: list[DataFrame], key: str) -> DataFrame:
    """Union in order of priority; the first manifest that knows a key wins (row 003)."""
    out = None
    for i, m in enumerate(manifests):
        m = m.withColumn("_priority", F.lit(i))
        out = m if out is None else out.unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_priority")
    return out.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_priority")

"""Tables in the folder that driver and executors share, between steps that must not be reckoned again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tristage-checkpoints"
    return f"{base}/steps-{uuid.uuid4().hex}"


#: With this setting Spark removes the shuffle files of a query when it ends, not when the driver forgets its plan.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df written and read again: its lineage ends here, and a lost executor loses nothing.

    Files are many times smaller than their rows in memory, so joins would broadcast such tables by the size of their
    files, through the driver: by the hint they merge unless one asks for a broadcast. What was shuffled for the table is
    removed once it stands.
    """
    spark, path = df.sparkSession, folder(df.sparkSession)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._folder = path
    return out


def drop(*tables: DataFrame) -> None:
    """Tables from cut() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def until_still(step: Callable[[DataFrame], DataFrame], state: DataFrame, changed: str, most: int = 100) -> DataFrame:
    """step applied to a written state until no row of what it gives has `changed` set; that column is dropped."""
    for _ in range(most):
        state = cut(step(state))
        if not state.where(changed).take(1):
            return state.drop(changed)
        state = state.drop(changed)
    raise RuntimeError(f"still changing after {most} rounds")

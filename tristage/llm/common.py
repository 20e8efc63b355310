"""What the operators share: tables in the shared folder, shipping of code, cleaned inputs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()
_TRACKS: list[list[str]] = []

#: Java's and Python's form of one word without white space (space, tab to carriage return).
WS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tristage-checkpoints"
    path = f"{base}/tristage-{uuid.uuid4().hex}"
    for paths in _TRACKS:
        paths.append(path)
    return path


def save(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The folders that scratch() makes meanwhile, for a caller who later drops them."""
    paths: list[str] = []
    _TRACKS.append(paths)
    try:
        yield paths
    finally:
        _TRACKS.pop()  # the innermost


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also where PYTHONPATH doesn't hold it; keep their batches small, as
    texts may be long."""
    sc, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "1000")
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or sc.applicationId in _SHIPPED:
        return
    out = Path(tempfile.mkdtemp()) / "tristage.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((ROOT / "tristage").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def words(text: Column) -> Column:
    """The words between white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")




#: A table of at most so many short rows may be broadcast (tens of MB); larger ones are joined by a shuffle.
SMALL = 200_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, to be broadcast if a count shows that it is small. df should be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Each version of a text is addressed by the SHA-256 of its bytes. Only pairs of blob and rule version that the ledger
does not hold are scanned; findings join back to every path that ever held the blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Changes whenever RULES changes; blobs are scanned again under a new version.
RULE_VERSION = "2026-2"
#: No pattern repeats a group: Java matches such repeats by recursion, so that a long text would overflow its stack. The
#: first part of a jwt, a short header, is bounded, or a long run of its letters without a dot would cost its square.
#: Kind, pattern, group that must be long (0: whole match), its least length; in order of listing.
RULES = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 25),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,1000}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
]
BASE = [k for k, *_ in RULES[:3]]
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points; those with a short group are dropped.

    The pieces between matches and the matches themselves alternate, so running lengths give the offsets.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x).cast("long"))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.char_length(x).cast("long"))
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.char_length(x) >= least)
    both = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), kept.alias("ok"))
    none = F.array().cast(_SPAN)
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    span = lambda acc, x: F.array(F.struct((acc.at + x.gap).alias("start"), F.lit(rank).alias("rank"), (acc.at + x.gap + x.hit).alias("end"), F.lit(kind).alias("kind")))
    step = lambda acc, x: F.struct((acc.at + x.gap + x.hit).alias("at"), F.when(x.ok, F.concat(acc.out, span(acc, x))).otherwise(acc.out).alias("out"))
    found = F.aggregate(both, zero, step, lambda acc: acc.out)
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(blobs: DataFrame) -> DataFrame:
    """blob, text -> blob, rule_version, spans (by start, then kind as listed)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*(spans(text, i, *rule) for i, rule in enumerate(RULES)))
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.array_sort(every).alias("spans"))


def scan_new(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's new rows: one for each blob among versions (path, text) that it lacks under this rule version.

    Of equal blobs only the one with the smallest path is read again, so a blob of many copies is scanned once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    addressed = versions.select("path", F.sha2(text, 256).alias("blob"), F.xxhash64(text).alias("_h"))
    first = addressed.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull(), "path", "_h")).alias("_f"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    first = first.select("blob", F.col("_f.path").alias("_path"), F.col("_f._h").alias("_h"))
    texts = versions.select(F.col("path").alias("_p"), "text", F.xxhash64(text).alias("_x"))
    held = texts.join(first, F.col("_p").eqNullSafe(F.col("_path")) & (F.col("_x") == F.col("_h")))
    # a row that repeats both path and text is one version
    return scan(held.dropDuplicates(["blob"]) if _repeats(versions) else held.select("blob", "text"))


def _repeats(versions: DataFrame) -> bool:
    """Whether a pair of path and text stands in several rows."""
    key = versions.select("path", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return bool(key.groupBy("path", "h").count().where("count > 1").take(1))


def ledger_of(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger with what versions adds, as a written table: blob, rule_version, spans."""
    new = save(scan_new(versions, ledger), "ledger")
    return new if ledger is None else ledger.unionByName(new)


def update(versions: DataFrame, path: str) -> DataFrame:
    """The ledger kept under path, after the blobs of versions that it lacks have been scanned and appended to it.

    A run that is lost before its append has ended leaves the ledger as it was.
    """
    spark = versions.sparkSession
    kind = f"blob string, rule_version string, spans {_SPAN}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    known = spark.read.schema(kind).parquet(path) if held else None
    scan_new(versions, known).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """versions (path, text and any others) with blob and the spans of their blob, empty if none.

    A null text is an empty blob; a null path keeps its row; repeated rows each get their findings. Texts of any length
    are scanned whole. An empty table gives an empty result; columns named blob or spans are replaced.
    """
    versions = versions.drop("blob", "spans")
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    hits = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    rows = versions.withColumn("blob", blob).join(hits, "blob", "left")
    return rows.withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: Spark's text writer ends each record with the two line breaks that the format asks for. Which records revisit
another one comes from a grouping of digests only.

Reading: an archive is read in splits, cut wherever the magic line stands, also inside payloads. Each task emits its
candidates: an offset and, from the header there, the offset of the successor. Pointer jumping over these from the
start of each file doubles the reach in every round; what is not reached is payload that merely looks like a record.
Payloads that hold the magic line are put together again from their pieces.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, save, scratch, ship, small, tracked

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
#: Digits of base 32, Java's and the standard's.
_JAVA, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Five hex digits are four of base 32; a SHA-1 has forty."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _JAVA, _BASE32)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with payload, payload_digest, payload_bytes, record_type and refers_to.

    Of equal payloads of at least `least` bytes the largest page_id is the response. Rows that repeat it are responses
    too; so are all rows of a group without any page_id.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumn("payload", payload).withColumn("payload_digest", base32_sha1(payload.cast("binary"))).withColumn("payload_bytes", F.octet_length(payload).cast("long"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_response"), F.count("*").alias("_n"))
    copied = save(groups.where("_n > 1 and _response is not null").select("payload_digest", "_response"), "copied")
    rows = rows.join(small(copied), "payload_digest", "left")
    revisit = F.col("_response").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("_response"))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_response"))).drop("_response")


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")), F.lit(">"))


def record(rows: DataFrame) -> Column:
    """The record without its closing line breaks. A revisit keeps the HTTP header of the full payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(GAP))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
        http,
        body,
    )


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    rows = revisits(pages.select("page_id", "url", "html"), least)
    rows.select(record(rows).alias("value")).write.option("lineSep", GAP).text(path)


_FIELDS = "page_id string, record_type string, refers_to string, url string, declared string, payload_bytes long, payload_digest string"
_ARROW = [("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("declared", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def parse(piece: bytes) -> tuple[int | None, dict]:
    """From what follows a magic line: bytes up to the next record as the header tells, None if it isn't a header; and
    the record's fields, empty if the piece does not hold the whole record."""
    head, gap, block = piece.partition(b"\r\n\r\n")
    fields = dict(m.groups() for m in re.finditer(rb"(?m)^([A-Za-z-]+): *([^\r\n]*)\r?$", head if gap else b""))
    fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in fields.items()}
    if not gap or not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None, {}
    n = int(fields["content-length"])
    size = len(head) + 4 + n + 4
    if len(piece) < size:
        return size, {}
    block, kind = block[:n], fields["warc-type"]
    http, gap, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    key = lambda name: unquote(m[1].replace("+", " ")) or None if (m := re.fullmatch(r"<urn:page:(.*)>", fields.get(name, ""))) else None
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        said = re.search(rb"(?i)content-length: *(\d+)", http)
        length, digest = int(said[1]) if said else None, declared
    else:
        length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return size, {"page_id": key("warc-record-id"), "record_type": kind, "refers_to": key("warc-refers-to"), "url": fields.get("warc-target-uri"), "declared": declared, "payload_bytes": length, "payload_digest": digest}


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the split begins) and value: what stands between magic lines, in order within a split."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, int, int, bytes]]]]:
    """Rows of pieces with the number of bytes that stand before them in their split."""
    split, at = None, 0
    for batch in batches:
        rows = []
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            if split != (file, block):
                split, at = (file, block), 0
            rows.append((file, block, at, value))
            at += len(value) + len(MAGIC)
        yield batch, rows


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, at, succ, complete and fields of every piece; at and succ are offsets of what follows a magic line."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("bytes", pa.int64()), ("size", pa.int64()), ("complete", pa.bool_()), *_ARROW])
        for _, rows in placed(batches):
            out = []
            for file, block, rel, value in rows:
                size, fields = parse(value)
                out.append({"file": file, "block": block, "rel": rel, "bytes": len(value) + len(MAGIC), "size": size, "complete": bool(fields), **fields})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    found = save(pieces(spark, path).mapInArrow(run, f"file string, block long, rel long, bytes long, size long, complete boolean, {_FIELDS}"), "candidates")
    # splits follow each other without a hole, so the bytes of earlier ones say where a split's first piece stands
    splits = found.groupBy("file", "block").agg(F.sum("bytes").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    at = F.col("base") + F.col("rel")
    return found.join(bases, ["file", "block"]).withColumn("at", at).withColumn("succ", at + F.col("size") + len(MAGIC))


def reached(found: DataFrame) -> DataFrame:
    """file and at of the candidates on the chain from the start of each file; a written table.

    Within a split, candidates that follow each other as their headers tell make up one run. Pointer jumping then goes
    over runs only: as many as there are splits, and places where a payload holds the magic line.
    """
    split = Window.partitionBy("file", "block").orderBy("at")
    rows = found.select("file", "block", "at", "succ", F.coalesce(F.lag("succ").over(split) == F.col("at"), F.lit(False)).alias("follows"))
    rows = save(rows.select("file", "at", "succ", F.last(F.when(~F.col("follows"), F.col("at")), ignorenulls=True).over(split).alias("run")), "runs")
    ends = rows.groupBy("file", "run").agg(F.max_by("succ", "at").alias("exit"))
    # the run that a run's last record leads to, and where it is entered; a file begins with its first magic line
    entered = rows.select("file", F.col("at").alias("exit"), F.col("run").alias("next"))
    start = F.when(F.col("run") == len(MAGIC), F.lit(len(MAGIC)).cast("long"))
    chain = ends.join(entered, ["file", "exit"], "left").select("file", "run", "next", F.when(F.col("next").isNotNull(), F.col("exit")).alias("exit"), start.alias("on"))
    chain = save(chain, "chain")
    most = chain.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(most + 1))):
        ahead = chain.select("file", F.col("run").alias("next"), F.col("next").alias("_next"), F.col("exit").alias("_exit"))
        marks = chain.where("on is not null and next is not null").select("file", F.col("next").alias("run"), F.col("exit").alias("_on"))
        far = chain.join(ahead, ["file", "next"], "left").join(marks, ["file", "run"], "left")
        chain = save(far.select("file", "run", F.col("_next").alias("next"), F.col("_exit").alias("exit"), F.coalesce("on", "_on").alias("on")), "chain")
    on = chain.where("on is not null").select("file", "run", "on")
    return save(rows.join(small(on), ["file", "run"]).where("at >= on").select("file", "at"), "reached")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: the columns of _FIELDS, and whether the payload has its declared digest.

    A header of any length is read whole; a missing header gives null fields; an empty folder gives an empty result.
    Bytes behind a record that no header leads on from are no records.
    """
    with tracked() as paths:
        found = save(candidates(spark, path).where(F.col("at") > 0), "placed")
    for p in paths[:-1]:
        drop(spark, p)
    with tracked() as paths:
        chain = reached(found)
    for p in paths[:-1]:
        drop(spark, p)
    on = found.join(chain.withColumn("_on", F.lit(True)), ["file", "at"], "left")
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    whole = on.where("_on and complete").select(*names)
    if not on.where("_on and not complete").isEmpty():
        whole = whole.unionByName(_spanning(spark, path, on))
    return whole.withColumn("verified", F.col("declared").eqNullSafe(F.col("payload_digest")))


def _spanning(spark: SparkSession, path: str, on: DataFrame) -> DataFrame:
    """Records whose payload holds the magic line: pieces from a reached one up to the next, joined by that line."""
    order = Window.partitionBy("file").orderBy("at")
    owner = F.last(F.when(F.col("_on"), F.struct("at", "complete")), ignorenulls=True).over(order)
    parts = on.select("file", "block", "rel", "at", owner.alias("o")).where("not o.complete").select("file", "block", "rel", "at", F.col("o.at").alias("owner"))
    parts = save(parts, "parts")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in placed(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for _, _, r, _ in rows], pa.int64())], names=[*batch.schema.names, "rel"])

    values = pieces(spark, path).mapInArrow(place, "file string, block long, value binary, rel long")
    joined = values.join(small(parts), ["file", "block", "rel"])
    together = joined.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                _, fields = parse(MAGIC.encode().join(x["value"] for x in v))
                out.append(fields)
            yield pa.RecordBatch.from_pylist([x for x in out if x], schema=pa.schema(_ARROW))

    return together.select("v").mapInArrow(run, _FIELDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive pages in the shared folder and read the archives back; ids have their type again.

    A null html is an empty payload, a null url leaves out its header, null page_ids come back null; repeated rows are
    records each; an empty table gives an empty result; other columns of pages play no part.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    path = scratch(spark)
    write(pages, path, least)
    return read(spark, path).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})

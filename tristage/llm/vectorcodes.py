"""Vector code compression: product codes whose entries are found by exponion search.

A vector is cut into equal parts, each part is named by the nearest entry of its own codebook. A search starts at the
entry of the round before. Let d be the distance to it: an entry as near as d lies within 2 d of it, by the triangle
inequality, so of its list of the other entries, sorted by distance, only those with squared distance up to 4 d^2 are
measured. All is in exact integers; equal distances go to the lower index. Each task adds up what its entries gather and
writes it beside its codes, and these few rows a task are added up in a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, drop, save, scratch, ship
from .vectors import fit, integers, longs, matrix, means, pack, peak, sums_by, unpack, whole

#: A label's sum is dealt to so many copies if there are too many labels to broadcast them.
SALTS = 64


class Book:
    """The codebooks of all parts: entries (parts * k rows), and of each entry the list of those of its part by distance."""

    def __init__(self, entries: np.ndarray, parts: int):
        self.k, self.width, self.parts = len(entries) // parts, entries.shape[1], parts
        self.entries, self.top = entries, peak(entries)
        lists, spans = [], []
        for p in range(parts):
            c = self.entries[p * self.k : (p + 1) * self.k]
            c = fit(c, 4 * self.width * (2 * self.top) ** 2)
            d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
            order = np.argsort(d, axis=1, kind="stable")
            lists.append(order + p * self.k)
            spans.append(np.take_along_axis(d, order, axis=1))
        self.lists, self.spans = np.concatenate(lists), np.concatenate(spans)

    def guess(self, x: np.ndarray) -> np.ndarray:
        """Where a search without an entry before begins: of the sums of components, the next one."""
        out = np.empty(len(x), np.int64)
        for p in range(self.parts):
            c = self.entries[p * self.k : (p + 1) * self.k].sum(axis=1)
            order = np.argsort(c, kind="stable")
            i = np.searchsorted(c[order], x[p :: self.parts].sum(axis=1))
            out[p :: self.parts] = order[np.minimum(i, self.k - 1)] + p * self.k
        return out

    def search(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of parts (the parts of a vector one below the other) their nearest entries and squared distances."""
        bound = 4 * self.width * (peak(x) + self.top) ** 2
        x, c, spans = fit(x, bound), fit(self.entries, bound), fit(self.spans, bound)
        if start is None:
            start = self.guess(x)
        best = ((x - c[start]) ** 2).sum(axis=1)
        reach = (spans[start] <= 4 * best[:, None]).sum(axis=1).astype(np.int64)
        order = np.argsort(-reach, kind="stable")  # so that those with more to scan stand first
        x, start, best, reach = x[order], start[order], best[order], reach[order]
        at = start.copy()
        for t in range(int(reach[0]) if len(reach) else 0):
            m = int(np.searchsorted(-reach, -t))
            j = self.lists[start[:m], t]
            d = ((x[:m] - c[j]) ** 2).sum(axis=1)
            better = np.asarray((d < best[:m]) | ((d == best[:m]) & (j < at[:m])), bool)
            at[:m][better], best[:m][better] = j[better], d[better]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return at[back], best[back]


def _kept(df: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """The rows that take part, and their number of components: that of the first of them by vec_id."""
    kept = df.select("vec_id", "label", "embedding").where(whole(F.col("embedding")) & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first = kept.select(F.col("vec_id").isNull().alias("none"), "vec_id", F.size("embedding").alias("dim")).orderBy("none", "vec_id", "dim").limit(1).collect()
    dim = first[0].dim if first else parts
    return kept.where(F.size("embedding") == dim), dim


def compress(df: DataFrame, parts: int = 16, k: int = 64, rounds: int = 2, factor: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes (a byte a part), error) of every kept vector, as a written table, and the codebooks.

    Dropped are vectors that are null or hold a null or non-finite component, and those whose number of components isn't
    that of the first kept one or no multiple of parts. Codebooks start as the parts of the k smallest vec_ids (null ones
    last, equal ones by their components); with fewer vectors they are shorter. Repeated rows are vectors each. An error
    that a long can't hold is null. An empty table gives an empty one.
    """
    assert 1 <= k <= 256
    spark = df.sparkSession
    ship(spark)
    kept, dim = _kept(df, parts)
    width, kinds = dim // parts, dict(kept.dtypes)
    first = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "embedding").limit(k).select("embedding").collect()
    start = integers(np.array([r.embedding for r in first], np.float64).reshape(-1, dim), factor)
    entries = np.concatenate([start[:, p * width : (p + 1) * width] for p in range(parts)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                one = pa.array([0, b.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(one, b.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([pack(matrix(b.column("embedding"), dim, factor))]), pa.array([None], pa.binary()), pa.array([None], pa.binary())], names=names)

    def searched(book: Book, rows: bytes, codes: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = unpack(rows, width)
        offsets = np.tile(np.arange(parts) * book.k, len(x) // parts)
        was = None if codes is None else np.frombuffer(codes, np.uint8).astype(np.int64) + offsets
        at, d = book.search(x, was)
        return x, at, d

    def assign(sent) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book, total = Book(sent.value, parts), None
            for b in batches:
                for i, (rows, codes) in enumerate(zip(b.column("rows").to_pylist(), b.column("codes").to_pylist(), strict=True)):
                    x, at, _ = searched(book, rows, codes)
                    part = sums_by(at, np.column_stack([x, np.ones(len(x), np.int64)]), len(sent.value))
                    total = part if total is None else total + part
                    yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1), b.column("labels").slice(i, 1), pa.array([rows]), pa.array([(at % book.k).astype(np.uint8).tobytes()]), pa.array([None], pa.binary())], names=names)
            if total is not None:
                empty = [pa.array([None], t) for t in types[:4]]
                yield pa.RecordBatch.from_arrays([*empty, pa.array([pack(total)])], names=names)

        types = list(_arrow(kinds))
        return run

    names = ["ids", "labels", "rows", "codes", "sums"]
    schema = f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, rows binary, codes binary, sums binary"

    def written(table: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark)
        table.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    blocks, path = written(kept.mapInArrow(packed, schema))
    for _ in range(rounds if len(entries) else 0):
        sent = spark.sparkContext.broadcast(entries)
        new, place = written(blocks.where("rows IS NOT NULL").mapInArrow(assign(sent), schema))
        drop(spark, path)
        blocks, path = new, place
        sums = blocks.where("sums IS NOT NULL").select("sums").rdd.map(lambda r: unpack(r[0], width + 1).astype(object))
        total = sums.treeReduce(lambda a, b: a + b)
        entries = means(entries, total[:, :width], total[:, width])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(entries, parts)
        for b in batches:
            for i, (rows, codes) in enumerate(zip(b.column("rows").to_pylist(), b.column("codes").to_pylist(), strict=True)):
                _, at, d = searched(book, rows, codes)
                local = (at % book.k).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), b.column("labels").slice(i, 1).flatten(), pa.array([local[j : j + parts] for j in range(0, len(local), parts)], pa.binary()), longs(fit(d, peak(d) * parts).reshape(-1, parts).sum(axis=1))], names=["vec_id", "label", "codes", "error"])

    out = save(blocks.where("rows IS NOT NULL").mapInArrow(last, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes binary, error long"), "codes")
    drop(spark, path)
    return out, entries


def _arrow(kinds: dict[str, str]) -> Iterator[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    for c in ("vec_id", "label"):
        yield pa.list_(to_arrow_type(_parse_datatype_string(kinds[c])))
    yield from (pa.binary(),) * 3


def report(codes: DataFrame, entries: np.ndarray) -> DataFrame:
    """vec_id, code (hex), error, label_error (of all vectors with the label; nulls are one label), codebooks_sha256."""
    digest = hashlib.sha256(",".join(str(v) for row in entries.tolist() for v in row).encode()).hexdigest()
    by = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_l"), F.col("label").isNull().alias("_none")]
    sums = save(codes.groupBy(*by).agg(F.try_sum("error").alias("label_error")), "labels")
    rows = codes.select("*", *by)
    if sums.limit(SMALL + 1).count() <= SMALL:
        both = rows.join(F.broadcast(sums), ["_l", "_none"])
    else:  # a label may hold a third of all rows
        dealt = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int")).join(dealt, ["_l", "_none", "_salt"])
    return both.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

"""Centroid clustering by Lloyd's rounds over integer vectors.

Distances come from |x|^2 - 2 x.c + |c|^2, a block of vectors times all centroids in one product of float64 matrices.
The largest magnitudes bound every term and partial sum; below 2^53 the products are exact, else the block is reckoned
in 64-bit integers, or in Python's where these could overflow. Sums of clusters are combined by treeAggregate: what
travels and what the driver holds is one row a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, ship
from .vectors import EXACT, LONG, fit, integers, longs, matrix, means, pack, peak, sums_by, unpack, whole


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x, the number of the nearest row of c (ties: the smaller) and the squared distance."""
    bound = x.shape[1] * (peak(x) + peak(c)) ** 2
    if bound < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = np.einsum("ij,ij->i", a, a)[:, None] - 2.0 * (a @ b.T) + np.einsum("ij,ij->i", b, b)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(at)), at].astype(np.int64)
    x, c = fit(x, bound), fit(c, bound)
    at, best = np.zeros(len(x), np.int64), ((x - c[0]) ** 2).sum(axis=1)
    for i in range(1, len(c)):
        d = ((x - c[i]) ** 2).sum(axis=1)
        closer = np.asarray(d < best, bool)
        at[closer], best[closer] = i, d[closer]
    return at, best


def gathered(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A row for each centroid: sums of its vectors' components, their number, and their distances."""
    at, d = nearest(x, c)
    return sums_by(at, np.column_stack([x, np.ones(len(x), np.int64), d]), len(c))


def starts(kept: DataFrame, k: int, factor: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:vec_id; equal ids by their components. Only these k come here."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()
    return integers(np.array([r.embedding for r in rows], np.float64), factor)


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, factor: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector (vec_id, embedding) that is kept.

    Kept are vectors with exactly dim components, all finite. With fewer than k of them, each starts a cluster; with
    none, or an empty table, the result is empty. Null ids hash as empty ones; repeated rows are vectors each. A distance
    or sum that a long can't hold is null. Other columns play no part.
    """
    spark = df.sparkSession
    ship(spark)
    kept = df.select("vec_id", "embedding").where(whole(F.col("embedding")) & (F.size("embedding") == dim))
    kind = dict(kept.dtypes)["vec_id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([pack(matrix(b.column("embedding"), dim, factor))])], names=["ids", "rows"])

    blocks = save(kept.mapInArrow(packed, f"ids array<{kind}>, rows binary"), "blocks")
    centroids = starts(kept, k, factor, seed)
    n = len(centroids)
    out = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not n:
        return spark.createDataFrame([], out)

    def totals(c: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(c)
        zero = np.zeros((n, dim + 2), object)
        return blocks.select("rows").rdd.treeAggregate(zero, lambda acc, r: acc + gathered(unpack(r[0], dim), sent.value), lambda a, b: a + b)

    for _ in range(rounds):
        t = totals(centroids)
        centroids = means(centroids, t[:, :dim], t[:, dim])
    inertia = [int(v) for v in totals(centroids)[:, dim + 1]]
    inside = lambda v: v if v < LONG else None
    facts = [(inside(v), inside(sum(inertia)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for v, c in zip(inertia, centroids.tolist(), strict=True)]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, every, digest = (pa.array(x, t) for x, t in zip(zip(*facts, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))
        for b in batches:
            for i, data in enumerate(b.column("rows").to_pylist()):
                at, d = nearest(unpack(data, dim), centroids)
                j = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), j, longs(d), own.take(j), every.take(j), digest.take(j)], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(assigned, out)

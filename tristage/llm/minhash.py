"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star edges.

One hash of each shingle does for all bins: its upper bits choose the bin, the least hash of a bin is its value, and
an empty bin borrows from a full one that a hash of bin and attempt chooses. Equal shingle sets are one class; only
classes meet in buckets. Each bucket gives a star of candidate edges to its smallest document, so edges are as many as
members. Links are confirmed on full shingle sets. Documents of buckets that their star leaves in several components
go through an exact prefix-filter join across components, so no link of a bucket is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, ship, small
from .graph import components

#: Share of pairs at the least similarity that may share no bucket.
MISSED = 3e-6
#: Buckets of shingle hashes that are counted to order shingles by rarity.
SKETCH = 1 << 18
KEEP = 300_000
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEEP:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def split(text: str | None) -> list[bytes]:
    """Words between space, tab and line breaks, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of `size` words; the whole sequence if it is shorter."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def hashed(words: list[bytes], size: int, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    k = min(size, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = mix(total * _A + h[i : n - k + 1 + i])
    return np.unique(total)


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: as many bands as leave MISSED of the pairs at this similarity without a common bucket."""
    rows = 8 if percent >= 85 else 6
    return math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** rows)) - 1e-2), rows


class Signer:
    def __init__(self, bands: int, rows: int) -> None:
        self.probes: list[np.ndarray] = []
        self.shape, self.size = (bands, rows), bands * rows
        self.factors = mix(np.arange(1, rows + 1, dtype=np.uint64) * _B) | _U(1)
        self.salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * _C)

    def probe(self, t: int) -> np.ndarray:
        while len(self.probes) <= t:
            at = np.arange(self.size, dtype=np.uint64) * _A + np.array([len(self.probes) + 1], np.uint64) * _C
            self.probes.append((mix(at) % _U(self.size)).astype(np.int64))
        return self.probes[t]

    def bins(self, h: np.ndarray) -> np.ndarray:
        """Value of each bin. h: sorted distinct hashes, not empty; a bin's least hash is its first."""
        at = ((h >> _U(32)) * _U(self.size) >> _U(32)).astype(np.int64)
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        out, full = np.zeros(self.size, np.uint64), np.zeros(self.size, bool)
        out[at[heads]], full[at[heads]] = h[heads], True
        empty, t = np.flatnonzero(~full), 0
        while len(empty):
            source = self.probe(t)[empty]
            found = full[source]
            out[empty[found]] = out[source[found]]
            empty, t = empty[~found], t + 1
        return out

    def bands(self, h: np.ndarray) -> np.ndarray:
        return mix((mix(self.bins(h)).reshape(self.shape) * self.factors).sum(axis=1) ^ self.salts).view(np.int64)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n (shingles), a and b (sums that tell sets apart), bands."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signer = Words(), Signer(*banding(percent))
        for batch in batches:
            n, a, b, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                h = hashed(split(text), size, known)
                n.append(len(h))
                a.append(int(h.sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                b.append(int(mix(h).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                bands.append(signer.bands(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, a, b)), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "a", "b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, a long, b long, bands array<long>")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (x, y) those whose full shingle sets have the similarity. Texts of other documents are not moved."""
    ids = save(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "ids")
    held = docs.select("doc_id", "text").join(small(ids, 500_000), "doc_id", "left_semi")
    side = lambda c: held.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "tx", "ty")
    kind = dict(pairs.dtypes)["x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, set()
        for batch in batches:
            keep = []
            for tx, ty in zip(batch.column("tx").to_pylist(), batch.column("ty").to_pylist(), strict=True):
                if tx != last:  # rows come by x
                    last, one = tx, shingles(split(tx), size)
                two = shingles(split(ty), size)
                shared = len(one & two)
                keep.append(bool(shared) and 100 * shared >= percent * (len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return save(both.mapInArrow(run, f"x {kind}, y {kind}").distinct(), "links")


def links(sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): enough confirmed links between classes to connect all that are linked. sets: one row for each class."""
    rows = sets.select("doc_id", "n", F.explode("bands").alias("bucket"))
    hubs = save(rows.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub != top").select("bucket", "hub"), "hubs")
    members = save(rows.join(hubs, "bucket"), "members")
    sizes = sets.select(F.col("doc_id").alias("hub"), F.col("n").alias("n_hub"))
    close = lambda p, q: 100 * F.least(p, q) >= percent * F.greatest(p, q)
    star = members.where("doc_id != hub").select("hub", "doc_id", "n").distinct().join(sizes, "hub").where(close("n", "n_hub"))
    pairs = save(star.select(F.col("hub").alias("x"), F.col("doc_id").alias("y")), "pairs")
    found = verified(pairs, docs, size, percent)
    label = components(found.select(F.col("x").alias("u"), F.col("y").alias("v"))).select(F.col("node").alias("doc_id"), "component")
    named = members.select("bucket", "doc_id").join(save(label, "label"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = save(named, "named")
    split_up = named.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p != q").select("bucket")
    open_ = save(named.join(split_up, "bucket", "left_semi").select("doc_id", "component").distinct(), "open")
    if not open_.isEmpty():
        fresh = save(prefix_pairs(open_, docs, size, percent).join(pairs, ["x", "y"], "left_anti"), "pairs")
        found = found.unionByName(verified(fresh, docs, size, percent))
    return found.select(F.col("x").alias("u"), F.col("y").alias("v"))


def prefix_pairs(some: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Distinct pairs (x < y) among some (doc_id, component) that may be similar and are in different components.

    Exact, whatever the buckets: shingles of a document in order of rarity, rank of the count of their hash bucket
    among these documents; similar sets share one of the first n - ceil(n * percent / 100) + 1, and the places where
    they do leave enough to share. Unlike pairs of a large group of copies, which differ in their rare shingles, do
    not meet.
    """
    held = docs.select("doc_id", "text").join(small(some, 500_000), "doc_id").select("doc_id", "component", "text")
    kind = dict(some.dtypes)["doc_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Words(), np.zeros(SKETCH, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(total, (hashed(split(text), size, known) & _U(SKETCH - 1)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        for part in np.array_split(used, 1 + len(used) // 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["b", "n"])

    counted = held.mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    rarity = np.zeros(SKETCH, np.int64)
    rarity[counted["b"].to_numpy()] = counted["n"].to_numpy()
    sent = some.sparkSession.sparkContext.broadcast(rarity)  # SKETCH numbers

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            rows, tokens, places, sizes = [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                h = hashed(split(text), size, known)
                often = sent.value[(h & _U(SKETCH - 1)).astype(np.int64)]
                n = len(h) + -len(h) * percent // 100 + 1
                first = np.lexsort((h, often))[:n]
                at = np.flatnonzero(often[first] > 1)  # what no other document has meets nothing
                rows.append(np.full(len(at), r))
                tokens.append(h[first[at]].view(np.int64))
                places.append(at)
                sizes.append(np.full(len(at), len(h)))
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            at = pa.array(join(rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(join(tokens), pa.int64()), batch.column("doc_id").take(at), batch.column("component").take(at), pa.array(join(sizes).astype(np.int64)), pa.array(join(places).astype(np.int64))], names=["token", "doc_id", "component", "n", "i"])

    rows = save(held.mapInArrow(prefix, f"token long, doc_id {kind}, component {kind}, n long, i long"), "prefixes")
    a, b = rows.alias("a"), rows.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    close = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    left = F.least(n - F.col("a.i"), m - F.col("b.i")) * (100 + percent) >= percent * (n + m)
    both = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.component") != F.col("b.component")) & close & left)
    return both.select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; linked at 100 * shared >= percent * union.

    Texts without words (null, empty) link with nothing. Rows with the same doc_id are one document. A null doc_id
    links with nothing, has no component_id and is kept. An empty table gives an empty result; other columns of docs
    play no part.
    """
    rows = save(signatures(docs, size, percent), "signatures")
    real = rows.where("n > 0 and doc_id is not null")
    classes = save(real.groupBy("n", "a", "b").agg(F.min("doc_id").alias("class")), "classes")
    named = real.join(classes, ["n", "a", "b"])
    sets = named.where("doc_id = class").dropDuplicates(["doc_id", "n", "a", "b"]).select("doc_id", "n", "bands")
    edges = links(save(sets, "sets"), docs, size, percent)
    # a doc_id of several rows joins their classes
    several = save(real.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    if not several.isEmpty():
        edges = edges.unionByName(named.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("class").alias("v")))
    label = components(edges)
    label = save(label.select(F.col("node").alias("class"), "component"), "label")
    known = save(classes.join(label, "class", "left").select("n", "a", "b", F.coalesce("component", "class").alias("component")), "known")
    out = rows.drop("bands").join(known, ["n", "a", "b"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

"""Benchmark decontamination: CGK embedding of item-sized windows, bit-sampling LSH, exact edit verification.

A window of as many words as an item has is walked by random one-bit steps that depend on step and word; two windows
within few edits stay mostly in step, so that edit distance becomes Hamming distance. Keys of a few sampled positions
then meet with high chance in one of many tables. What meets is verified by the exact edit distance between the item
and the best stretch of the document around the window.

Of k + 1 disjoint pieces of an item, k edits leave one as it is, so only windows that line up with an unchanged piece
are embedded; this loses nothing. The tables alone reach a recall of 0.99 for random edits at the largest distance
(tests/llm measures it) and less for many insertions or deletions in long items, so whatever stands around an unchanged
piece and was not met is verified exactly as well: the hits are all there are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import ship
from .licences import tokens

#: Walks, tables for each walk, sampled positions for each table.
REPEATS, TABLES, SAMPLES = 6, 40, 2
#: Classes of words that step alike; windows that are embedded at once; word hashes that a worker keeps.
CLASSES, STACK, KEEP = 4096, 4096, 300_000
#: Edits in words that a passage may be away from its item, as a share of the item's words.
EDITS = 0.2
#: Benchmark items that one pass holds in memory; a larger benchmark is searched in several passes.
BLOCK = 5_000
_U = np.uint64


def distance(item: list[int], words: list[int]) -> tuple[int, int]:
    """Least edit distance of item to any stretch of words, and where the first such stretch ends; bit-parallel."""
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        where[w] |= 1 << i
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, w in enumerate(words, 1):
        eq = where.get(w, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(d | up) & full, up & d
        score += bool(rise & high) - bool(fall & high)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(x | rise) & full, rise & x
        if score < best:
            best, end = score, at
    return best, end


def merged(stretches: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap put together, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(stretches):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def covered(done: list[tuple[int, int]], lo: int, hi: int) -> bool:
    """Whether one of the stretches, whose starts and ends ascend, holds the one from lo to hi."""
    at = bisect_right(done, lo, key=lambda x: x[0])
    return at > 0 and hi <= done[at - 1][1]


def _runs(ids: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q numbers."""
    out = np.zeros(len(ids) - q + 1, np.uint64)
    for i in range(q):
        out = out * _U(0x9E3779B97F4A7C15) + (ids[i : len(ids) - q + 1 + i].astype(np.uint64) + _U(1)) * _U(0xC2B2AE3D27D4EB4F)
    return out


def numbered(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEEP:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_NUMBERS = _Numbers()


def _steps(repeat: int, t: int) -> np.ndarray:
    """Step of the walk at time t, for each class of words: 0 or 1. One table serves items of all lengths."""
    while len(_STEPS) <= t:
        rng = np.random.default_rng(len(_STEPS))
        _STEPS.append(rng.integers(0, 2, (REPEATS, CLASSES)).astype(np.int64))
    return _STEPS[t][repeat]


_STEPS: list[np.ndarray] = []


def embedded(windows: np.ndarray, past: int) -> np.ndarray:
    """(repeat, table, window): keys of sampled positions of the CGK walks. windows: a row of word hashes each.

    A walk stands on a word, puts it out, and goes on by the step that time and word choose; past the end it puts out
    `past`, which differs for items and texts, as two walks that have both ended say nothing about each other.
    """
    w, m = windows.shape
    padded = np.concatenate([windows, np.full((w, 1), past, np.uint64)], axis=1)
    flat, base = padded.ravel(), np.arange(w) * (m + 1)
    kind = (flat % _U(CLASSES)).astype(np.int64)
    rng = np.random.default_rng(m)
    sampled = rng.integers(0, 2 * m, (REPEATS, TABLES, SAMPLES))
    factor = rng.integers(1, 1 << 62, (REPEATS, TABLES, SAMPLES)).astype(np.uint64) | _U(1)
    out = np.empty((REPEATS, TABLES, w), np.uint64)
    for r in range(REPEATS):
        at, walk = np.zeros(w, np.int64), np.empty((2 * m, w), np.uint64)
        for t in range(2 * m):
            walk[t] = flat[base + at]
            at = np.minimum(at + _steps(r, t)[kind[base + at]], m)
        for t in range(TABLES):
            out[r, t] = (walk[sampled[r, t]] * factor[r, t][:, None]).sum(axis=0)
    return out


class Group:
    """Items of the same number of words, with their keys in each table, sorted."""

    def __init__(self, items: list[tuple[int, np.ndarray]], edits: float):
        self.items, self.m = items, len(items[0][1])
        self.k = int(self.m * edits)
        keys = embedded(np.stack([x for _, x in items]), 0)
        self.order = np.argsort(keys, axis=2, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, axis=2)

    def candidates(self, windows: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) that share a key in any table."""
        found = set()
        for at in range(0, len(windows), STACK):
            keys = embedded(windows[at : at + STACK], 1)
            for r in range(REPEATS):
                for t in range(TABLES):
                    known, order = self.keys[r, t], self.order[r, t]
                    lo, hi = np.searchsorted(known, keys[r, t], "left"), np.searchsorted(known, keys[r, t], "right")
                    for w in np.flatnonzero(lo < hi).tolist():
                        found.update((at + w, i) for i in order[lo[w] : hi[w]].tolist())
        return found


class Index:
    """The items of a block in groups by length. Items are told apart by their place in the block."""

    def __init__(self, texts: list[str], edits: float):
        by: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, text in enumerate(texts):
            if len(ids := numbered(tokens(text))):
                by[len(ids)].append((item, ids))
        self.groups = [Group(x, edits) for _, x in sorted(by.items())]
        # k edits leave one of k + 1 disjoint pieces of an item as it is: (group, item, offset) of each such piece
        pieces: dict[int, tuple[list[np.ndarray], list[tuple[int, int, int]]]] = defaultdict(lambda: ([], []))
        for n, g in enumerate(self.groups):
            q = g.m // (g.k + 1)
            for item, (_, ids) in enumerate(g.items):
                keys, places = pieces[q]
                keys.append(_runs(ids, q)[: (g.k + 1) * q : q])
                places += [(n, item, at) for at in range(0, (g.k + 1) * q, q)]
        self.pieces = {}
        for q, (keys, places) in pieces.items():
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            self.pieces[q] = flat[order], np.array(places, np.int32)[order]

    def search(self, texts: list[str | None], tables_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, first word) of the items that each text holds."""
        starts: dict[int, set[tuple[int, int]]] = defaultdict(set)
        around: dict[int, dict[tuple[int, int], set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        held: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            ids = numbered(tokens(text))
            for q, (known, places) in self.pieces.items():
                if len(ids) < q:
                    continue
                runs = _runs(ids, q)
                lo = np.searchsorted(known, runs, "left")
                for a in np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == runs).tolist():
                    held[i] = ids
                    for n, item, offset in places[lo[a] : np.searchsorted(known, runs[a], "right")].tolist():
                        m, k = self.groups[n].m, self.groups[n].k
                        around[n][i, item].add((max(0, a - offset - k), min(len(ids), a - offset + m + k)))
                        starts[n].update((i, p) for p in range(max(0, a - offset - k), max(0, a - offset + k) + 1))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, found in sorted(starts.items()):
            g = self.groups[n]
            places = [(i, p) for i, p in sorted(found) if p < len(held[i])]
            padded = {i: np.concatenate([held[i], np.ones(g.m, np.uint64)]) for i in {i for i, _ in places}}
            stacks = np.stack([padded[i][p : p + g.m] for i, p in places])
            searched: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)

            def verify(i: int, item: int, lo: int, hi: int) -> None:
                key, words = g.items[item]
                edits, end = distance(words.tolist(), held[i][lo:hi].tolist())
                if edits <= g.k:
                    best[i, key] = min(best.get((i, key), (g.m + 1, 0)), (edits, max(0, lo + end - g.m)))

            for w, item in sorted(g.candidates(stacks)):
                i, p = places[w]
                done = searched[i, item]
                if done and p < done[-1][1] - g.m - g.k:  # an exact search over this stretch was made already
                    continue
                done.append((max(0, p - g.k), min(len(held[i]), p + 2 * g.m + 2 * g.k)))
                verify(i, item, *done[-1])
            # what the tables miss: all that stands around an unchanged piece and was not searched yet
            for (i, item), stretches in around[n].items() if not tables_only else ():
                for lo, hi in merged(x for x in stretches if not covered(searched[i, item], *x)):
                    verify(i, item, lo, hi)
        return [(i, key, d, at) for (i, key), (d, at) in sorted(best.items())]


_INDEX: dict[tuple[int, float], Index] = {}


def hits(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, edits, first_word): documents with a passage within `edits` of a benchmark item.

    Items without words (null, empty) match nothing, nor do texts without words. Repeated items and rows each give
    their hits. Empty tables give an empty result; other columns play no part. The benchmark is a stated set; it is
    taken in blocks of BLOCK items, each sent to every task.
    """
    spark = docs.sparkSession
    ship(spark)
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator()
    item_type, out, block = to_arrow_type(benchmark.schema["item_id"].dataType), None, []

    def one(items: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, names = (hash(tuple(sent.value)), edits), [x for x, _ in sent.value]
            if key not in _INDEX:
                _INDEX.clear()
                _INDEX[key] = Index([x for _, x in sent.value], edits)
            for batch in batches:
                found = _INDEX[key].search(batch.column("text").to_pylist())
                at, item, d, first = map(list, zip(*found, strict=True)) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([names[x] for x in item], item_type), pa.array(d, pa.int64()), pa.array(first, pa.int64())], names=["doc_id", "item_id", "edits", "first_word"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits long, first_word long")

    for row in rows:
        block.append((row.item_id, row.text))
        if len(block) == BLOCK:
            out, block = one(block) if out is None else out.unionByName(one(block)), []
    if block or out is None:
        out = one(block) if out is None else out.unionByName(one(block))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """docs without those that hold a benchmark passage. Rows with a null doc_id are kept."""
    bad = hits(docs, benchmark, edits).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)

"""Token-id files: canonical length-limited Huffman blocks with bit-offset checkpoints.

Encoding: texts become ids once and are kept as a table. Counts of ids over all documents give one code, whose size is
bounded by the vocabulary. The rows are then dealt by ranges of doc_id, each range is a segment, and each segment is
written as blocks that decode on their own. A block holds whole documents, at least BLOCK ids if there are as many.

File format (a row of a Parquet table each): segment, block; first, the ids that stand before it in its segment;
doc_ids and lengths of its documents; bits, the codes, the first bit highest; checkpoints, the offset in bits of every
STEP-th id as little-endian unsigned 64-bit integers. The code is a table beside it: id, length. Codes are canonical:
by length, then by id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch, ship

END = 0
BLOCK = 1 << 16
STEP = 64
#: Longest code in bits, unless the ids in use need more.
LIMIT = 16
#: Units that a worker keeps; units beyond are encoded again in each batch of texts that holds them.
KEEP = 700_000
#: Units that are encoded in one text.
PART = 8192
#: Marks that a unit often ends with.
MARKS = ".,!?;:%&$*#|)"


class Tokens:
    """What units become: the texts at hand, and at least the first KEEP units. A unit is a word with the space before it
    (kept without that space), or a line feed with the word after it; no bytes for a unit that must not be taken out of
    its text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        first = {s[:1] for s in self.special}
        self.mark = first.pop() if len(first) == 1 else ""  # what every special token begins with
        self.marks: dict[str, bytes] = {}
        self.feed = self.ids("\n")
        self.apart = len(self.feed) == self.width and self.ids("a\n b\nc") == b"".join(map(self.ids, ("a", "\n", " b", "\n", "c")))

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, units: list[str]) -> None:
        """Encode new units in two long texts: single spaces and line feeds always end a pre-token, so the ids of the
        line feeds between them tell the units apart."""
        known, whole, ending = self.known, set(), []
        for u in units:
            word = u[1:] if u[:1] == "\n" else u
            if word.split() != [word] or self.mark in word and any(s in word for s in self.special):
                known[u] = b""
            elif (stem := u.rstrip(MARKS)) != u and stem[-1:].isalpha():  # marks after a letter are a pre-token
                ending.append((u, stem, u[len(stem) :]))
                whole.add(stem)
            else:
                whole.add(u)
        whole = [u for u in whole if u not in known]
        for every, glue in (([u for u in whole if u[:1] != "\n"], "\n "), ([u for u in whole if u[:1] == "\n"], "")):
            for some in (every[i : i + PART] for i in range(0, len(every), PART)):
                text = glue + glue.join(some) + "\n" if glue else "".join(some) + "\n"
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
                cuts = np.flatnonzero(ids == np.frombuffer(self.feed, self.kind)[0])
                data = ids.tobytes()
                skip = self.width if glue else 0  # a line feed is the glue there, and part of the unit here
                for u, a, b in zip(some, (cuts[:-1] * self.width).tolist(), (cuts[1:] * self.width).tolist(), strict=True):
                    known[u] = data[a + skip : b]
        for u, stem, marks in ending:
            if marks not in self.marks:
                self.marks[marks] = self.ids(marks)
            known[u] = known[stem] + self.marks[marks]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts and the end id. Arrow cuts the texts into units and numbers the distinct ones, so Python
        sees each once a batch. A text with other white space than single spaces and line feeds, or with a special token,
        goes to the tokenizer as it is."""
        end = np.array([END], self.kind).tobytes()
        if not self.apart:
            return [self.ids(t or "") + end for t in texts.to_pylist()]
        fed = pc.binary_join_element_wise("\n", pc.replace_substring(texts.fill_null(""), "\n", " \n"), "")
        units = pc.split_pattern(fed, " ")
        flat = units.flatten().dictionary_encode()
        names, before = flat.dictionary.to_numpy(zero_copy_only=False), len(self.known)
        found = list(map(self.known.get, names))
        self.learn(new := [u for u, x in zip(names, found, strict=True) if x is None])
        if new:
            found = [self.known[u] if x is None else x for u, x in zip(names, found, strict=True)]
        part = np.frombuffer(b"".join(found), self.kind)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        code = flat.indices.to_numpy(zero_copy_only=False)
        n = size[code]
        ends = np.cumsum(n)
        ids = part[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(size) - size)[code] - ends + n, n)]
        # every text begins with a line feed of ours: all ids move up by one, and the end id takes the last place
        cuts = np.concatenate([[0], ends])[units.offsets.to_numpy() - units.offsets[0].as_py()]
        data = ids.tobytes()
        cut = (cuts * self.width).tolist()
        out = [data[a + self.width : b] + end for a, b in zip(cut, cut[1:], strict=False)]
        odd = size == 0
        if odd.any():
            rows = np.searchsorted(units.offsets.to_numpy()[1:] - units.offsets[0].as_py(), np.flatnonzero(odd[code]), "right")
            for i in np.unique(rows).tolist():
                out[i] = self.ids(texts[i].as_py() or "") + end
        while len(self.known) > max(KEEP, before):
            self.known.popitem()  # the latest ones
        return out


_LOADED: dict[str, Tokens] = {}


def loaded(path: str) -> Tokens:
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, 16 bits an id if the vocabulary allows, else 32), the end id appended.

    A null or empty text has the end id alone; texts of any length are encoded whole; rows are taken one by one, so
    repeats are alike, null doc_ids stay and an empty table gives an empty result. Other columns of docs play no part.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(tokenizer_path)
        for batch in batches:
            data = tokens.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // tokens.width for x in data], pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def _ids(n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def counts(encoded: DataFrame) -> DataFrame:
    """id, count over all documents; each task adds up its own ids first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            ids = [_ids(n, data) for n, data in zip(batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True)]
            c = np.bincount(np.concatenate(ids)) if ids else total[:0]
            if len(c) > len(total):
                total, c = c.astype(np.int64), total
            total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "count"])

    return encoded.select("n_tokens", "ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def code_lengths(weights: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of a best prefix code with none above the limit, by package-merge; weights: positive, of any order."""
    n = len(weights)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(weights, kind="stable")
    leaves, levels, pairs = weights[order], [], np.zeros(0, weights.dtype)
    for _ in range(limit):
        every = np.concatenate([leaves, pairs])
        by = np.argsort(every, kind="stable")
        levels.append(by < n)
        every = every[by]
        pairs = every[: len(every) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        found = int(is_leaf[:take].sum())
        lengths[:found] += 1
        take = 2 * (take - found)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes of ids, and tables for coding and decoding arrays of them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        self.longest = int(lengths.max()) if len(lengths) else 1
        steps = np.left_shift(np.int64(1), self.longest - lengths)
        codes = (np.cumsum(steps) - steps) >> (self.longest - lengths)
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids], self.length[ids] = codes, lengths
        self.symbol, self.bits = np.repeat(ids, steps).astype(np.uint32), np.repeat(lengths, steps).astype(np.int64)

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits of ids, and the offset of every STEP-th. A word of 64 bits gets what begins in it by one sum."""
        n, code = self.length[ids], self.code[ids]
        end = np.cumsum(n)
        start = end - n
        word, room = start >> 6, 64 - (start & 63) - n
        into = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        out = np.zeros((int(end[-1]) + 63 >> 6) + 1, np.uint64)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[heads]] = np.add.reduceat(into, heads)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], start[::STEP].astype("<u8").tobytes()

    def unpack(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """All stretches between checkpoints are read side by side, one id of each at a time."""
        b = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint64)
        window = b[:-4] << np.uint64(32) | b[1:-3] << np.uint64(24) | b[2:-2] << np.uint64(16) | b[3:-1] << np.uint64(8) | b[4:]
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        out = np.zeros((STEP, len(at)), np.uint32)
        shift, mask = 40 - self.longest, np.uint64((1 << self.longest) - 1)
        for k in range(STEP):
            live = len(at) if (len(at) - 1) * STEP + k < n else len(at) - 1
            if not live:
                break
            p = at[:live]
            i = (window[p >> 3] >> (shift - (p & 7)).astype(np.uint64) & mask).astype(np.int64)
            out[k, :live] = self.symbol[i]
            p += self.bits[i]
        return out.T.ravel()[:n]


def build_code(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in use and their code lengths. At most one row for each id of the vocabulary comes to the driver."""
    rows = counted.orderBy("id").toPandas()
    return rows["id"].to_numpy(np.int64), code_lengths(rows["count"].to_numpy(np.int64))


def write(encoded: DataFrame, path: str) -> None:
    """Write path/code and path/blocks, in ascending order of doc_id (nulls first), ties by their ids. Repeated rows are
    documents each; a document of any length stands whole in one block; an empty table gives empty files."""
    spark = encoded.sparkSession
    ids, lengths = build_code(counts(encoded))
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist(), strict=True)), "id long, length long").coalesce(1).write.parquet(f"{path}/code")
    sent = spark.sparkContext.broadcast((ids, lengths))  # bounded by the vocabulary
    key = F.xxhash64("ids")
    ranged = encoded.withColumn("_key", key).repartitionByRange("doc_id", "_key").sortWithinPartitions("doc_id", "_key").drop("_key")
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, names, held, got, first, k = Code(*sent.value), [], [], 0, 0, 0
        segment = 0

        def block() -> pa.RecordBatch:
            data = np.concatenate(held)
            bits, checkpoints = code.pack(data)
            row = {"segment": [segment], "block": [k], "first": [first], "doc_ids": [names], "lengths": [[len(x) for x in held]], "bits": [bits], "checkpoints": [checkpoints]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("segment", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(id_type)), ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()), ("checkpoints", pa.binary())]))

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for s, d, n, data in zip(*(batch.column(c).to_pylist() for c in ("segment", "doc_id", "n_tokens", "ids")), strict=True):
                segment = s
                names.append(d)
                held.append(_ids(n, data))
                got += n
                if got >= BLOCK:
                    yield block()
                    names, held, first, got, k = [], [], first + got, 0, k + 1
        if held:
            yield block()

    rows = ranged.withColumn("segment", F.spark_partition_id().cast("long"))
    rows.mapInArrow(run, f"segment long, block long, first long, doc_ids array<{kind}>, lengths array<long>, bits binary, checkpoints binary").write.parquet(f"{path}/blocks")


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (32-bit, little-endian) of every document in the files."""
    ship(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    table = spark.read.parquet(f"{path}/code").orderBy("id").toPandas()
    sent = spark.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["length"].to_numpy(np.int64)))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*sent.value)
        for batch in batches:
            for segment, first, names, lengths, bits, checkpoints in zip(*(batch.column(c).to_pylist() for c in ("segment", "first", "doc_ids", "lengths", "bits", "checkpoints")), strict=True):
                n = np.array(lengths, np.int64)
                ends = np.cumsum(n)
                data = code.unpack(bits, checkpoints, int(ends[-1])).astype("<u4").tobytes()
                parts = [data[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths, strict=True)]
                id_type = batch.schema.field("doc_ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), segment)), pa.array(names, id_type), pa.array(first + ends - n), pa.array(n), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts if with_ids else [None] * len(n), pa.binary())], names=["segment", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    docs = blocks.mapInArrow(run, f"segment long, doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")
    sizes = blocks.groupBy("segment").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("segment", before.alias("_base"))  # a row for each segment: as many as partitions
    return docs.join(F.broadcast(bases), "segment").select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(docs: DataFrame, tokenizer_path: str, with_ids: bool = True) -> DataFrame:
    """Encode docs, write the files to the shared folder, read them back.

    A null or empty text holds the end id alone; null doc_ids come first; repeated rows each have their place; an
    empty table gives an empty result. Other columns of docs play no part.
    """
    path = scratch(docs.sparkSession)
    write(save(encode(docs, tokenizer_path), "ids"), path)
    return read(docs.sparkSession, path, with_ids)

"""SentencePiece merge-type encoding by backtracking, and decoding, for models with byte fallback.

A sequence of pieces is what merging gives exactly if each piece merges to itself and each two neighbours, merged
again from their characters, stay apart at their border. The encoder walks a unit from the left with the longest
piece at each place (one Aho-Corasick pass finds them), goes on only over compatible neighbours, and backs up when no
piece fits; a bitfield marks the positions from which no way leads to the end, so no position is tried twice.
No piece holds a space mark after another character, so a text falls into units that begin with space marks; units
repeat, and each worker keeps what it has encoded.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import ship

MARK = "▁"
#: Units kept by a worker; at this size the store is emptied.
KEEP = 400_000


class Pieces:
    """Tables of one model: piece string -> id, score, longest shorter prefix; and checks of neighbours."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.text: list[str | None] = []
        self.byte = {}
        self.score, self.id = {}, {}
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(None)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append("" if model.is_control(i) else " ⁇ ")
            else:
                self.text.append(piece.replace(MARK, " "))
                self.id[piece], self.score[piece] = i, model.get_score(i)
        self.value = {i: b for b, i in self.byte.items()}
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)  # then a text is one unit
        self.newline_apart = not any("\n" in p for p in self.id)
        self.fits: dict[tuple[str, str], bool] = {}
        usable = [p for p in self.id if self.merge(p) == [p]]
        self.finder = ahocorasick.Automaton()
        for p in usable:
            self.finder.add_word(p, len(p))
        self.finder.make_automaton()
        known = set(usable)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in usable}

    def merge(self, text: str) -> list[str]:
        """Merging from characters: the best score first, at a tie the leftmost pair."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > KEEP:
                self.fits.clear()
            known = self.fits[key] = self.merge(left + right) == [left, right]
        return known

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit; a character that no piece begins with stands alone."""
        n = len(unit)
        longest = [1] * n
        for end, length in self.finder.iter(unit):
            start = end + 1 - length
            if length > longest[start]:
                longest[start] = length
        failed, out, pos = 0, [], 0
        piece: str | None = unit[: longest[0]] if n else None
        while pos < n:
            end = pos + len(piece)
            if not failed >> end & 1 and (not out or self.compatible(out[-1], piece)):
                out.append(piece)
                pos = end
                piece = unit[pos : pos + longest[pos]] if pos < n else None
                continue
            piece = self.shorter.get(piece)
            while piece is None:
                failed |= 1 << pos
                if not out:
                    return self.merge(unit)  # not reached while neighbours decide; kept so that no text is lost
                last = out.pop()
                pos -= len(last)
                piece = self.shorter.get(last)
        return out

    def ids(self, unit: str) -> list[int]:
        out = []
        for p in self.split(unit):
            if (i := self.id.get(p)) is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(self.unk)
        return out

    def decoded(self, ids: list[int]) -> str:
        """Text of ids, space marks as spaces, runs of byte pieces as UTF-8 with U+FFFD for each stray byte."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, None]:
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run = bytearray()
            if i is not None:
                out.append(self.text[i])
        return "".join(out)


def _utf8(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Units(dict):
    """unit (without its first space mark, or beginning with a line feed) -> bytes of its ids, its decoded text."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, unit: str) -> tuple[bytes, str]:
        p = self.pieces
        if unit[:1] == "\n":
            ids = p.ids("\n") + p.ids(unit[1:])
        else:
            ids = p.ids(MARK + unit)
        if len(self) >= KEEP:
            self.clear()
        out = self[unit] = (packed(ids), p.decoded(ids))
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Little-endian 32-bit ids between begin and end ids, and the decoded text."""
        p = self.pieces
        text = text or ""
        if not text:
            body, said = b"", ""
        else:
            units = text.replace("\n", " \n").split(" ")
            if p.newline_apart and not p.whole and MARK not in text and "" not in units:
                found = [self[u] for u in units]
                body, said = b"".join([x for x, _ in found]), "".join([x for _, x in found])
            else:
                marked = (MARK + text).replace(" ", MARK)
                ids = [p.ids(u) for u in ([marked] if p.whole else re.findall(f"{MARK}+[^{MARK}]*", marked))]
                ids = [i for x in ids for i in x]
                body, said = packed(ids), p.decoded(ids)
            said = said[1:] if said[:1] == " " else said  # the mark that encoding puts before a text
        return packed([p.bos]) + body + packed([p.eos]), said


def packed(ids: list[int]) -> bytes:
    import array

    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


_LOADED: dict[str, Units] = {}


def loaded(path: str) -> Units:
    if path not in _LOADED:
        _LOADED[path] = Units(Pieces(path))
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with `ids` (binary, little-endian unsigned 32-bit, begin and end ids included) and `decoded`.

    A null or empty text has just the begin and end ids and decodes to an empty text. Rows are taken one by one, so
    repeated rows and ties are alike and an empty table gives an empty result. A column of docs named ids or decoded
    is replaced. model_path must exist on every executor.
    """
    ship(docs.sparkSession)
    docs = docs.drop("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = loaded(model_path)
        for batch in batches:
            both = [units.encode(t) for t in batch.column("text").to_pylist()]
            new = [pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("ids", BinaryType()), StructField("decoded", StringType())]))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row.

    Nulls, empty and long texts, repeats and empty tables as for encode; other columns of docs play no part.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = loaded(model_path)
        for batch in batches:
            both = [units.encode(t) for t in batch.column("text").to_pylist()]
            sha = [hashlib.sha256(x).hexdigest() for x, _ in both], [hashlib.sha256(x.encode()).hexdigest() for _, x in both]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x, _ in both], pa.int64()), *map(pa.array, sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

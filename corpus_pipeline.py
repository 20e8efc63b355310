"""From raw documents to token ids: quality rules, line dedup, near-duplicates, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame. All but
the last return the columns of documents. A stage's result must be written before the next stage is called, as run()
does: the next call drops the tables that the one before has left in the shared folder.

Every stage takes texts of any length whole, gives an empty result for an empty table, and passes other columns of
docs, whatever their names; what it does with nulls, repeated rows and ties stands with it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tristage.llm import decontaminate, lines, minhash, pieces, quality
from tristage.llm.common import drop, save, small, table, tracked, words
from tristage.llm.queries import tokenizer

_LEFT: list[str] = []


def _stage(f: Callable) -> Callable:
    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            drop(spark, _LEFT.pop())
        with tracked() as paths:
            out = f(spark, docs, sf_dir)
        _LEFT.extend(paths)
        return out

    return call


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go.

    A null text has no words and goes; a null doc_id is decided like any other; rows that repeat are decided alike; a
    score at the threshold stays.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents of which no word is left then; n_chars follows the text.

    Earlier is by doc_id, then by place. A null text stays null; lines of a null doc_id stay and remove nothing; rows
    that repeat a doc_id are versions of one document, so none removes the same line of another.
    """
    out = lines.dedup(docs).where((F.col("n_removed") == 0) | (F.size(words(F.col("text"))) > 0))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (runs of five words, similarity 0.8) the smallest doc_id stays.

    Null and empty texts are like nothing and stay, and so do rows without doc_id; rows that repeat a doc_id are one
    document and stay or go together.
    """
    gone = save(minhash.near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(small(gone, 500_000), "doc_id", "left_anti").select(docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Null and empty texts and items match nothing; rows without doc_id stay; rows that repeat a doc_id go together.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


@_stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with begin and end ids, and what they decode to: doc_id, lang, source, n_tokens, ids, decoded.

    A null text is an empty one; every row has its own result, repeats included; other columns end here.
    """
    out = pieces.encode(docs, tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express these stages; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, f in STAGES[:-1]:
        out = f(spark, docs, sf_dir)
        with tracked() as paths:
            docs = save(out, name.replace(" ", "_"))
        if before:
            drop(spark, before)
        (before,) = paths
    return STAGES[-1][1](spark, docs, sf_dir)

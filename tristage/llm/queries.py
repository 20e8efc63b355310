"""One query for each operator: (spark, sf_dir) -> DataFrame, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, decontaminate, html, licences, lines, minhash, mixing, pieces, quality, secrets, tokenids, vectorcodes, warc
from .common import save, table
from .oracle import ORACLE_SQL as ORACLE_SQL


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, which is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    out = secrets.findings(versions, secrets.ledger_of(versions))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*secrets.BASE))
    return out.select(F.col("path").alias("doc_id"), *map(count, secrets.BASE), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = mixing.sized(table(spark, sf_dir, "documents"))
    sizes = save(mixing.sources(documents), "sources")
    mixed = mixing.mix(documents, mixing.targets(sizes, mixing.cycled(sizes, (5, 2, 1)), percent=150, epochs=2))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.report(*vectorcodes.compress(table(spark, sf_dir, "embeddings"), parts=16, k=64, rounds=2, factor=256))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, factor=64, seed="1")


QUERIES = {f.__name__: f for f in (op1_warc, op2_license_scans, op3_sentencepiece, op4_minhash, op5_token_files, op6_line_dedup, op7_quality_rules, op8_decontamination, op9_html_extraction, op10_secret_scans, op11_mixing, op12_vector_codes, op13_clustering)}

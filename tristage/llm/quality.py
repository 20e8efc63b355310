"""Quality rules: counted base rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

A target multinomial over hashed one- and two-word grams comes from trusted documents, a raw one from the whole
corpus. A document's score is the mean of log(target / raw) over its grams; below `threshold` it is rejected. The
gram counts of both are full counts; the log ratios are one array of `buckets` doubles, whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Hash buckets of the multinomials.
BUCKETS = 50_000
#: At most so many trusted documents make the target; a fixed choice by hash of the id.
TRUSTED = 20_000
#: Pseudo-count of a bucket.
PRIOR = 10
#: Documents with a mean log ratio below this are rejected.
THRESHOLD = -0.1

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def windows(h: Column) -> Column:
    """A hash of each three-word window. h: the words' hashes."""
    return F.when(F.size(h) >= 3, F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))).otherwise(F.array().cast("array<bigint>"))


def _covered(win: Column) -> Column:
    """Words in windows that occur twice or more, 0 if none do.

    Windows are sorted by their whole hash, then by place, so equal ones are neighbours.
    """
    placed = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, x, i: F.coalesce(x.h == F.get(s, i).h, F.lit(False))
    hits = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x.i))
    steps = lambda r: F.transform(r, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(r, k + 1) - x), F.lit(3)))
    total = lambda r: F.aggregate(steps(r), F.lit(0).cast("long"), lambda acc, x: acc + x)
    # one-element arrays bind an intermediate result to a name, so that it is computed once
    return F.get(F.transform(F.array(placed), lambda s: F.get(F.transform(F.array(hits(s)), total), 0)), 0)


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the words' hashes `_h`.

    Columns of docs with these names are replaced.
    """
    docs = docs.drop(*MEASURES)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumn("_h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    out = out.withColumn("_win", windows(F.col("_h"))).withColumn("_lines", lines)
    bare = F.char_length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    return out.select(
        "*",
        F.size("_h").cast("long").alias("n_words"),
        bare.cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_win")) == F.size("_win"), F.lit(0).cast("long")).otherwise(_covered(F.col("_win"))).alias("n_repeat_words"),
    ).drop("_win", "_lines")


def grams(h: Column, buckets: int) -> Column:
    """Bucket of every one-word and every two-word gram."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = F.when(F.size(h) >= 2, F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.pmod(F.xxhash64(h[i - 1], h[i]), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(one, two)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with `ratios`: for each bucket, log of its target count over the count that the raw shares predict.

    PRIOR is added to both, so that a ratio leaves 0 only as far as the counts bear it out.

    trusted: a column doc_id of at most TRUSTED rows, so it may be broadcast. Without trusted rows all ratios are 0.
    """
    ids = F.broadcast(trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_t")))
    h = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    rows = docs.select("doc_id", h.alias("h")).join(ids, F.col("doc_id") == F.col("_id"), "left")
    rows = rows.select(F.coalesce("_t", F.lit(0)).alias("t"), F.explode(grams(F.col("h"), buckets)).alias("b"))
    counts = rows.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    counts = counts.unionByName(docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))).groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    one = counts.agg(F.sum("raw").alias("all"), F.sum("target").alias("good"), F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("c"))
    ratio = lambda x: F.log((x.target + PRIOR) / (x.raw * F.col("good") / F.col("all") + PRIOR))
    return one.select(F.when(F.col("good") > 0, F.transform("c", ratio)).otherwise(F.transform("c", lambda x: F.lit(0.0))).alias("ratios"))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """Ids of documents labelled good: a fixed choice of at most `limit` by hash."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the measures, score, base_failed and kept.

    Nulls: a null text has no words, so base_failed; a null doc_id is never trusted. Repeated rows are each decided
    alike; ties at the threshold are kept. Texts of any length are taken whole. An empty table gives an empty result.
    Other columns pass through; those named as one of ours, or beginning with _, are replaced.
    """
    docs = docs.drop("score", "base_failed", "kept")
    found = log_ratios(docs, trusted_ids(labels), buckets).first().ratios  # `buckets` numbers, whatever the corpus
    ratios = F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")
    m = measures(docs)
    total = lambda r: F.aggregate(grams(F.col("_h"), buckets), F.lit(0.0), lambda acc, b: acc + F.get(r, b))
    n = F.size("_h") * 2 - F.when(F.size("_h") > 0, 1).otherwise(0)
    out = m.withColumn("score", F.when(n > 0, total(ratios) / n).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold)).drop("_h")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names.

    They pass by a generator, as a filter would be pushed below the measures and have them computed again for each
    place where it uses them.
    """
    held = docs.select("doc_id", "text", *(docs[f"`{c}`"].alias(f"c{i}_") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))
    out = quality(held, labels, **options)
    once = F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    back = [F.col(c) if c in ("doc_id", "text") else F.col(f"c{i}_").alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*back, F.explode(once).alias("_once")).drop("_once")

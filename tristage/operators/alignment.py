"""Monotone alignment of the pages of two editions (rows 193, 194, 196)."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# workers need not find this package: its functions travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: similarity from which pages may be the same.
LEAST = 0.35


def similar_pages(old: DataFrame, new: DataFrame, by: list[str], page: str, items: str, least: float = LEAST) -> DataFrame:
    """Pairs of pages of one pair of editions (i, j, similarity) by Jaccard of their sets, `least` or more. Pages meet by
    what they share, so pages without anything in common are never paired."""
    side = lambda df, p: df.select(*by, F.col(page).alias(p), F.size(items).alias(f"n{p}"), F.explode(F.array_distinct(items)).alias("_t"))
    met = side(old, "i").join(side(new, "j").hint("merge"), [*by, "_t"])  # words are many times their files, so no broadcast
    met = met.groupBy(*by, "i", "j").agg(F.count("*").alias("c"), F.first("ni").alias("ni"), F.first("nj").alias("nj"))
    return met.withColumn("similarity", F.col("c") / (F.col("ni") + F.col("nj") - F.col("c"))).where(F.col("similarity") >= least).select(*by, "i", "j", "similarity")


def chain(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The pairs, ascending in both, with the largest sum of similarities: a heaviest increasing chain.

    Ends of the best chains so far are kept by j with ascending sums, so each pair takes a search and what it outdoes.
    """
    ends: list[tuple[int, float, int]] = []  # last j, sum, pair
    before: list[int] = []
    ordered = sorted(pairs, key=lambda p: (p[0], -p[1]))
    for k, (_, j, s) in enumerate(ordered):
        at = bisect_left(ends, (j,))
        total = s + (ends[at - 1][1] if at else 0.0)
        before.append(ends[at - 1][2] if at else -1)
        drop = at
        while drop < len(ends) and ends[drop][1] <= total:
            drop += 1
        if drop > at or at == len(ends) or ends[at][0] > j:
            ends[at:drop] = [(j, total, k)]
    out, k = [], ends[-1][2] if ends else -1
    while k >= 0:
        out.append(ordered[k][:2])
        k = before[k]
    return out[::-1]


def align(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, i, j of the pages that belong together. A group holds the similar pages of one pair of volumes.

    A group is one row, so a worker takes many at a time; of chains as heavy the order of i, j decides. Rows are small
    and each is work, so the count of tasks is given, as it would else be fitted to their size.
    """
    kinds, spark = dict(pairs.dtypes), pairs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    listed = pairs.repartition(n, *by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "j", "similarity"))).alias("_p"))
    listed = listed.select(*by, F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"), F.col("_p.similarity").alias("_s"))

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [chain(list(zip(i.tolist(), j.tolist(), s.tolist(), strict=True))) for i, j, s in zip(df["_i"], df["_j"], df["_s"], strict=True)]
            out = df[by].loc[df.index.repeat([len(x) for x in found])]
            yield out.assign(i=[i for x in found for i, _ in x], j=[j for x in found for _, j in x])

    return listed.mapInPandas(chains, ", ".join(f"{c} {kinds[c]}" for c in [*by, "i", "j"]))


def page_states(old: DataFrame, new: DataFrame, aligned: DataFrame, by: list[str], page: str, lines: str) -> DataFrame:
    """SAME, CHANGED, ADDED or REMOVED of each page, with how many lines came and went (row 194)."""
    o = old.select(*by, F.col(page).alias("i"), F.col(lines).alias("_o"))
    n = new.select(*by, F.col(page).alias("j"), F.col(lines).alias("_n"))
    both = o.join(aligned, [*by, "i"], "left").join(n, [*by, "j"], "full")
    came, went = F.size(F.array_except("_n", "_o")), F.size(F.array_except("_o", "_n"))
    state = F.when(F.col("_o").isNull(), "ADDED").when(F.col("_n").isNull(), "REMOVED").when((came > 0) | (went > 0), "CHANGED").otherwise("SAME")
    return both.select(*by, "i", "j", state.alias("state"), F.greatest(came, F.lit(0)).alias("came"), F.greatest(went, F.lit(0)).alias("went"))

"""Components of graphs and matchings within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.sources.shared import cut, until_still


def components(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """node and root, the smallest node that it reaches over edges in either direction.

    Every round takes the least root among neighbours, then the root of that root, so long paths halve. Roots of a node
    with many neighbours are reduced before the shuffle.
    """
    both = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    both = cut(both.union(both.select("_b", "_a")).where("_a <> _b").distinct())

    def step(state: DataFrame) -> DataFrame:
        least = both.join(state, F.col("_b") == F.col(node)).groupBy("_a").agg(F.min("root").alias("_m"))
        near = state.join(least, F.col(node) == F.col("_a"), "left").select(node, "root", F.least("root", F.coalesce("_m", "root")).alias("_r"))
        jump = state.select(F.col(node).alias("_n"), F.col("root").alias("_j"))
        out = near.join(jump, F.col("_r") == F.col("_n"), "left").select(node, F.least("_r", F.coalesce("_j", "_r")).alias("_new"), "root")
        return out.select(node, F.col("_new").alias("root"), (F.col("_new") != F.col("root")).alias("_moved"))

    return until_still(step, nodes.select(node, F.col(node).alias("root")), "_moved")


def greedy(pairs: DataFrame, by: list[str], order: list[Column], left: str, right: str) -> DataFrame:
    """Pairs taken one after another in an order, each if neither side is taken: by, left, right.

    A group is folded in one row, so by must bound it: the equal words of a page, not a corpus.
    """
    kinds = dict(pairs.dtypes)
    l_type, r_type = kinds[left], kinds[right]
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    listed = pairs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*keys, F.col(left).alias("_l"), F.col(right).alias("_r")))).alias("_p"))
    zero = F.struct(F.array().cast(f"array<{l_type}>").alias("l"), F.array().cast(f"array<{r_type}>").alias("r"))
    free = lambda acc, x: ~F.array_contains(acc.l, x["_l"]) & ~F.array_contains(acc.r, x["_r"])
    step = lambda acc, x: F.when(free(acc, x), F.struct(F.array_append(acc.l, x["_l"]).alias("l"), F.array_append(acc.r, x["_r"]).alias("r"))).otherwise(acc)
    one = F.struct(F.transform("_p", lambda x: x["_l"]).alias("l"), F.transform("_p", lambda x: x["_r"]).alias("r"))
    took = listed.withColumn("_t", F.when(F.size("_p") == 1, one).otherwise(F.aggregate("_p", zero, step)))
    return took.select(*by, F.explode(F.arrays_zip("_t.l", "_t.r")).alias("_x")).select(*by, F.col("_x.l").alias(left), F.col("_x.r").alias(right))

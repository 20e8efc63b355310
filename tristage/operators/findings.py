"""From candidates to findings as one plan (rows 260 to 276, 361): editions, sources, votes, comparison, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.operators import compare, resolve, review, voting
from tristage.operators.compare import EQUAL, IMPOSSIBLE, OK, VIOLATION

#: Stages and the columns that hold them.
STAGES = {"PD": "pd", "RD": "rd", "ID": "built"}


def sides(cands: DataFrame, by: list[str], page: list[str], wanted: Column, rank: str, chain: str, dense: DataFrame | None = None) -> DataFrame:
    """One row for each parameter: the voted value of each stage, all its values, and whether a fallback source gave it.

    Of each chain only the latest edition that names the parameter counts; sources other than the wanted ones only where
    those say nothing. Density is that of all candidates, so it is counted before any filter.
    """
    if dense is None:
        dense = voting.density(cands, page)
    kept = resolve.latest_only(cands, [*by, "stage", chain], rank)
    kept = resolve.prefer_source(kept, [*by, "stage"], wanted)
    voted = voting.weighted_vote(kept, [*by, "stage"], page, dense=dense)
    every = kept.groupBy(*by, "stage").agg(F.sort_array(F.collect_set("value")).alias("every"), F.max("fallback").alias("fallback"))
    both = voted.join(every, [*by, "stage"])
    at = lambda s, c: F.max(F.when(F.col("stage") == s, F.col(c)))
    picks = [x for s, n in STAGES.items() for x in (at(s, "value").alias(n), at(s, "every").alias(f"{n}_all"), F.coalesce(at(s, "fallback"), F.lit(False)).alias(f"{n}_fallback"), F.coalesce(at(s, "pages"), F.lit(0)).alias(f"{n}_pages"))]
    return both.groupBy(*by).agg(*picks)


def _judged(kinds: list[str], a: str, b: str) -> Column:
    """The comparison of columns a and b by the row's kind."""
    none = F.array().cast("array<double>")
    every = lambda c: F.coalesce(F.col(f"{c}_all"), none)
    out = F.lit(None).cast("struct<label: string, result: string>")
    for k in kinds:
        out = F.when(F.col("kind") == k, compare.judge(k, F.col(a), F.col(b), every(a), every(b), threshold=F.col("threshold"), tolerance=F.col("tolerance"))).otherwise(out)
    return out


def build(cands: DataFrame, rules: DataFrame, page: list[str], wanted: Column, rank: str, chain: str, kinds: list[str]) -> DataFrame:
    """Findings of all rules (code, kind, threshold, tolerance, strict): code, kind, label, result, pd, rd, built, status.

    The as-built stage is compared with the working one, or with the design if that is missing. Values of which both
    come from a fallback source and differ, and values of strict rules from a fallback source, cannot be compared.
    """
    s = sides(cands, ["code"], page, wanted, rank, chain).join(F.broadcast(rules), "code")  # rules are a catalogue of fixed size
    none = F.array().cast("array<double>")
    s = s.withColumn("ref", F.coalesce("rd", "pd")).withColumn("ref_all", F.coalesce("rd_all", "pd_all", none))
    with_built = F.when(F.col("built").isNotNull() & F.col("ref").isNotNull(), _judged(kinds, "ref", "built"))
    s = s.withColumn("first", _judged(kinds, "pd", "rd")).withColumn("second", with_built)
    s = s.withColumn("j", compare.id_review(F.col("first"), F.col("second"), F.col("pd").isNotNull(), F.col("rd").isNotNull()))
    loose = F.col("pd_fallback") & F.col("rd_fallback") & (F.col("pd") != F.col("rd")) | F.col("strict") & (F.col("pd_fallback") | F.col("rd_fallback"))
    label = F.when(F.coalesce(loose, F.lit(False)) & F.col("j.label").isNotNull(), IMPOSSIBLE).otherwise(F.col("j.label"))
    result = F.when(label == F.col("j.label"), F.col("j.result"))
    missing = F.col("pd").isNull() | F.col("rd").isNull()
    out = s.withColumn("label", label).withColumn("result", result).where("label is not null")
    return out.select("code", "kind", "label", "result", "pd", "rd", "built", review.finding_status(F.col("label"), F.lit(None).cast("string"), missing).alias("status"))


def of_keys(keyed: DataFrame, by: list[str], key: str, changed: Column, strict: bool = False) -> DataFrame:
    """One finding for each parameter from its keys with sets of both stages (pd, rd; rows 260, 268, 276).

    Any change is a violation, without `strict` a hypothesis only; a stage without values or no common key cannot be
    compared; else there is none. keys: how many were compared; changes: the first of those that changed, sorted.
    """
    has = lambda c: F.size(c) > 0
    both = has("pd") & has("rd")
    rows = keyed.withColumn("_c", F.coalesce(changed, F.lit(False)))
    out = rows.groupBy(*by).agg(F.count_if("_c").alias("_n"), F.count_if(both).alias("keys"), F.count_if(has("pd")).alias("_p"), F.count_if(has("rd")).alias("_r"), F.sort_array(F.collect_set(F.when(F.col("_c"), F.col(key)))).alias("changes"))
    label = F.when(F.col("_n") > 0, VIOLATION).when((F.col("_p") == 0) | (F.col("_r") == 0) | (F.col("keys") == 0), IMPOSSIBLE).otherwise(OK)
    result = F.when(F.col("_n") > 0, "VALUE_MISMATCH").when(label == OK, EQUAL)
    return out.select(*by, label.alias("label"), result.alias("result"), "keys", "changes", ((F.col("_n") > 0) & F.lit(not strict)).alias("hypothesis"))

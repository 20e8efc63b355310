"""What follows a decision: statuses, guards, merging a new run into the old one (rows 250 to 252, 361 to 381)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.operators.compare import IMPOSSIBLE, OK, VIOLATION

#: Decisions of an inspector.
DECIDED = ("CONFIRMED_VIOLATION", "NEGATIVE_VERIFIED", "CLARIFICATION_REQUIRED")
#: What an inspector's mark in a record's body is called.
KEPT = ("promoted_at", "promoted_by", "disputed_at", "disputed_by")


def stages_present(statuses: Column) -> Column:
    """Stages with an accepted file, from marks such as PD_UPLOADED (row 374)."""
    here = F.filter(statuses, lambda s: s.rlike("_(UPLOADED|PARTIAL)$"))
    return F.array_distinct(F.transform(here, lambda s: F.regexp_extract(s, "^([^_]*)", 1)))


def absent_stage(label: Column, pd: Column, rd: Column, present: Column) -> Column:
    """The stage that was never uploaded and so left a record without value; null if none."""
    gone = lambda value, stage: (F.coalesce(value, F.lit("")) == "") & ~F.array_contains(present, stage)
    return F.when(label.isin(VIOLATION, OK), None).when(gone(pd, "PD"), F.lit("PD")).when(gone(rd, "RD"), F.lit("RD"))


def mark_absent(label: Column, pd: Column, rd: Column, present: Column) -> Column:
    """violation_label and protocol_status where a stage is absent (row 373)."""
    stage = absent_stage(label, pd, rd, present)
    return F.struct(F.when(stage.isNotNull(), F.lit("MISSING_DOCUMENT")).otherwise(label).alias("violation_label"), F.concat(stage, F.lit("_MISSING")).alias("protocol_status"))


def completeness(label: Column, pd: Column, rd: Column, present: Column) -> Column:
    """COMPLETE, MISSING_EVIDENCE or NOT_COMPARABLE (row 372)."""
    empty = lambda v: F.coalesce(v, F.lit("")) == ""
    missing = absent_stage(label, pd, rd, present).isNotNull() | (label == "MISSING_DOCUMENT") | empty(pd) | empty(rd)
    return F.when(label.isin(VIOLATION, OK), "COMPLETE").when(missing, "MISSING_EVIDENCE").otherwise("NOT_COMPARABLE")


def finding_status(label: Column, status: Column, missing: Column) -> Column:
    """Status of a machine's record (row 362). missing: whether its detail says that evidence is missing."""
    said = F.when(label == "MISSING_DOCUMENT", "MISSING_EVIDENCE").when(label == IMPOSSIBLE, F.when(missing, "MISSING_EVIDENCE").otherwise("NOT_COMPARABLE")).otherwise("CANDIDATE")
    return F.when(status.isNull() | (status == "CANDIDATE"), said).otherwise(status)


def view_status(label: Column, verification: Column, hypothesis: Column, promoted: Column, completeness_: Column) -> Column:
    """Status of a record as shown (survey 2.15, finding status)."""
    decided = F.when(verification.isin(*DECIDED), verification).otherwise("CANDIDATE")
    other = F.when(completeness_ == "NOT_COMPARABLE", "NOT_COMPARABLE").otherwise("MISSING_EVIDENCE")
    return F.when(hypothesis & ~promoted, "SUSPICION").when(label == VIOLATION, decided).when(label == OK, "NEGATIVE_VERIFIED").otherwise(other)


def counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of records (verification, label, hypothesis: unpromoted, changed: since the decision) per key (rows 250, 251)."""
    v, label = F.col("verification"), F.col("label")
    open_hypothesis = F.col("hypothesis") & (v == "PENDING")
    flags = {
        "total": F.lit(True),
        "candidates": ~v.isin("NOT_REQUIRED", "SPLIT") & ~open_hypothesis,
        "pending": (v == "PENDING") & ~open_hypothesis,
        "hypotheses": open_hypothesis,
        "confirmed": v == "CONFIRMED_VIOLATION",
        "rejected": v == "NEGATIVE_VERIFIED",
        "clarification": v == "CLARIFICATION_REQUIRED",
        "split": v == "SPLIT",
        "no_violation": (v == "NOT_REQUIRED") & (label == OK),
        "not_comparable": (v == "NOT_REQUIRED") & label.isin(IMPOSSIBLE, "MISSING_DOCUMENT"),
        "revisit": F.col("changed") & v.isin(*DECIDED),
    }
    return rows.groupBy(*by).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()))


def settle(confirmed: Column, rejected: Column, clarification: Column, split: Column, pending: Column) -> Column:
    """Status of a process by its counts (row 380)."""
    none = (confirmed + rejected + clarification == 0) & (split == 0)
    return F.when(none, "READY").when(pending == 0, "COMPLETED").otherwise("VERIFYING")


def refusal(action: Column, process: Column, verification: Column, label: Column, hypothesis: Column, disputed: Column) -> Column:
    """Why a decision is not allowed; null if it is (row 381)."""
    dispute = F.when((verification != "NOT_REQUIRED") | ~label.eqNullSafe(OK), "NOT_AUTO_NEGATIVE")
    return (
        F.when((process == "COMPLETED") & ~action.isin("RESET", "DISPUTE"), "VERIFICATION_COMPLETED")
        .when(action == "DISPUTE", dispute)
        .when(verification == "NOT_REQUIRED", "NOT_A_CANDIDATE")
        .when(verification == "SPLIT", "FINDING_SPLIT")
        .when(hypothesis & (action != "PROMOTE"), "HYPOTHESIS_NOT_CANDIDATE")
        .when(~hypothesis & (action == "PROMOTE"), "NOT_A_HYPOTHESIS")
        .when((action == "RESET") & ~verification.isin(*DECIDED) & ~disputed, "NOT_DECIDED")
    )


def cell(compared: Column, statuses: Column, group: Column) -> Column:
    """State of a dashboard cell (row 252)."""
    has = lambda *s: F.arrays_overlap(statuses, F.array(*map(F.lit, s)))
    return F.when(~compared, group).when(has("CONFIRMED_VIOLATION"), "VIOLATION").when(has("CANDIDATE", "CLARIFICATION_REQUIRED"), "CANDIDATE").otherwise("CLEAN")


def priority(criticality: Column) -> Column:
    """Order of review by criticality (row 346)."""
    return F.when(criticality.startswith("Критическое"), "HIGH").when(criticality.startswith("Существенное"), "MEDIUM").otherwise("LOW")


def confidence(label: Column, low: Column, medium: Column) -> Column:
    """LOW, MEDIUM or HIGH from how many arguments speak against a compared record (row 345)."""
    return F.when(label.isin(VIOLATION, OK), F.when(low > 0, "LOW").when(medium > 0, "MEDIUM").otherwise("HIGH"))


def merge(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The records after a new run over an object (survey 2.15, finding MERGE and delete).

    old: key, label, pd, rd, verification, origin, marks (map of an inspector's marks); new: key, label, pd, rd and
    candidate. Values are those of the new run; a record that it lacks goes, unless an inspector split it off. The
    decision stays, but for records without need of one, and for decided ones that the new run no longer supports,
    which come back to the inspector as reopened.
    """
    o = old.select(*key, *(F.col(c).alias(f"o_{c}") for c in ("label", "pd", "rd", "verification", "origin", "marks")), F.lit(True).alias("_o"))
    n = new.select(*key, *(F.col(c).alias(f"n_{c}") for c in ("label", "pd", "rd")), F.when(F.col("candidate"), "PENDING").otherwise("NOT_REQUIRED").alias("n_v"), F.lit(True).alias("_n"))
    both = o.join(n, key, "full")
    was, now, marks = F.col("o_verification"), F.col("n_v"), F.coalesce("o_marks", F.create_map().cast("map<string,string>"))
    has = lambda k: F.map_contains_key(marks, k)
    reopens = (now == "NOT_REQUIRED") & was.isin("CONFIRMED_VIOLATION", "CLARIFICATION_REQUIRED")
    waits = has("reopened") & (was == "PENDING")
    status = F.when(F.col("_o").isNull(), now).when(F.col("_n").isNull(), was).when(was == "SPLIT", "SPLIT").when(has("disputed_at"), "PENDING").when(reopens, "PENDING").when(waits, "PENDING").when(now == "NOT_REQUIRED", "NOT_REQUIRED").when(was == "NOT_REQUIRED", "PENDING").otherwise(was)
    stale = has("changed_after_decision") & was.isin(*DECIDED) & (now != "NOT_REQUIRED")
    kept = F.map_filter(marks, lambda k, v: k.isin(*KEPT) | (k == "changed_after_decision") & stale | (k == "reopened") & waits & ~reopens)
    kept = F.when(F.col("_n").isNull(), marks).when(reopens, F.map_concat(kept, F.create_map(F.lit("reopened"), was))).otherwise(kept)
    pick = lambda c: F.when(F.col("_n").isNull(), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c)
    out = both.where(F.col("_n").isNotNull() | (F.col("o_origin") == "INSPECTOR_SPLIT"))
    return out.select(*key, pick("label"), pick("pd"), pick("rd"), status.alias("verification"), F.col("o_origin").alias("origin"), kept.alias("marks"))


def next_version(protocols: DataFrame, by: list[str], version: str = "version") -> DataFrame:
    """The version that the next protocol of each key gets (survey 2.15, version append)."""
    return protocols.groupBy(*by).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def approval(chain: DataFrame, by: list[str], rank: str, required: bool = False) -> DataFrame:
    """Chains with their latest member and whether approval leaves it current (survey 2.15, approval gate).

    chain: members with `file` and `approved`. The latest one counts if it is approved, or if none is and approval is
    not required; else CLARIFICATION_REQUIRED.
    """
    top = F.max_by("approved", rank)
    out = chain.groupBy(*by).agg(F.max_by("file", rank).alias("latest"), top.alias("_top"), F.max("approved").alias("_any"))
    ok = F.col("_top") | (~F.col("_any") & F.lit(not required))
    return out.select(*by, "latest", F.when(ok, "RESOLVED").otherwise("CLARIFICATION_REQUIRED").alias("status"))


def choose(chain: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Members with CURRENT or SUPERSEDED where an inspector chose one; the last choice counts (survey 2.15, manual
    override). chain: members with `file` and `chosen`; chains without a choice keep null."""
    top = chain.where("chosen").groupBy(*by).agg(F.max_by("file", rank).alias("_top"))
    return chain.join(top, by, "left").withColumn("member_status", F.when(F.col("_top") == F.col("file"), "CURRENT").when(F.col("_top").isNotNull(), "SUPERSEDED")).drop("_top")


def strong_first(cands: DataFrame, by: list[str], strong: str) -> DataFrame:
    """Candidates without the weak ones of a group that has a strong one (row 229)."""
    some = cands.where(F.col(strong)).select(*by).distinct().withColumn("_s", F.lit(True))
    return cands.join(some, by, "left").where(F.col(strong) | F.col("_s").isNull()).drop("_s")


def agreed(readings: DataFrame, by: list[str], reading: str, value: str, least: int = 2) -> DataFrame:
    """Values of each group with whether `least` readings give them; one reading alone counts whole (row 236)."""
    n = readings.groupBy(*by).agg(F.countDistinct(reading).alias("_all"))
    seen = readings.groupBy(*by, value).agg(F.countDistinct(reading).alias("readings"))
    return seen.join(n, by).withColumn("accepted", (F.col("_all") == 1) | (F.col("readings") >= least)).drop("_all")


def window_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Windows and their area in square metres: rows mark, w, h, n; a size of a mark counts once, by its largest number
    (row 228)."""
    best = rows.groupBy(*by, "mark", "w", "h").agg(F.max("n").alias("n"))
    return best.groupBy(*by).agg(F.sum("n").alias("windows"), F.round(F.sum(F.col("n") * F.col("w") * F.col("h")) / 1e6, 2).alias("area"))


def one_zone(cands: DataFrame, by: list[str], model: str, zone: str) -> DataFrame:
    """Candidates without a zone take that of their model if all stages know exactly one (row 121)."""
    known = cands.where(F.col(zone).isNotNull() & F.col(model).isNotNull()).groupBy(*by, model).agg(F.min(zone).alias("_a"), F.max(zone).alias("_b")).where("_a = _b")
    return cands.join(known, [*by, model], "left").withColumn(zone, F.coalesce(F.col(zone), "_a")).drop("_a", "_b")


def excesses(rows: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """Deviations (mark, v) beyond the largest limit declared on their sheet, once for each number of a mark and value
    (row 312)."""
    most = limits.groupBy(*by).agg(F.max("limit").alias("limit"))
    over = rows.join(most, by).where(F.abs("v") > F.col("limit"))
    return over.withColumn("digits", F.regexp_replace("mark", "[^0-9]", "")).groupBy(*by, "digits", "v").agg(F.min("mark").alias("mark"), F.first("limit").alias("limit"))


#: Extensions of signatures, which count apart from rejected files.
SIGNATURES = (".sig", ".p7s", ".sgn")


def file_counts(files: DataFrame, by: list[str]) -> DataFrame:
    """Accepted and rejected files and signatures of each stage (row 248): files with stage, status, extension. A mixed
    file counts for both of its stages."""
    stages = F.when(F.col("stage") == "RD_ID_MIXED", F.array(F.lit("RD"), F.lit("ID"))).otherwise(F.array("stage"))
    rows = files.withColumn("stage", F.explode(stages)).where(F.col("stage").isin("PD", "RD", "ID"))
    ok, mark = F.col("status") == "ACCEPTED", F.lower("extension").isin(*SIGNATURES)
    return rows.groupBy(*by, "stage").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok & ~mark).alias("rejected"), F.count_if(~ok & mark).alias("signatures"))


def upload_status(counted: DataFrame, by: list[str]) -> DataFrame:
    """Marks of the three stages and the scenario that they allow (row 249)."""
    n = lambda s, c: F.coalesce(F.max(F.when(F.col("stage") == s, F.col(c))), F.lit(0))
    s = counted.groupBy(*by).agg(*(n(s, c).alias(f"{s}_{c}") for s in ("PD", "RD", "ID") for c in ("accepted", "rejected")))
    state = lambda x: F.concat(F.lit(f"{x}_"), F.when(F.col(f"{x}_accepted") == 0, "MISSING").when(F.col(f"{x}_rejected") > 0, "PARTIAL").otherwise("UPLOADED"))
    marks = F.array(*(state(x) for x in ("PD", "RD", "ID")))
    has = F.array_join(F.filter(F.array(*(F.when(F.col(f"{x}_accepted") > 0, F.lit(x)) for x in ("PD", "RD", "ID"))), lambda x: x.isNotNull()), "_")
    partial = F.exists(marks, lambda m: m.endswith("_PARTIAL"))
    scenario = F.when(partial, "PARTIALLY_LOADED").when(has == "PD_RD_ID", "FULL").when(has.contains("_"), F.concat(has, F.lit("_ONLY"))).when(has != "", "SINGLE_ONLY")
    return s.select(*by, marks.alias("statuses"), scenario.alias("scenario"))


def registry_summary(rows: DataFrame, by: list[str], digest: str, size: str) -> DataFrame:
    """Documents, distinct contents and total size of each key (rows 005, 008, 246)."""
    return rows.groupBy(*by).agg(F.count("*").alias("documents"), F.countDistinct(digest).alias("distinct"), F.sum(size).alias("size"))

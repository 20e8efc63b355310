"""What a finding may claim: how severe it is, whether a person must confirm it, whether it is a hypothesis only (rows 351,
352, 358, 363 to 366, 368, 369). Reasons are codes; what is shown to people is made from them elsewhere.

Findings: by (their keys), parameter_code, matrix_scope, label, criticality, protocol_status, finding_status and the sides
pd, rd, built: structs of value, source, layer_conflict (other values of the text layer), doubtful (put off readings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.functions.match import hits
from tristage.operators.compare import IMPOSSIBLE, VIOLATION

#: Where readings come from, states of findings, codes of free search.
RECOGNIZED, SUSPICION, FREE, FREE_SCOPE = "RECOGNIZED", "SUSPICION", "FREE-", "FREE_SEARCH"
SIDES = ["pd", "rd", "built"]
_NOTES = "struct<up:array<string>,medium:array<string>,low:array<string>>"


def _norm(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def severity(findings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """findings with severity and severity_differs (row 351): for a violation of a catalogued parameter that of the
    catalogue (parameter_code, criticality), whatever the finding says; else its own. Free search has no catalogue."""
    known = catalogue.select(F.upper(_norm(F.col("parameter_code"))).alias("_code"), F.col("criticality").alias("_known")).dropDuplicates(["_code"])
    code = F.upper(_norm(F.col("parameter_code")))
    open_ = (F.upper(_norm(F.col("label"))) == VIOLATION) & (code != "") & ~code.startswith(FREE) & (F.upper(_norm(F.col("matrix_scope"))) != FREE_SCOPE)
    rows = findings.withColumn("_code", F.when(open_, code)).join(known, "_code", "left")
    held = _norm(F.col("_known")) != ""
    own = _norm(F.col("criticality"))
    out = rows.withColumn("severity", F.when(held, F.col("_known")).otherwise(F.col("criticality")))
    return out.withColumn("severity_differs", held & (own != "") & (F.lower(own) != F.lower(_norm(F.col("_known"))))).drop("_code", "_known")


def protocol_status(label: Column, status: Column, criticality: Column, used: Column, table: dict[str, str]) -> Column:
    """The protocol's status (row 352): the finding's own while its severity is still the one in use, else by severity.

    Without a violation it is OK, or that of an impossible comparison. table: severity in lower case -> status; a severity
    with additions goes by how it begins, the first listed that fits.
    """
    own, crit = _norm(status), F.lower(_norm(used))
    exact = F.coalesce(*(F.when(crit == k, v) for k, v in table.items()))
    begins = F.coalesce(*(F.when(crit.startswith(k.split(" (")[0]), v) for k, v in table.items()))
    plain = F.when(F.upper(_norm(label)) == "NO_VIOLATION", "OK").when(F.upper(_norm(label)) == IMPOSSIBLE, IMPOSSIBLE)
    by_severity = F.when(crit != "", F.coalesce(exact, begins))
    return F.when(own == "", F.coalesce(plain, by_severity)).when(crit == F.lower(_norm(criticality)), F.upper(own)).otherwise(by_severity)


def recognized_review(findings: DataFrame) -> DataFrame:
    """findings with machine (sides that a reader recognized), ask (reasons to have a person confirm) and needs_expert
    (row 363).

    Reasons: VIOLATION_ON_READING; LAYER_CONFLICT:side, where the text layer of other pages differs; READING_DIFFERS:side,
    where a side of the text layer differs, unless values are sets; DOUBTFUL:side for readings put off. A reading that
    agrees with the layer needs nobody. values_are_set: a boolean column, may be null.
    """
    read = {s: F.coalesce(F.col(s)["source"] == RECOGNIZED, F.lit(False)) for s in SIDES}
    machine = F.array_compact(F.array(*(F.when(read[s], s) for s in SIDES)))
    violation = F.when((F.size(machine) > 0) & (F.col("label") == VIOLATION), "VIOLATION_ON_READING")
    sets = F.coalesce(F.col("values_are_set"), F.lit(False))
    asked = [violation]
    for s in SIDES:
        layer = [F.coalesce(~read[o] & (F.col(o)["value"] != F.col(s)["value"]), F.lit(False)) | F.coalesce(~read[o] & F.col(o)["value"].isNotNull() & F.col(s)["value"].isNull(), F.lit(False)) for o in SIDES if o != s]
        asked.append(F.when(read[s] & (F.coalesce(F.size(F.col(s)["layer_conflict"]), F.lit(0)) > 0), f"LAYER_CONFLICT:{s}"))
        asked.append(F.when(read[s] & ~sets & (layer[0] | layer[1]), f"READING_DIFFERS:{s}"))
        asked.append(F.when(F.coalesce(F.size(F.col(s)["doubtful"]), F.lit(0)) > 0, f"DOUBTFUL:{s}"))
    out = findings.withColumns({"machine": machine, "ask": F.array_compact(F.array(*asked))})
    return out.withColumn("needs_expert", F.col("needs_expert") | (F.size("ask") > 0) if "needs_expert" in findings.columns else F.size("ask") > 0)


def noted(notes: Column, up: list[Column] = (), medium: list[Column] = (), low: list[Column] = ()) -> Column:
    """Notes of confidence (up: what supports a claim, medium: what to look at, low: what speaks against it) with more; null
    ones and those already there are left out."""
    none = F.array().cast("array<string>")
    add = lambda k, items: F.array_union(F.coalesce(notes[k], none), F.array_compact(F.array(*items)) if items else none).alias(k)
    return F.struct(add("up", list(up)), add("medium", list(medium)), add("low", list(low))).cast(_NOTES)


def threshold_confidence(findings: DataFrame) -> DataFrame:
    """Violations of a threshold as hypotheses with notes (row 364). threshold: TRIGGER (the parameter's own) or PROJECT
    (the design's only). notes: a struct of up, medium and low, may be null."""
    bad = F.col("label") == VIOLATION
    project = F.col("threshold") == "PROJECT"
    notes = noted(F.col("notes"), up=[F.when(bad & ~F.coalesce(project, F.lit(False)), "OWN_TRIGGER")], medium=[F.when(bad & project, "PROJECT_THRESHOLD_ONLY"), F.lit("READ_FROM_DRAWING")])
    return findings.withColumns({"notes": notes, "finding_status": F.when(bad, SUSPICION).otherwise(F.col("finding_status")), "hypothesis": F.when(bad, "TRIGGER").otherwise(F.col("hypothesis"))})


def rule_hypothesis(findings: DataFrame, snippets: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """Violations that a rule holds for hypotheses only (row 365): always, or if a pattern stands beside one of the values,
    which is noted against it.

    snippets: by, snippet; rules: parameter_code, always, patterns (array, the first that fits), reason. Findings that are
    hypotheses already stay as they are.
    """
    near = snippets.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.coalesce("snippet", F.lit("")))), " ").alias("_near"))
    rows = findings.join(near, by, "left").join(rules.select("parameter_code", "always", "patterns", F.col("reason").alias("_reason")), "parameter_code", "left")
    text = F.coalesce("_near", F.lit(""))
    found = F.transform(F.coalesce("patterns", F.array().cast("array<string>")), lambda p: F.regexp_substr(text, F.concat(F.lit("(?iu)"), p)))
    hit = F.get(F.array_compact(found), 0)
    open_ = (F.col("label") == VIOLATION) & ~F.coalesce(F.col("finding_status") == SUSPICION, F.lit(False))
    always = open_ & F.coalesce("always", F.lit(False))
    rows = rows.withColumns({"_always": always, "_hit": F.when(open_ & ~F.coalesce("always", F.lit(False)), hit)})
    taken = F.col("_always") | F.col("_hit").isNotNull()
    rows = rows.withColumns({"notes": F.when(F.col("_hit").isNotNull(), noted(F.col("notes"), low=[F.concat(F.lit("BESIDE:"), "_hit")])).otherwise(F.col("notes").cast(_NOTES)), "finding_status": F.when(taken, SUSPICION).otherwise(F.col("finding_status")), "hypothesis": F.when(taken, F.coalesce("_reason", F.lit("RULE"))).otherwise(F.col("hypothesis"))})
    return rows.select(*findings.columns)


def drawing_hypothesis(findings: DataFrame) -> DataFrame:
    """Violations from values of drawings as hypotheses, and so comparisons that a drawing leaves open (row 366).

    from_model: whether a model read any of the values (null: yes); undecided: a value is below the design's least, but the
    drawing doesn't tell of what; violation_result and rule_criticality: what an undecided one becomes.
    """
    undecided = (F.col("label") == IMPOSSIBLE) & F.coalesce("undecided", F.lit(False))
    label = F.when(undecided, VIOLATION).otherwise(F.col("label"))
    model = F.coalesce("from_model", F.lit(True))
    bad = label == VIOLATION
    notes = noted(F.col("notes"), low=[F.when(undecided, "WHICH_ELEMENT_UNKNOWN")], medium=[F.when(bad & model, "READ_BY_MODEL").when(bad, "MARK_ON_SHEET")])
    rows = findings.withColumns({"_label": label, "_notes": notes})
    rows = rows.withColumns({"result": F.when(undecided, F.coalesce("violation_result", F.lit("VALUE_DECREASE"))).otherwise(F.col("result")), "criticality": F.when(undecided, F.col("rule_criticality")).otherwise(F.col("criticality")), "hypothesis": F.when(bad, F.when(model, "DRAWING").otherwise("DRAWING_TEXT")).otherwise(F.col("hypothesis")), "finding_status": F.when(bad, SUSPICION).otherwise(F.col("finding_status"))})
    return rows.withColumns({"label": F.col("_label"), "notes": F.col("_notes")}).select(*findings.columns)


def provisional(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of draft rules, put off (row 368), and those of them that are shown as hypotheses: violations (row 358)."""
    off = findings.withColumns({"provisional": F.lit(True), "for_submission": F.lit(False), "needs_expert": F.lit(True), "finding_status": F.lit(SUSPICION), "exclusion_reason": F.lit("PROVISIONAL_RULE")})
    return off, off.where(F.col("label") == VIOLATION)


def known_values(pages: DataFrame, cands: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """by, parameter_code and values: the numbers that texts of the design name on sheets of the kind that a rule reads
    (row 369), in the files of its candidates.

    pages: by, file_id, text; cands: by, parameter_code, file_id; rules: parameter_code, sheet_text (a pattern), low, high.
    Numbers have three to five digits and lie within the rule's range. Distinct numbers are gathered before the shuffle.
    """
    files = cands.where("file_id IS NOT NULL").select(*by, "parameter_code", "file_id").distinct()
    asked = files.join(rules.where("sheet_text IS NOT NULL"), "parameter_code")
    rows = pages.where("text IS NOT NULL").join(asked, [*by, "file_id"]).where(F.rlike(F.col("text"), F.concat(F.lit("(?iu)"), "sheet_text")))
    numbers = rows.select(*by, "parameter_code", "low", "high", F.explode(hits(F.col("text"), r"(?<![0-9.,])([0-9]{3,5})(?![0-9.,])", ["n"])).alias("h")).withColumn("v", F.col("h.n").cast("int"))
    kept = numbers.where((F.col("v") >= F.coalesce("low", F.lit(0.0))) & (F.col("v") <= F.coalesce("high", F.lit(float("inf"))))).select(*by, "parameter_code", "v").distinct()
    return kept.groupBy(*by, "parameter_code").agg(F.sort_array(F.collect_list("v")).alias("values"))

"""Severity, confirmation and hypotheses of findings: cases by hand."""

from pyspark.sql import functions as F

from tristage.operators import judgement as J

TABLE = {"критическое (приостановка работ)": "STOP", "существенное (предписание)": "ORDER", "незначительное": "NOTE"}


def test_severity_and_status(spark):
    rows = [
        (1, "KR-1", None, "VIOLATION_PRESENT", "Существенное (предписание)", "ORDER"), (2, " kr-2 ", None, "VIOLATION_PRESENT", None, None), (3, "KR-1", None, "NO_VIOLATION", None, None), (4, "FREE-9", None, "VIOLATION_PRESENT", "Незначительное", None),
        (5, "KR-1", "FREE_SEARCH", "VIOLATION_PRESENT", "Незначительное", "note"), (6, None, None, "COMPARISON_IMPOSSIBLE", None, None), (7, "KR-3", None, "VIOLATION_PRESENT", "Существенное — требует утверждения", None), (8, "KR-4", None, "VIOLATION_PRESENT", "иное", None),
    ]
    f = spark.createDataFrame(rows, "i int, parameter_code string, matrix_scope string, label string, criticality string, protocol_status string")
    cat = spark.createDataFrame([("kr-1", "Критическое (приостановка работ)"), ("KR-2", "Незначительное"), ("KR-3", ""), ("KR-3", "")], "parameter_code string, criticality string")
    out = J.severity(f, cat).withColumn("s", J.protocol_status(F.col("label"), F.col("protocol_status"), F.col("criticality"), F.col("severity"), TABLE))
    got = {r.i: (r.severity, r.severity_differs, r.s) for r in out.collect()}
    assert got == {
        1: ("Критическое (приостановка работ)", True, "STOP"), 2: ("Незначительное", False, "NOTE"), 3: (None, False, "OK"), 4: ("Незначительное", False, "NOTE"),
        5: ("Незначительное", False, "NOTE"), 6: (None, False, "COMPARISON_IMPOSSIBLE"), 7: ("Существенное — требует утверждения", False, "ORDER"), 8: ("иное", False, None),
    }


SIDE = "struct<value:double,source:string,layer_conflict:array<double>,doubtful:array<string>>"


def test_recognized_review(spark):
    ocr, layer = (lambda v, c=None, d=None: (v, "RECOGNIZED", c, d)), (lambda v: (v, "LAYER", None, None))
    rows = [
        (1, "VIOLATION_PRESENT", ocr(1.0), layer(2.0), None, None), (2, "NO_VIOLATION", ocr(1.0), layer(1.0), None, None), (3, "NO_VIOLATION", ocr(1.0, [3.0]), ocr(2.0), layer(1.0), None),
        (4, "NO_VIOLATION", layer(1.0), layer(2.0), None, None), (5, "NO_VIOLATION", (1.0, "LAYER", None, ["7"]), None, None, None), (6, "NO_VIOLATION", ocr(1.0), layer(2.0), None, True), (7, "NO_VIOLATION", ocr(None), layer(2.0), None, None),
    ]
    f = spark.createDataFrame(rows, f"i int, label string, pd {SIDE}, rd {SIDE}, built {SIDE}, values_are_set boolean")
    got = {r.i: (r.machine, r.ask, r.needs_expert) for r in J.recognized_review(f).collect()}
    assert got == {
        1: (["pd"], ["VIOLATION_ON_READING", "READING_DIFFERS:pd"], True), 2: (["pd"], [], False), 3: (["pd", "rd"], ["LAYER_CONFLICT:pd", "READING_DIFFERS:rd"], True), 4: ([], [], False),
        5: ([], ["DOUBTFUL:pd"], True), 6: (["pd"], [], False), 7: (["pd"], ["READING_DIFFERS:pd"], True),
    }


FULL = "i int, parameter_code string, label string, result string, criticality string, finding_status string, hypothesis string, notes struct<up:array<string>,medium:array<string>,low:array<string>>"


def test_hypotheses(spark):
    bad, no, open_ = "VIOLATION_PRESENT", "NO_VIOLATION", "COMPARISON_IMPOSSIBLE"
    rows = [(1, "A", bad, None, None, None, None, None), (2, "B", bad, None, None, None, None, (["x"], None, [])), (3, "B", no, None, None, None, None, None), (4, "C", bad, None, None, None, None, None), (5, "A", bad, None, None, "SUSPICION", "OLD", None), (6, "C", open_, None, None, None, None, None)]
    f = spark.createDataFrame(rows, FULL)
    t = J.threshold_confidence(f.withColumn("threshold", F.when(F.col("i") == 2, "PROJECT")))
    assert {r.i: (r.finding_status, r.notes.up, r.notes.medium) for r in t.collect() if r.i < 4} == {1: ("SUSPICION", ["OWN_TRIGGER"], ["READ_FROM_DRAWING"]), 2: ("SUSPICION", ["x"], ["PROJECT_THRESHOLD_ONLY", "READ_FROM_DRAWING"]), 3: (None, [], ["READ_FROM_DRAWING"])}
    rules = spark.createDataFrame([("A", True, None, "ALWAYS"), ("B", False, [r"не\s+для\s+МГН", "переносн"], "JUSTIFIED")], "parameter_code string, always boolean, patterns array<string>, reason string")
    snippets = spark.createDataFrame([(2, "путь НЕ для  мгн"), (2, None), (3, "переносной"), (4, "переносной")], "i int, snippet string")
    r = {x.i: (x.finding_status, x.hypothesis, x.notes and x.notes.low) for x in J.rule_hypothesis(f, snippets, rules, ["i"]).collect()}
    assert r == {1: ("SUSPICION", "ALWAYS", None), 2: ("SUSPICION", "JUSTIFIED", ["BESIDE:НЕ для  мгн"]), 3: (None, None, None), 4: (None, None, None), 5: ("SUSPICION", "OLD", None), 6: (None, None, None)}
    d = J.drawing_hypothesis(f.withColumns({"undecided": F.col("i") == 6, "from_model": F.when(F.col("i") == 1, False), "violation_result": F.lit(None).cast("string"), "rule_criticality": F.lit("важное")}))
    got = {x.i: (x.label, x.hypothesis, x.result, x.criticality, x.notes.medium, x.notes.low) for x in d.collect()}
    assert got[1] == (bad, "DRAWING_TEXT", None, None, ["MARK_ON_SHEET"], []) and got[3][:2] == (no, None)
    assert got[6] == (bad, "DRAWING", "VALUE_DECREASE", "важное", ["READ_BY_MODEL"], ["WHICH_ELEMENT_UNKNOWN"])
    off, shown = J.provisional(f)
    assert off.where("needs_expert AND NOT for_submission AND finding_status = 'SUSPICION'").count() == 6 and shown.count() == 4


def test_known_values(spark):
    pages = spark.createDataFrame([(1, 7, "План осей: 6000 и 7200 и 12 3,400"), (1, 7, "прочее 9000"), (1, 8, "план ОСЕЙ 6600"), (1, 7, None), (2, 7, "план осей 6300")], "o int, file_id int, text string")
    cands = spark.createDataFrame([(1, "K", 7), (1, "K", 7), (1, "M", 8), (2, "K", None)], "o int, parameter_code string, file_id int")
    rules = spark.createDataFrame([("K", r"план\s+осей", 1000.0, 7000.0), ("M", "план", None, None)], "parameter_code string, sheet_text string, low double, high double")
    assert {(r.o, r.parameter_code): r["values"] for r in J.known_values(pages, cands, rules, ["o"]).collect()} == {(1, "K"): [6000], (1, "M"): [6600]}

"""Acts as XML, and working sheets for design sheets."""

from tristage.operators import matching
from tristage.sources import acts

ACT = """<?xml version="1.0" encoding="UTF-8"?><!-- by hand --><ns2:aosr xmlns:ns2="urn:x" xmlns="urn:y" ns2:v="1"><uuid>u</uuid><actInfo><documentInfo><number> 12/К </number><date>2026-02-01</date><name>Акт</name></documentInfo>
<permanentObjectInfo><permanentObjectName>Школа &amp; сад</permanentObjectName></permanentObjectInfo>
<worksList><ns2:worksListItem><workDescription><workName>Бетонирование</workName></workDescription><location><place>оси 1-2</place></location></ns2:worksListItem><worksListItem><workDescription><workName>Армирование</workName></workDescription></worksListItem></worksList>
<deep><er><workDocumentationSectionsListItem><workDocumentationSectionCode>КЖ1</workDocumentationSectionCode><workDocumentationSectionName>Стены</workDocumentationSectionName><sheets><sheetNumber>4</sheetNumber><sheetNumber> </sheetNumber><sheetNumber>5</sheetNumber></sheets></workDocumentationSectionsListItem></er></deep>
<shortWorkDocumentationSectionsListItem><number>КЖ1</number><name>Стены</name></shortWorkDocumentationSectionsListItem><shortWorkDocumentationSectionsListItem><number>КЖ2</number><name>Плиты</name></shortWorkDocumentationSectionsListItem>
<usedMaterialsListItem><name>Бетон B25</name><untypedQualityApproveDocumentsListItem><name>Паспорт</name><number>7</number><date>2026-01-01</date></untypedQualityApproveDocumentsListItem></usedMaterialsListItem><usedMaterialsListItem><name>Арматура</name></usedMaterialsListItem>
<technicalRegulationDetailsListItem><number>СП 70</number><name>Конструкции</name></technicalRegulationDetailsListItem><worksDate><beginDate>2026-01-10</beginDate><endDate>2026-01-20</endDate></worksDate>
<workExecutorRepresentative><representative><lastName>Иванов</lastName><firstName>И.</firstName><position>прораб</position></representative></workExecutorRepresentative></actInfo></ns2:aosr>"""
SCHEME = "<asBuiltSchemaDoc><docCode>ИС-3</docCode><docDate>2026-03-01</docDate><docName>Схема</docName></asBuiltSchemaDoc>"


def test_acts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_text(ACT, encoding="utf-8")
    (tmp_path / "sub" / "b.XML").write_text("﻿" + SCHEME, encoding="utf-8")
    (tmp_path / "c.xml").write_text("<aosr><actInfo><number>1</number>", encoding="utf-8")
    (tmp_path / "d.xml").write_text(" ", encoding="utf-8")
    (tmp_path / "e.xml").write_text("<other><x>1</x></other>", encoding="utf-8")
    (tmp_path / "f.txt").write_text(SCHEME, encoding="utf-8")
    found, bad = acts.parse(acts.scan(spark, f"file://{tmp_path}"))
    rows = {r.relative_path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert set(rows) == {"a.xml", "b.XML"} and {r.relative_path.rsplit("/", 1)[1] for r in bad.collect()} == {"c.xml", "d.xml"}
    a, b = rows["a.xml"], rows["b.XML"]
    assert (a.doc_kind, a.act_number, a.act_date, a.object_name, a.work_begin, a.work_end) == ("AOSR", "12/К", "2026-02-01", "Школа & сад", "2026-01-10", "2026-01-20")
    assert [tuple(w) for w in a.works] == [("Бетонирование", "оси 1-2"), ("Армирование", None)]
    assert [(s.code, s.name, s.sheets) for s in a.sections] == [("КЖ1", "Стены", ["4", "5"]), ("КЖ2", "Плиты", [])]
    assert [(m.name, [tuple(d) for d in m.quality_documents]) for m in a.materials] == [("Бетон B25", [("Паспорт", "7", "2026-01-01")]), ("Арматура", [])]
    assert [tuple(r) for r in a.regulations] == [("СП 70", "Конструкции")] and tuple(a.executor) == ("Иванов И.", "прораб")
    assert (b.doc_kind, b.act_number, b.act_date, b.works, b.sections, b.executor) == ("ASBUILTSCHEMADOC", "ИС-3", "2026-03-01", [], [], None)
    assert sorted((r.code, r.sheet) for r in acts.sheets(found).collect()) == [("КЖ1", "4"), ("КЖ1", "5")]


SHEET = "o int, sheet string, discipline string, floors array<string>, roots array<string>, rooms array<string>, diagram boolean"


def test_sheets(spark):
    pd = [("p1", "ОВ", ["1", "2"], ["В2"], ["140"], False), ("p2", "ВК", ["1"], [], [], False), ("p3", "ОВ", ["9"], [], [], False), ("p4", "ОВ", [], ["К7"], ["002"], False)]
    rd = [("r1", "ОВ", ["1"], ["В2", "П1"], ["140", "142"], False), ("r2", "ОВ", ["2"], ["В2"], [], True), ("r3", "ОВ", ["1"], ["В9"], ["140"], True), ("r4", "АР", ["1"], ["В2"], [], False), ("r5", "ОВ", [], ["В2"], [], True)]
    p, r = (spark.createDataFrame([(1, *x) for x in s], SHEET) for s in (pd, rd))
    m = matching.match(p, r, ["o"])
    got = {(x.sheet, x.status, x.floor, x.rd) for x in m.collect()}
    assert {x for x in got if x[0] == "p1"} == {("p1", "MATCHED", "1", "r1"), ("p1", "MATCHED", "1", "r5"), ("p1", "MATCHED", "2", "r2"), ("p1", "MATCHED", "2", "r5")}
    assert {x for x in got if x[0] == "p2"} == {("p2", "RD_MISSING", None, None)} and {x for x in got if x[0] == "p3"} == {("p3", "MATCHED", "9", "r5")}
    assert {x for x in got if x[0] == "p4"} == {("p4", "MATCHED", "1", x) for x in ("r1", "r3", "r5")}
    none = matching.match(p, r.where("sheet IN ('r1', 'r2')"), ["o"])
    assert {(x.status, x.floor) for x in none.where("sheet = 'p3'").collect()} == {("NO_CANDIDATES", None)}
    rooms = spark.createDataFrame([(1, "p1", "140", ["В2.7", "П1"]), (1, "p1", "257", ["В5"]), (1, "p1", "бн", ["В1"]), (1, "p2", "140", ["В1"]), (1, "p4", "002", [])], "o int, sheet string, room string, marks array<string>")
    picked = matching.room_sheet(rooms.select("o", "sheet", "room"), m, p, r, ["o"])
    assert {(x.sheet, x.room): (x.rd, x.how) for x in picked.collect()} == {("p1", "140"): ("r1", "CONTAINS"), ("p1", "257"): ("r2", "FLOOR"), ("p1", "бн"): ("r1", "ANY"), ("p2", "140"): (None, None), ("p4", "002"): ("r1", "ANY")}
    held = spark.createDataFrame([(1, "r1", "140", ["В2.1"])], "o int, rd string, room string, rd_marks array<string>")
    out = {(x.sheet, x.room): (x.status, x.reason, x.missing) for x in matching.verify(rooms, picked, held, ["o"]).collect()}
    assert out == {("p1", "140"): ("VIOLATION", "SYSTEM_NOT_ON_RD_PLAN", ["П1"]), ("p1", "257"): ("VIOLATION", "ROOM_MISSING_ON_RD_PLAN", ["В5"]), ("p1", "бн"): ("VIOLATION", "ROOM_MISSING_ON_RD_PLAN", ["В1"]), ("p2", "140"): ("COMPARISON_NOT_POSSIBLE", "RD_SHEET_NOT_FOUND", []), ("p4", "002"): ("OK", None, [])}


def test_floors(spark):
    cases = [("План 3-го этажа", None, ["3"]), ("Схема с 2 по 4 этаж", [], ["2", "3", "4"]), ("Подвал на отм. -3.000 и кровля", [], ["0", "ROOF"]), ("План", ["101", "102", "103", "104", "201"], ["1"]), ("План", ["101", "102", "201", "202", "301"], ["1", "2"]), ("План", ["002", "314"], ["0", "3"]), (None, ["без номера"], []), ("этаж 99", [], [])]
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(cases)], "i int, t string, r array<string>")
    got = {x.i: x.f for x in df.select("i", matching.floors(df.t, df.r).alias("f")).collect()}
    # «по 4 этаж» alone names the fourth floor too
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}

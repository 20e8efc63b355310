"""Queries of the binding of values to elements, in the manner of catalogue.py.

The tables hold no construction texts, so every part is a page with one of these passages, with numbers of the part in
it. What each passage must give is written beside it by hand; the SQL twin unfolds these literals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions.text import flat
from tristage.operators import elements, labels
from tristage.plans.catalogue import ORACLE_SQL, QUERIES, pages

_V, _P = "Вертикальные конструкции", "Плиты перекрытия"
_U, _A = "подземной части", "надземной части"
#: Text with {c} for a class, path, as built, and (location, binding) of that class.
BINDINGS = [
    ("Фундаментная плита из бетона класса В{c} W8.", "", False, [("Фундаментная плита", "CLAUSE")]),
    ("Стены подземной части из бетона класса В{c}.", "", False, [(f"{_V} {_U}", "CLAUSE")]),
    ("Колонны надземной части — бетон класса В{c}. Подготовка из бетона В7,5.", "", False, [(f"{_V} {_A}", "CLAUSE")]),
    ("Пилоны, колонны и стены -3 по +1 из бетона класса В{c}.", "", False, [(f"{_V} {_U}", "CLAUSE")]),
    ("Стены и плиты перекрытия из бетона класса В{c}.", "", False, [(f"{_V} {_U}", "CLAUSE"), (f"{_V} {_A}", "CLAUSE"), (f"{_P} {_U}", "CLAUSE"), (f"{_P} {_A}", "CLAUSE")]),
    ("Несущие конструкции кроме фундаментной плиты выполнены из бетона класса В{c}.", "", False, []),
    ("Бетонная подготовка из бетона класса В{c} под фундаментную плиту.", "", False, []),
    ("Плита перекрытия над -1 подземным этажом. Толщина плиты перекрытия: 250, 900 мм. Характеристики бетона: класс В{c} W6.", "", False, [(f"{_P} {_U}", "CLAUSE")]),
    ("Ведомость расхода бетона Марка конструкции B{c} F150 W8 Ж/б стены на отм. -13.750", "", False, [(f"{_V} {_U}", "PAGE")]),
    ("Применение бетона классом по прочности выше чем В{c} для стен надземной части допускается.", "", False, []),
    ("Бетон класса В{c} W6.", "РД/Подземная автостоянка/КЖ2.1 Вертикальные конструкции -1 этажа.pdf", False, [(f"{_V} {_U}", "PATH")]),
    ("Лестничные марши показаны на листе. Применять класс бетона В{c} W4.", "", False, [("Лестницы", "SHEET")]),
    ("Подпорная стена консольного типа. Выравнивающая стенка – монолитная толщиной 100мм из бетона класса В{c}.", "", False, []),
    ("Плитный ростверк башенного крана из бетона класса В{c}.", "", False, []),
    ("Бетонирование плиты перекрытия бетон класса В{c} на отм.+52.400", "", True, [(f"{_P} {_A}", "PAGE")]),
    ("Бетонирование плиты перекрытия бетон класса В{c} по захваткам и ярусам этого листа на отм.+52.400", "", True, [(f"{_P} {_A}", "CLAUSE")]),
    ("Плиты перекрытия подвала и стены подвала – бетон класса В{c} W6.", "", False, [(f"{_V} {_U}", "CLAUSE")]),
    ("Стена в грунте: бетон класса В{c} W10, распределительный ростверк: бетон класса В{c}.", "", False, [("Стена в грунте", "CLAUSE"), ("Распределительный ростверк", "CLAUSE")]),
    ("Стены из бетона класса В{c}.", "РД/Секция 2/КЖ5 Стены 2-24 этажей.pdf", False, [(f"{_V} {_A}", "CLAUSE")]),
    ("Воздуховод из стали кл. В {c}x100 в стенах подвала.", "", False, []),
]
_CLASSES = [20, 25, 30, 35, 40, 60]
#: Text, statements of plates (thicknesses of each).
PLATES = [
    ("Фундаментная плита толщиной 900 мм (низ на отм. -4,400, абс. отм. 141,80).", [[900]]),
    ("Толщина фундаментной плиты 800, 1000 мм, под колоннами 1500 мм.", [[800, 1000]]),
    ("Фундаментная плита приямок, h=600 мм", []),
    ("Ростверк представляет собой монолитную железобетонную плиту толщиной 500 мм с шагом 200 мм.", [[500]]),
    ("распределительный ростверк – плита толщиной 700 мм", []),
    ("Фундаментная плита толщиной 120 мм", []),
    ("Плита фундаментная; фундаментная плита h = 1200 мм и фундаментная плита t=1100 мм", [[1200], [1100]]),
]
#: Text, thicknesses with the part of the building.
MARKS = [
    ("t=200 -2,100 t=180 +3,300 t=200 -2,150 Схема расположения плиты перекрытия в осях 1/7", [(200, _U), (180, _A)]),
    ("t=200 -2,100 Схема расположения колонн", []),
    ("Стена монолитная t=250 +6,110 h=220 0,000 t=90 -1,000 схема армирования плиты покрытия", []),
    ("h=300 –0,150 схема плит перекрытий", [(300, _U)]),
]
#: Text, value, number of columns and how the column was chosen for the label "площадь озеленения" or "площадь застройки".
COLUMNS = [
    ("Показатель | до реконструкции | по проекту Площадь застройки, м2 1200,5 1350,0", [(1350.0, 2, "header")]),
    ("Показатель ГПЗУ Площадь застройки 5000 4800", [(5000.0, 2, "header")]),
    ("Площадь участка м2 6052 100 Площадь озеленения м2 2669 44,10", [(2669.0, 2, "share")]),
    ("Площадь застройки 10 20", [(20.0, 2, "rule")]),
    ("Площадь застройки - 159,95 м2", [(159.95, 1, "single")]),
    ("Общая площадь работ м2 6052 96,28 Площадь покрытий м2 2669 44,10 Площадь озеленения : м2 1826,6 30,18", [(1826.6, 2, "share")]),
    ("А м2 331,80 1,52 Б м2 2333,33 10,68 Площадь озеленения м2 7173,7 32,83 В м2 4194,02 19,20", [(7173.7, 2, "share")]),
    ("Нормативное | Принято м2 % Площадь застройки 1500 1400 35", [(1400.0, 3, "header")]),
    ("Площадь участка в границах ГПЗУ га 1,1417 Площадь застройки 7000 8000", [(8000.0, 2, "rule")]),
    ("Площадь застройки 1 2 3 4 5 6", []),
    ("Площадь озеленения не указана", []),
]
#: Text, part of the building.
ZONES = [
    ("стены -3 по +1", _U), ("плита -2го до кровли", "по всей высоте"), ("на отм. -5.250", _U), ("с отм. +1.620", _A), ("Наружные стены 2-24 этажей", _A),
    ("перекрытие над -1 этажом", _U), ("3 этаж над подвалом", _A), ("подвал и кровля", _U), ("техподполье", _U), ("просто стена", None), ("с 2 по 9 этаж", _A), ("-3 по +5", "по всей высоте"),
]
#: Flat text, what is left of it without the foundations of cranes.
CRANES = [
    ("Введение. Фундаменты под башенный кран Фундамент под кран свайный. Ростверк толщиной 1200 мм. 5. Стены здания.", "Введение. 5. Стены здания."),
    ("1. Настоящий раздел содержит рабочие чертежи плитного ростверка башенного крана. 2. Далее", "1. Настоящий раздел содержит рабочие чертежи плитного ростверка башенного крана. 2. Далее"),
    ("Фундамент башенного крана – свайный, плита 900 мм, колонны здания из бетона.", "колонны здания из бетона."),
    ("Без него.", "Без него."),
]


def _lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _pick(n: int) -> str:
    return f"p_partkey % {n}"


def _texts(spark, sf_dir, cases, text=lambda c: c[0]):
    """key, case and text of each part."""
    k = F.col("p_partkey")
    chosen = F.element_at(F.array(*(F.lit(text(c)) for c in cases)), (k % len(cases) + 1).cast("int"))
    return pages(spark, sf_dir, "part", "p_partkey").select(k.alias("key"), (k % len(cases)).alias("case"), F.col("p_size"), chosen.alias("text"))


def _twin(cases, rows, columns: str) -> str:
    """Parts with the rows of their case; rows(case) gives SQL tuples."""
    values = [f"({i}, {v})" for i, c in enumerate(cases) for v in rows(c)]
    return f"WITH e (c, {columns}) AS (VALUES {', '.join(values)}) SELECT p_partkey AS key, {columns} FROM part JOIN e ON {_pick(len(cases))} = c"


def element_classes(spark, sf_dir):
    p = _texts(spark, sf_dir, BINDINGS)
    at = (F.col("case") + 1).cast("int")
    number = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("p_size") % len(_CLASSES) + 1).cast("int")).cast("string")
    pages = p.select("key", F.replace("text", F.lit("{c}"), number).alias("text"), F.element_at(F.array(*(F.lit(b[1]) for b in BINDINGS)), at).alias("path"), F.element_at(F.array(*(F.lit(b[2]) for b in BINDINGS)), at).alias("as_built"))
    return elements.concrete_classes(pages, ["key"]).select("key", "location", "binding", "value", "raw")


def plate_thicknesses(spark, sf_dir):
    p = _texts(spark, sf_dir, PLATES).select("key", F.explode(elements.plate_thickness(F.col("text"))).alias("v"))
    return p.select("key", F.array_join(F.col("v").cast("array<string>"), ",").alias("mm"))


def slab_marks(spark, sf_dir):
    p = _texts(spark, sf_dir, MARKS).select("key", F.explode(elements.slab_sheet_marks(F.col("text"))).alias("v"))
    return p.select("key", "v.value", "v.zone")


def picked_columns(spark, sf_dir):
    pages = _texts(spark, sf_dir, COLUMNS).select("key", "text")
    return labels.find_values(pages, "площадь (?:озеленения|застройки)").select("key", "value", "columns", "choice")


def building_parts(spark, sf_dir):
    return _texts(spark, sf_dir, ZONES).select("key", elements.zone_of(F.col("text")).alias("zone"))


def crane_free_text(spark, sf_dir):
    return _texts(spark, sf_dir, CRANES).select("key", elements.without_crane_sections(flat(F.col("text"))).alias("body"))


QUERIES |= {f.__name__: f for f in (element_classes, plate_thicknesses, slab_marks, building_parts, crane_free_text, picked_columns)}
_VALUE = f"[{', '.join(map(str, _CLASSES))}][p_size % {len(_CLASSES)} + 1]"
ORACLE_SQL |= {
    "element_classes": _twin(BINDINGS, lambda c: [f"{_lit(loc)}, {_lit(how)}" for loc, how in c[3]], "location, binding").replace("FROM part", f", CAST({_VALUE} AS DOUBLE) AS value, 'B' || {_VALUE} AS raw FROM part"),
    "plate_thicknesses": _twin(PLATES, lambda c: [_lit(",".join(map(str, v))) for v in c[1]], "mm"),
    "slab_marks": _twin(MARKS, lambda c: [f"{v}, {_lit(z)}" for v, z in c[1]], "value, zone"),
    "picked_columns": _twin(COLUMNS, lambda c: [f"{v}::DOUBLE, {n}, {_lit(how)}" for v, n, how in c[1]], "value, columns, choice"),
    "building_parts": _twin(ZONES, lambda c: [_lit(c[1])], "zone"),
    "crane_free_text": _twin(CRANES, lambda c: [_lit(c[1])], "body"),
}

"""Queries of the extractors, one for each kind of rule, over page texts that Spark and DuckDB compose alike.

The tables at hand have no construction texts, so each kind has phrasings, among them ones that must not match, filled
with numbers of `part` (k its key, a its size). The SQL twin reads them with RE2, which has no look-around: its patterns
leave that out, and the phrasings give it no room to differ.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tristage.operators.extract import Rule, extract
from tristage.operators.rules import RULES
from tristage.plans.catalogue import ORACLE_SQL, QUERIES, pages

TEXTS = {
    "soue_type": ["'предусмотрена СОУЭ  ' || (a % 5 + 1) || '-го типа в здании'", "'здание оснащается СОУЭ - ' || (a % 5 + 1) || ' типа'", "'при отсутствии на объекте СОУЭ 3-го типа и выше'", "'принят ' || (a % 5 + 1) || '-го типа системы СОУЭ, второй абзац'", "'СОУЭ (оповещение) не ниже 4-го типа; далее текст СОУЭ ' || (a % 7) || ' типа'"],
    "riser_diameters": ["'Ст В1-' || a || ' ⌀' || (20 + a) || 'х3 рядом Ст.Т3 - ' || (a % 9) || ' Ø' || (15 + a) || 'x2,3'", "'Ст К1-' || a || ' ⌀50'", "'В1-⌀40х3.5 магистраль'", "'Ст Т4-2  ∅' || (10 + a)"],
    "sewer_outlets": ["'Выпуск К1-' || (a % 20) || ' Ø' || (50 + a)", "'Выпуски | К 2 ∅110 и Выпуск К2.1 - 3 ⌀ 160'", "'Выпуск К3 Ø100'", "'выпуск К1 Ø100'"],
    "mgn_toilet_area": ["'помещение ' || a || ' Универсальная кабина МГН ' || a || ',' || (10 + k % 90) || ' конец'", "'1.2-' || a || ' Санузел для инвалидов 4.05 м'", "a || ' Уборная 3,20'", "'этаж 5 Доступная кабина уборной 5,' || (k % 10) || ' 17 С/у МГН 6,1'"],
    "fire_jets": ["a || ' струи по ' || (a % 9) || ',' || (k % 10) || ' л/с на этаж'", "'следует принимать 2 струи по 2,5 л/с'", "'2 пожарные струи с расходом воды не менее 5,2 л/сек'", "'0 струй по 2,5 л/с'", "'1 струя 2.6 л/с, 4 струи, 5 л/с'"],
    "outdoor_fire_water": ["'расход воды на наружное пожаротушение здания ' || a || ' л/с'", "'наружное пожаротушение ' || a || ' л/с от сети'", "'кольцевая сеть, наружное пожаротушение 25 л/с'", "'наружное противопожаротушение 250 л/с'", "'системы наружного пожаротушения зданий составляет ' || (a * 8) || ' л/сек'"],
    "hydrants": ["'от двух существующих пожарных гидрантов'", "'с помощью ' || (a % 12) || ' гидрантов'", "'от трёх проектируемых гидрантов, от пяти гидрантов'", "'у гидранта ' || a"],
    "light_sources": ["'светильники со светодиодными лампами, ' || a || ' шт.'", "'Замена: люминесцентные лампы светильников'", "'освещение выполнено люминесцентными лампами'", "'лампы накаливания в светильниках; отходы'", "'галогенные лампы прожектора и светодиодные модули, световые указатели'", "'светодиодный экран'", "'светильники с лампами ДРЛ и ДНаТ, ' || a", "'лампы ДРЛ; отходы'"],
    "resource_meters": ["'счётчик активной электрической энергии и водомерный узел ' || a", "'теплосчётчик в узле учёта тепловой энергии'", "'счетчик крыльчатый холодной воды Меркурий 230'", "'учёт рабочего времени'"],
    "smoke_fans": ["'ДУ' || (a % 20) || ' (L=' || (1000 + a * 10) || ' м³/ч, Pc=' || (100 + a) || ' Па)'", "'ВД1,ВД2.1 ( L = 25000 м3/ч Pc=450 Па ) и ПД3(1) (L=9000 м3/ч, Pc=90 Па)'", "'ДУ7 (L=12 м3/ч, Pc=90 Па)'"],
    "window_schedule": ["'ОК-' || (a % 30) || ' ' || (900 + a) || 'х1500 ' || (a % 12 + 1) || ' шт'", "'ОКБ 2.1 1500 x 1800 (h) 4; В-3 700*2100 12 конец'", "'окно 1500х1800'"],
    "crane_zones": ["'башенный Potain MCT-' || (100 + a) || ' на рельсах'", "'автокран Liebherr 250 работает'", "'кран КБ-403 и Terex ' || (a + 100)", "'опасная зона крана составляет R = ' || a || ',5 м'", "'опасная зона равна: 400 м'", "'принимаем величину опасной зоны: ' || a || ' м'"],
    "pit_edge_limits": ["'нагрузка на бровку котлована не более ' || (a * 3) || ' кПа'", "'нагрузка у бровки 2,5 т/м2'", "'складирование материалов не допускается в зоне ' || (a % 40) || ',5 м от бровки'", "'проезд не допускается в зоне 1 метр от бровки'"],
    "collapse_zone": ["'зона развала составляет ' || (a * 3) || ' м'", "'зона возможного развала здания при сносе равна 12,5 м.'", "'высота зоны развала 4 м'", "'зоны отдыха 5 м'"],
    "demolition_methods": ["'снос механизированным способом, ' || a || ' дней'", "'ручная разборка и поэлементный демонтаж'", "'методом обрушения запрещено; взрывной способ'", "'гидромолот на экскаваторе'", "'без сноса'"],
    "build_technology": ["'шпунтовое ограждение и стена в грунте'", "'буросекущие сваи, распорная система ' || a", "'способ top-down, монолитный железобетон'", "'сборного ж/б нет'", "'кирпич'"],
    "material_takeoff": ["'объём бетона на устройство обвязочной балки - ' || a || ',25 м3'", "'Объем бетона на устройство плиты: 0 м3'", "'объём бетона на устройство свай – 12 куб'", "'объём грунта 5 м3'"],
    "slope_range": ["'уклон ' || a || '‰ ' || (10 + a) || ',50 по плану'", "'5,5 ‰ 12.25; 300‰ 10,00'", "'уклон 5%'"],
    "norm_references": ["'по ГОСТ ' || (1000 + a) || '-20' || (10 + k % 20) || ' и СП 70.13330.2012'", "'СНиП 12-03-2001; ГОСТ Р 21.101-2020, СанПиН 2.1.3684-21'", "'согласно ТР ТС 004/2011 и СТО НОСТРОЙ 2.7'", "'лист ' || a"],
    "concrete_classes": ["'бетон В' || a || ' и B 25 W6'", "'класс бетона'", "'В150, В2, B60'", "'марка М200'"],
}

_AROUND = re.compile(r"\(\?<?!(?:\[[^\]]*\]|\([^()]*\)|[^()])*\)")


def _re2(pattern: str) -> str:
    return _AROUND.sub("", pattern).replace("(?iu)", "(?i)").replace("'", "''")


def _twin(rule: Rule, body: str) -> str:
    """SQL of one rule over t (k, flat, low)."""
    p, read = _re2(rule.pattern), "low" if rule.fold else "flat"
    left = f"substring({read}, CAST(greatest(x.start - {rule.window}, 0) AS INTEGER) + 1, CAST(least(x.start, {rule.window}) AS INTEGER))"
    right = f"substring({read}, CAST(x.e AS INTEGER) + 1, {rule.after})"
    tests = ["true"]
    if rule.veto:
        tests.append(f"NOT regexp_matches({left}{' || x.raw' if rule.inside else ''}, '{_re2(rule.veto)}')")
    if rule.veto_after:
        tests.append(f"NOT regexp_matches({right}, '{_re2(rule.veto_after)}')")
    if rule.need:
        tests.append(f"regexp_matches({left} || ' ' || {right}, '{_re2(rule.need)}')")
    groups = "".join(f", '{g}': coalesce(regexp_extract_all({read}, '{p}', {i + 1})[i], '')" for i, g in enumerate(rule.groups))
    start = f"coalesce(list_sum(list_transform(string_split_regex({read}, '{p}')[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(regexp_extract_all({read}, '{p}')[1:i - 1], lambda y: length(y))), 0)"
    found = f"list_transform(range(1, len(regexp_extract_all({read}, '{p}')) + 1), lambda i: {{'raw': regexp_extract_all({read}, '{p}')[i], 'start': {start}{groups}}})"
    placed = f"SELECT k, flat, low, unnest(list_transform({found}, lambda x: struct_insert(x, e := x.start + length(x.raw)))) AS x FROM {body}"
    cut = "trim(substring(flat, CAST(greatest(x.start - 30, 0) AS INTEGER) + 1, CAST(x.e + 70 - greatest(x.start - 30, 0) AS INTEGER)))"
    return f"SELECT k, '{rule.kind}' AS kind, CAST({rule.key} AS VARCHAR) AS key, CAST({rule.value} AS VARCHAR) AS value, trim(x.raw) AS raw, CAST(x.start AS INTEGER) AS start, {cut} AS snippet FROM ({placed}) WHERE {' AND '.join(tests)}"


def _texts(kind: str) -> str:
    """SQL of the page text, in what Spark and DuckDB have in common."""
    some = TEXTS[kind]
    return f"CASE k % {len(some) + 1} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(some)) + " ELSE NULL END"


def _sql(kind: str) -> str:
    flat = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g'))"
    parts = " UNION ALL ".join(_twin(r, "t") for r in RULES[kind])
    return f"WITH p AS (SELECT p_partkey AS k, CAST(p_size AS INTEGER) AS a FROM part), s AS (SELECT k, {_texts(kind)} AS text FROM p), t AS (SELECT k, {flat} AS flat, lower({flat}) AS low FROM s) SELECT * FROM ({parts}) WHERE value IS NOT NULL"


def _query(kind: str):
    def run(spark, sf_dir):
        parts = pages(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("int").alias("a"))
        return extract(parts.select("k", F.expr(_texts(kind)).alias("text")), RULES[kind])

    run.__name__ = f"extract_{kind}"
    return run


for _kind in RULES:
    QUERIES[f"extract_{_kind}"] = _query(_kind)
    ORACLE_SQL[f"extract_{_kind}"] = _sql(_kind)

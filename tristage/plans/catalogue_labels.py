"""Queries of values beside labels and of schedules, over texts that both engines compose alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions import language as L
from tristage.operators import changes, extract, labels
from tristage.plans.catalogue import query
from tristage.plans.catalogue_review import _case, _from, _parts

_LABEL = _case("k", ["'Площадь озеленения м2 ' || (3000 + a) || ',30 ' || (2000 + a) || ',60 прочее'", "'Общая площадь озеленения: ' || a || ' 200,5 м2 и текст'", "'Площадь озеленения кровли м2 55'", "'площадь озеленения, га ' || a || ',5'", "'Площадь озеленения по проекту не задана'", "'Площадь озеленения 1 2 3 4 5 6'", "'Площадь озеленения ' || a || ' мм'"])


@query(f"""WITH s AS (SELECT k, a FROM {_from(a='a')}) SELECT k, CASE k % 7 WHEN 0 THEN 2000 + a + 0.6 WHEN 1 THEN CAST(CAST(a AS VARCHAR) || '200.5' AS DOUBLE) WHEN 3 THEN (a + 0.5) * 10000 END AS value, CASE k % 7 WHEN 0 THEN CAST(2000 + a AS VARCHAR) || ',60' WHEN 1 THEN CAST(a AS VARCHAR) || ' 200,5' WHEN 3 THEN CAST(a AS VARCHAR) || ',5' END AS raw,
 CASE k % 7 WHEN 0 THEN 2 ELSE 1 END AS columns, CASE k % 7 WHEN 0 THEN 'rule' ELSE 'single' END AS choice, CASE k % 7 WHEN 0 THEN 'Площадь озеленения' WHEN 1 THEN 'Общая площадь озеленения' ELSE 'площадь озеленения' END AS label FROM s WHERE k % 7 IN (0, 1, 3)""")
def label_values(spark, sf_dir):
    out = labels.find_values(_parts(spark, sf_dir, text=_LABEL), "общая площадь озеленения|площадь озеленения", exclude="кровли", unit="м²")
    return out.select("k", "value", "raw", "columns", "choice", "label")


_SCHEDULE = _case("k", ["'Ведомость проездов: Проезды с асфальтом I кв.м. ' || a || ',5 Тротуары с плиткой III кв.м. 2048,0 Проезды на кровле м2 86'", "'Ведомость проездов Тротуары м2 10'", "'Проезды кв.м. 5'", "NULL"])


@query(f"SELECT k, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS n, CASE k % 4 WHEN 0 THEN round(a + 0.5 + 86, 2) END AS drives, CASE k % 4 WHEN 0 THEN round(a + 0.5, 2) END AS ground FROM {_from(a='a')}")
def schedule_areas(spark, sf_dir):
    s = _parts(spark, sf_dir, t=_SCHEDULE).withColumn("r", labels.schedule_rows(F.col("t"), "ведомость проездов:?"))
    return s.select("k", F.size("r").alias("n"), labels.schedule_sum(F.col("r"), "проезды").alias("drives"), labels.schedule_sum(F.col("r"), "проезды", "кровл").alias("ground"))


_ITEMS = _case("k", ["'Ведомость МАФ 1 Скамья 5 шт 2 Урна ' || (a + 10) || ' 2.1 крышка 3 Ограждение территории, секция забора, h=2,0м ' || a || ',45'", "'Ведомость МАФ 4 Стол 5 Стул'", "'Ограждение территории без высоты'", "'Ограждение территории h: ' || a || ' м конец'"])


@query(f"SELECT k, CASE k % 4 WHEN 0 THEN 3 END AS positions, CASE k % 4 WHEN 0 THEN 2.0 WHEN 3 THEN CAST(a AS DOUBLE) END AS height, CASE k % 4 WHEN 0 THEN a + 0.45 END AS length, CASE k % 4 WHEN 0 THEN 'ограждение,скамья' WHEN 2 THEN 'ограждение' WHEN 3 THEN 'ограждение' ELSE '' END AS features FROM {_from(a='a')}")
def schedule_items(spark, sf_dir):
    s = _parts(spark, sf_dir, t=_ITEMS)
    item = labels.item_with_height(F.col("t"), "ограждение территории")
    named = L.features(F.col("t"), {"ограждение": "(?iu)ограждени", "скамья": "(?iu)скамь"})
    return s.select("k", labels.schedule_positions(F.col("t"), "ведомость МАФ").alias("positions"), item.height.alias("height"), item.length.alias("length"), F.array_join(named, ",").alias("features"))


_GROUPS = _case("k", ["'1РП1-10 QF1 ВА47 C ' || a || ' А ВВГнг(А)-FRLS 3x2,5 1РП1-11 QF2 ВА47 16 А ВВГнг(А)-LS 5х' || (a % 9 + 1)", "'2РП2.СПЗ-3 без автомата ППГнг(А)-HF 4(1x70)'", "'щит ' || a"])


@query(f"""WITH s AS (SELECT k, a FROM {_from(a='a')})
 SELECT k, '1РП1-10' AS "group", a AS current, 1 AS cables FROM s WHERE k % 3 = 0 UNION ALL SELECT k, '1РП1-11', 16, 1 FROM s WHERE k % 3 = 0 UNION ALL SELECT k, '2РП2.СПЗ-3', NULL, 1 FROM s WHERE k % 3 = 1""")
def switchboard_groups(spark, sf_dir):
    s = _parts(spark, sf_dir, t=_GROUPS)
    group = r"(?<![0-9A-Za-zА-Яа-яЁё_.])[0-9]{1,2}РП[0-9]{1,2}(?:\.(?:[0-9]{1,2}|СПЗ))?-[0-9]{1,3}(?![0-9A-Za-zА-Яа-яЁё_])"
    rows = s.select("k", F.explode(extract.spans(F.coalesce("t", F.lit("")), group, 260)).alias("g"))
    breaker = F.regexp_extract(F.substring("g.span", 1, 180), r"QFD?[0-9]{1,3}\s+[А-ЯA-Z]{2,5}[0-9A-Za-zА-Яа-яЁё_-]*\s+(?:[BCD]\s?)?([0-9]{1,4})\s?А", 1)
    cables = F.regexp_extract_all(F.col("g.span"), F.lit(r"(?:ВВГ|ППГ)[0-9A-Za-zА-Яа-я()_]*(?:-[A-ZА-Я]{2,4})*\s+([0-9]{1,2}\s?\(\s?[0-9]\s?[хx×]\s?[0-9]{1,3}(?:[,.][0-9])?\s?\)|[0-9]{1,2}\s?[хx×]\s?[0-9]{1,3}(?:[,.][0-9])?)"), F.lit(1))
    cores, _ = changes.cable(F.get(cables, 0))
    return rows.select("k", F.col("g.anchor").alias("group"), breaker.try_cast("int").alias("current"), F.when(cores > 0, F.size(cables)).alias("cables"))

"""Queries of layer stacks and of document codes, in the manner of catalogue.py. Where texts are needed, what each must
give is written beside it by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tristage.operators import codes, layers
from tristage.plans.catalogue import query, table
from tristage.plans.catalogue_elements import _lit, _texts, _twin

#: Text of a page, and key|purpose|layers of its types.
PAVEMENTS = [
    ("Введение\nТИП 2 (Конструкция тротуара с проездом)\nАсфальтобетон мелкозернистый\n- 5 см\nЩебень фракции 20-40 - 20 см\nПесок средней крупности 450 мм\nУсловные обозначения\nПесок 10 см", ["2|тротуара с проездом|asphalt:50.0;stone:200.0;sand:450.0"]),
    ("ТИП 1 (Покрытие площадки)\nРезиновая крошка 15 мм\nТротуарная плитка 60 мм/ цементно-песчаная стяжка 30 мм\nУплотнённый грунт\nТИП 2.1 (Конструкция газона)\nРастительный грунт - 20 см", ["1|площадки|rubber:15.0;paving:60.0;screed:30.0", "2.1|газона|soil:200.0"]),
    ("ТИП 3 (Конструкция дорожки)\nгрунт\nУровень грунтовых вод", []),
    ("Кровля без типов", []),
    ("ТИП 4 (Конструкция отмостки)\nПлита (поднять на высоту утеплителя - 200мм)\nГеотекстиль\nплотностью 200\nКамень бортовой\nЩебень 10 см", ["4|отмостки|geotextile:null"]),
]
ROOFS = [
    ("Кровля - тип I (эксплуатируемая)\n1. Техноэласт ЭПП толщ. 4,2 мм\n2. Праймер битумный\n3. Стяжка 50 мм\n- армированная\n4. Утеплитель минераловатный - 200 мм\nСопротивление теплопередаче\n5. Пароизоляция", ["I|эксплуатируемая|waterproofing:4.2;primer:null;screed:50.0;insulation:200.0"]),
    ("Кровля – тип 2\n1. Стяжка 50 мм\n2. Стяжка 30 мм", []),
    ("Кровля - тип III\n1. Плитка 40 мм\n2. Дренажный слой\n3. Пароизоляция - слой техноэласта\nКровля - тип IV\n1. Праймер\n2. Геотекстиль\n3. Пеностекло 100 мм", ["III||paving:40.0;drainage:null;vapor:null", "IV||primer:null;geotextile:null;insulation:100.0"]),
]


def _stacked(spark, sf_dir, cases, profile):
    found = layers.stacks(_texts(spark, sf_dir, cases).select("key", "text").withColumnRenamed("key", "page"), ["page"], profile)
    shown = F.array_join(F.transform("layers", lambda s: F.concat_ws(":", s.kind, F.coalesce(s.mm.cast("string"), F.lit("null")))), ";")
    return found.select(F.col("page").alias("key"), F.concat_ws("|", "key", "purpose", shown).alias("stack"))


@query(_twin(PAVEMENTS, lambda c: map(_lit, c[1]), "stack"))
def pavement_stacks(spark, sf_dir):
    return _stacked(spark, sf_dir, PAVEMENTS, "pavement")


@query(_twin(ROOFS, lambda c: map(_lit, c[1]), "stack"))
def roof_stacks(spark, sf_dir):
    return _stacked(spark, sf_dir, ROOFS, "roof")


_STACKS = """WITH l AS (SELECT l_suppkey AS obj, l_linenumber AS n, l_returnflag AS stage, 'k' || (l_partkey % 9) AS kind, CASE WHEN l_orderkey % 5 > 0 THEN l_quantity END AS mm, l_orderkey AS o, l_partkey AS p FROM lineitem)"""


def _sides(spark, sf_dir):
    """The line items of a supplier and line number with one return flag are a stack, in order of order and part."""
    li = table(spark, sf_dir, "lineitem")
    mm = F.when(F.col("l_orderkey") % 5 > 0, F.col("l_quantity"))
    rows = li.select(F.col("l_suppkey").alias("obj"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("stage"), F.struct("l_orderkey", "l_partkey", mm.alias("mm")).alias("s"))
    listed = rows.groupBy("obj", "n", "stage").agg(F.sort_array(F.collect_list("s")).alias("s"))
    stacks = F.transform("s", lambda x: F.struct(F.concat(F.lit("k"), x.l_partkey % 9).alias("kind"), x.mm.alias("mm"), F.lit("").alias("text")))
    return listed.select("obj", "n", "stage", stacks.alias("layers"))


@query(_STACKS + """, k AS (SELECT obj, n, stage, kind, coalesce(list(mm ORDER BY o, p, mm) FILTER (mm IS NOT NULL), []) AS v FROM l WHERE stage <> 'N' GROUP BY ALL),
 a AS (SELECT * FROM k WHERE stage = 'A'), b AS (SELECT * FROM k WHERE stage = 'R'),
 u AS (SELECT DISTINCT a.obj, a.n FROM a JOIN b USING (obj, n)),
 m AS (SELECT a.obj, a.n, kind, a.v, b.v AS w FROM a JOIN b USING (obj, n, kind) WHERE len(a.v) > 0 AND len(b.v) > 0),
 t AS (SELECT obj, n, kind, unnest(list_filter(list_transform(range(1, len(v) + 1), lambda i: {'x': v[i], 'y': w[i]}), lambda s: s.y < s.x)) AS s FROM m WHERE len(v) = len(w)
  UNION ALL SELECT obj, n, kind, {'x': list_sum(v), 'y': list_sum(w)} FROM m WHERE len(v) <> len(w) AND list_sum(w) < list_sum(v))
 SELECT obj, n, 'THINNER' AS change, kind, s.x AS was, s.y AS became FROM t
 UNION ALL SELECT obj, n, 'REMOVED', kind, NULL, NULL FROM a JOIN u USING (obj, n) WHERE (obj, n, kind) NOT IN (SELECT (obj, n, kind) FROM b)
 UNION ALL SELECT obj, n, 'ADDED', kind, NULL, NULL FROM b JOIN u USING (obj, n) WHERE (obj, n, kind) NOT IN (SELECT (obj, n, kind) FROM a)""")
def layer_changes(spark, sf_dir):
    s = _sides(spark, sf_dir)
    side = lambda f, c: s.where(F.col("stage") == f).select("obj", "n", F.col("layers").alias(c))
    both = side("A", "pd").join(side("R", "rd"), ["obj", "n"])
    return both.select("obj", "n", F.explode(layers.differences(F.col("pd"), F.col("rd"))).alias("c")).select("obj", "n", "c.*")


@query(_STACKS + """, k AS (SELECT obj, n, stage, list_sort(list(DISTINCT kind)) AS k, CASE WHEN n % 3 > 0 THEN 't' || (n % 4) END AS key FROM l GROUP BY obj, n, stage),
 a AS (SELECT obj, n AS pd, k, key FROM k WHERE stage = 'A'), b AS (SELECT obj, n, k, CASE WHEN n % 2 = 0 THEN key END AS key FROM k WHERE stage = 'R'),
 s AS (SELECT obj, b.n, a.pd, len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) AS s FROM b JOIN a USING (obj) WHERE len(list_intersect(a.k, b.k)) > 0),
 x AS (SELECT obj, n, arg_max(pd, (s, pd)) AS best FROM s WHERE s >= 0.6 GROUP BY ALL),
 f AS (SELECT obj, key, min(pd) AS own FROM a WHERE key IS NOT NULL GROUP BY ALL),
 j AS (SELECT b.obj, b.n, b.key, own, best, coalesce(s.s, 0) AS s FROM b LEFT JOIN f ON f.obj = b.obj AND f.key = b.key LEFT JOIN s ON s.obj = b.obj AND s.n = b.n AND s.pd = own LEFT JOIN x ON x.obj = b.obj AND x.n = b.n),
 h AS (SELECT obj, n AS rd, key, CASE WHEN own IS NOT NULL AND s >= 0.5 THEN own ELSE best END AS pd, CASE WHEN own IS NOT NULL AND s >= 0.5 THEN 'KEY' ELSE 'KINDS' END AS how FROM j)
 SELECT h.obj, rd, h.pd, coalesce(h.key, a.key, '—') AS key, how FROM h JOIN a ON a.obj = h.obj AND a.pd = h.pd""")
def paired_stacks(spark, sf_dir):
    key = F.when(F.col("n") % 3 > 0, F.concat(F.lit("t"), F.col("n") % 4))
    s = _sides(spark, sf_dir).withColumns({"key": F.when((F.col("stage") == "A") | (F.col("n") % 2 == 0), key), "purpose": F.lit("")})
    return layers.pair(s.where("stage = 'A'"), s.where("stage = 'R'"), ["obj"], "roof").select("obj", "rd", "pd", "key", "how")


#: Reading, code of the registry, mended code, how many parts changed.
CODES = [
    ("НВС-2025/O3-КЖ2.1", "НВС-2025-03-КЖ2.1", "НВС-2025/03-КЖ2.1", 1), ("НВС-2025/03-КЖ.1", "НВС-2025-03-КЖ2.1", "НВС-2025/03-КЖ2.1", 1),
    ("НВС-2025/03-КЖ2.1.И1", "НВС-2025-03-КЖ2.1", "НВС-2025/03-КЖ2.1.И1", 0), ("НВС-2O25/O3-КЖ2.1.И1", "НВС-2025-03-КЖ2.1", "НВС-2025/03-КЖ2.1.И1", 2),
    ("HBC-2025/03-КЖ2.1", "НВС-2025-03-КЖ2.1", "HBC-2025/03-КЖ2.1", 0), ("АР-12", "КЖ-12", "АР-12", 0), ("НВС-2025", "НВС-2025-03", "НВС-2025", 0), ("12-OB1", "12-ОВ1", "12-ОВ1", 1),
    ("нвс-O5.КР", "НВС-05.КР", "нвс-05.КР", 1), ("5-АР-1", "S-АР-1", "S-АР-1", 1), ("", "КЖ1", "", 0), ("КЖ1", "", "КЖ1", 0), (" (К1-КЖ4.Z) ", "К1-КЖ4.2", " (К1-КЖ4.Z) ", 0),
]


@query(_twin(CODES, lambda c: [f"{_lit(c[2])}, {c[3]}"], "code, n_changed"))
def mended_codes(spark, sf_dir):
    p = _texts(spark, sf_dir, CODES).withColumn("known", F.element_at(F.array(*(F.lit(c[1]) for c in CODES)), (F.col("case") + 1).cast("int")))
    return p.select("key", codes.align(F.col("text"), F.col("known")).alias("a")).select("key", "a.code", F.size("a.changed").alias("n_changed"))


@query("""WITH r AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS place, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE 'КЖ' || (l_partkey % 4) || '.' || (CASE WHEN l_linenumber = 1 THEN 'ххх' ELSE CAST(l_suppkey % 5 AS VARCHAR) END) END AS code, CASE WHEN l_linenumber = 2 THEN 'TEXT_LAYER' ELSE 'OCR' END AS src FROM lineitem),
 v AS (SELECT run, code, sum(CASE WHEN code LIKE '%2.%' THEN 3 ELSE 1 END) AS n, min(place) AS p FROM r WHERE code IS NOT NULL GROUP BY ALL), b AS (SELECT run, arg_max(code, (n, -p)) AS best FROM v GROUP BY run),
 s AS (SELECT r.*, best, CASE WHEN src = 'TEXT_LAYER' OR code = best THEN NULL WHEN code IS NULL THEN 'FROM_RUN' WHEN levenshtein(code, best) <= 2 THEN 'HARMONIZED' END AS state FROM r LEFT JOIN b USING (run))
 SELECT run, place, CASE WHEN state IS NOT NULL THEN best ELSE code END AS code, state AS code_state, CASE WHEN state = 'HARMONIZED' THEN code END AS code_read FROM s""")
def run_codes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    tail = F.when(F.col("l_linenumber") == 1, "ххх").otherwise((F.col("l_suppkey") % 5).cast("string"))
    rows = li.select(F.col("l_suppkey").alias("run"), place.alias("place"), F.when(F.col("l_orderkey") % 7 != 0, F.concat(F.lit("КЖ"), F.col("l_partkey") % 4, F.lit("."), tail)).alias("code"), F.when(F.col("l_linenumber") == 2, "TEXT_LAYER").otherwise("OCR").alias("code_source"))
    known = rows.select("code").distinct().where("code LIKE '%2.%'")
    return codes.harmonize(rows, ["run"], "place", known).select("run", "place", "code", "code_state", "code_read")

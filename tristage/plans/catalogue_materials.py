"""Queries of reinforcement, fire protection, coatings and finishes, in the manner of catalogue_elements.py: what each passage
must give is written beside it by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions.text import flat
from tristage.operators import materials
from tristage.plans.catalogue import query, table
from tristage.plans.catalogue_elements import _lit, _texts, _twin

_G, _S = [g for g, _ in materials.GROUPS], [s for s, _ in materials.SURFACES]
#: Text, path, as built, and location|binding|purpose|class.
REBAR = [
    ("Форшахта армируется: основная рабочая арматура А400, хомуты А240.", "", False, ["Форшахта|CLAUSE|working|А400", "Форшахта|CLAUSE|constructive|А240"]),
    ("Фундаментная плита армируется рабочей арматурой А500С.", "", False, ["Фундаментная плита|CLAUSE|working|А500С"]),
    ("Стены армируются рабочей арматурой А500.", "", False, ["Вертикальные конструкции|PAGE|working|А500"]),
    ("Применена арматура А240.", "ИД/Ограждение. Форшахта/акт.pdf", True, ["Форшахта|PATH|unknown|А240"]),
    ("Применена арматура А240.", "", False, []),
    ("Ростверк описан. Рабочая арматура А-400 C принята.", "", False, ["Ростверки|PAGE|working|А400С"]),
    ("Лист А4000 и марка КА500, арматура без элемента: рабочая А500.", "", False, []),
]
#: Text, kind|element|minutes.
FIRE = [
    ("Огнезащита: стальные колонны R 90, балки R 60. Огнезащиту выполняет специализированная организация.", ["limit|колонны|90", "limit|балки|60", "project||"]),
    ("Огнезащита металлоконструкций выполнена.", ["mention||"]),
    ("Огнезащита кабелей в стальных лотках R 60.", []),
    ("R 45 для несущих элементов: огнезащита профлиста", ["limit|несущие конструкции|45"]),
    ("Огнезащита ферм по СП 2.13130, предел REI 15.", []),
    ("Колонны стальные R 90.", []),
]
#: Text, primer|enamel|layers of each|microns.
COATS = [
    ("Стальные конструкции: грунтовка ГФ-021 в 2 слоя, эмаль ПФ-115 двумя слоями, 80 мкм.", ["ГФ-021|ПФ-115|2|2|80"]),
    ("Металлоконструкции окрасить эмалью.", ["|эмаль|||"]),
    ("Трубопроводы и стальные элементы грунтуются.", []),
    ("Металлические конструкции покрыты грунтом ГФ-021 и окрашены эмалью ПФ 115 в два слоя", ["ГФ-021|ПФ-115||2|"]),
    ("Металлоконструкции: три слоя грунтовки. Стальные конструкции окрашены, толщина 60 мкм и 120 мкм.", ["||||120"]),
]
#: Text, group|surface|class|form.
NEEDS = [
    ("Вестибюли, лестничные клетки Общие коридоры КМ0 КМ1 КМ2 КМ3", [f"{_G[0]}|{_S[0]}|0|table", f"{_G[1]}|{_S[0]}|1|table", f"{_G[0]}|{_S[1]}|2|table", f"{_G[1]}|{_S[1]}|3|table"]),
    ("На путях эвакуации: класс КМ1 - для отделки стен в коридорах; КМ3 - для покрытий полов в вестибюлях", [f"{_G[1]}|{_S[0]}|1|clause", f"{_G[0]}|{_S[1]}|3|clause"]),
    ("КМ1 - для отделки стен в кабинетах", []),
    ("Вестибюли, лестничные клетки без классов", []),
]
#: Text, form|group|mark|class.
STATED = [
    ("Класс пожарной опасности материалов: - лестничные клетки - КМ0 (НГ) - коридоры - КМ1", [f"general|{_G[0]}||0", f"general|{_G[1]}||1"]),
    ("Пт-2 потолок. Класс пожарной опасности не более КМ2", ["mark||Пт-2|2"]),
    ("- коридоры - КМ1 без заголовка", []),
    ("комплект КМ1 и контактор КМ 1.2", []),
    ("Ст-1.1 и Ст-3, Класс пожарной опасности материала не ниже КМ 1", ["mark||Ст-3|1"]),
]


def _rows(spark, sf_dir, cases, of, *columns):
    """key and what each statement gives, as one string."""
    p = _texts(spark, sf_dir, cases).select("key", F.explode(of(flat(F.col("text")))).alias("v"))
    show = [F.coalesce(F.array_join(F.col(f"v.{c[:-2]}"), "+") if c.endswith("[]") else F.col(f"v.{c}").cast("string"), F.lit("")) for c in columns]
    return p.select("key", F.concat_ws("|", *show).alias("found"))


def _twin_of(cases, i=1):
    return _twin(cases, lambda c: map(_lit, c[i]), "found")


@query(_twin_of(REBAR, 3))
def rebar_classes(spark, sf_dir):
    p = _texts(spark, sf_dir, REBAR)
    at = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in REBAR)), (F.col("case") + 1).cast("int"))
    pages = p.select("key", flat(F.col("text")).alias("flat"), at(1).alias("path"), at(2).alias("as_built"))
    return materials.rebar_classes(pages, ["key"]).select("key", F.concat_ws("|", "location", "binding", "purpose", "raw").alias("found"))


@query(_twin_of(FIRE))
def fire_protection(spark, sf_dir):
    return _rows(spark, sf_dir, FIRE, materials.fire_statements, "kind", "element", "value")


@query(_twin_of(COATS))
def coating_systems(spark, sf_dir):
    return _rows(spark, sf_dir, COATS, materials.coating_systems, "primer[]", "enamel[]", "primer_layers", "enamel_layers", "microns")


@query(_twin_of(NEEDS))
def finish_needs(spark, sf_dir):
    return _rows(spark, sf_dir, NEEDS, materials.finish_requirements, "group", "surface", "value", "form")


@query(_twin_of(STATED))
def finish_stated(spark, sf_dir):
    return _rows(spark, sf_dir, STATED, materials.finish_classes, "form", "group", "mark", "value")


@query(f"""WITH p AS (SELECT p_brand AS brand, p_size AS size, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '{_G[0]}' ELSE '{_G[1]}' END AS grp, CASE WHEN p_partkey % 5 < 4 THEN '{_S[0]}' ELSE '{_S[1]}' END AS surface, p_partkey % 6 AS need, CASE WHEN p_partkey % 3 = 0 THEN 'mark' ELSE 'general' END AS form, p_partkey // 6 % 6 AS value FROM part),
 n AS (SELECT brand, size, grp, min(need) AS need FROM p WHERE surface = '{_S[0]}' GROUP BY ALL), m AS (SELECT brand, size, max(need) AS mild, arg_max(grp, (need, grp)) AS mild_grp, min(need) AS strict FROM n GROUP BY ALL),
 s AS (SELECT p.*, n.need AS own, mild, mild_grp, strict FROM p JOIN m ON m.brand = p.brand AND m.size = p.size LEFT JOIN n ON n.brand = p.brand AND n.size = p.size AND n.grp = p.grp AND p.form = 'general')
 SELECT k, CASE WHEN form = 'general' OR value > mild THEN 'WORSE' ELSE 'BETWEEN' END AS state, CASE WHEN form = 'general' THEN own WHEN value > mild THEN mild ELSE strict END AS need, CASE WHEN form = 'general' THEN grp WHEN value > mild THEN mild_grp END AS against
 FROM s WHERE (form = 'general' AND value > own) OR (form = 'mark' AND value > strict)""")
def worse_finishes(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), k.alias("k"), F.when(k % 2 == 0, _G[0]).otherwise(_G[1]).alias("group"), F.when(k % 5 < 4, _S[0]).otherwise(_S[1]).alias("surface"), (k % 6).alias("need"), F.when(k % 3 == 0, "mark").otherwise("general").alias("form"), F.expr("p_partkey div 6 % 6").alias("value"))
    needs = materials.strictest(p.select("brand", "size", "group", "surface", F.col("need").alias("value")), ["brand", "size"])
    stated = p.select("brand", "size", "k", "form", F.when(F.col("form") == "general", F.col("group")).alias("group"), F.when(F.col("form") == "mark", "Ст-1").alias("mark"), "value")
    return materials.worse(stated, needs, ["brand", "size"]).select("k", "state", "need", "against")

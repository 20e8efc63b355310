"""Queries of acts as XML and of working sheets for design sheets, in the manner of catalogue.py.

A customer is an act whose works are the orders; a supplier's line items with one line number and return flag are a sheet.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.operators import matching
from tristage.plans.catalogue import query, table
from tristage.plans.catalogue_elements import _lit, _texts, _twin
from tristage.sources import acts


def _acts(spark, sf_dir):
    """Acts as files: their works, sheets and a material, with prefixes on some elements and a broken file now and then."""
    o = table(spark, sf_dir, "orders")
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
    work = tag("b:worksListItem", F.concat(tag("workDescription", tag("workName", F.concat(F.lit("работа "), F.col("o_orderkey").cast("string"), F.lit(" &amp; "), "o_orderpriority"))), F.when(F.col("o_orderstatus") == "F", tag("location", tag("place", F.lit("ось 1")))).otherwise("")))
    sheet = tag("sheetNumber", (F.col("o_orderkey") % 50).cast("string"))
    listed = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", work.alias("w"), sheet.alias("s")))).alias("l"))
    body = lambda c: F.array_join(F.transform("l", lambda x: x[c]), "\n")
    section = tag("workDocumentationSectionsListItem", F.concat(tag("workDocumentationSectionCode", F.concat(F.lit("КЖ"), F.col("o_custkey") % 5)), body("s")))
    number = F.when(F.col("o_custkey") % 9 > 0, tag("documentInfo", tag("number", F.concat(F.lit(" А-"), F.col("o_custkey"), F.lit(" "))))).otherwise("")
    xml = F.concat(F.lit('<?xml version="1.0"?><a:aosr xmlns:a="urn:a" xmlns:b="urn:b">'), tag("actInfo", F.concat(number, tag("any", body("w")), section)), F.when(F.col("o_custkey") % 11 > 0, "</a:aosr>").otherwise(""))
    return listed.select(F.col("o_custkey").cast("string").alias("relative_path"), xml.alias("content"))


@query("""WITH c AS (SELECT o_custkey AS k, string_agg('работа ' || o_orderkey || ' & ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '@ось 1' ELSE '@' END, ';' ORDER BY o_orderkey) AS works, string_agg(CAST(o_orderkey % 50 AS VARCHAR), ',' ORDER BY o_orderkey) AS sheets FROM orders GROUP BY 1)
 SELECT CAST(k AS VARCHAR) AS file, CASE WHEN k % 9 > 0 THEN 'А-' || k END AS act_number, works, 'КЖ' || (k % 5) AS code, sheets FROM c WHERE k % 11 > 0""")
def act_contents(spark, sf_dir):
    found, _ = acts.parse(_acts(spark, sf_dir))
    works = F.array_join(F.transform("works", lambda w: F.concat(w["name"], F.lit("@"), F.coalesce(w.place, F.lit("")))), ";")
    return found.select(F.col("relative_path").alias("file"), "act_number", works.alias("works"), F.get("sections", 0).code.alias("code"), F.array_join(F.get("sections", 0).sheets, ",").alias("sheets"))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS file, 'NOT_XML' AS error FROM orders WHERE o_custkey % 11 = 0")
def broken_acts(spark, sf_dir):
    _, bad = acts.parse(_acts(spark, sf_dir))
    return bad.select(F.col("relative_path").alias("file"), "error")


_SHEETS = """WITH l AS (SELECT l_suppkey AS obj, l_linenumber || '-' || (l_orderkey % 6) AS sheet, l_returnflag AS stage, 'D' || ((l_linenumber + CASE WHEN l_returnflag = 'A' AND l_suppkey % 4 = 0 THEN 4 ELSE 0 END) % 6) AS discipline,
  CASE WHEN l_quantity > 40 THEN CAST(l_partkey % 9 AS VARCHAR) END AS floor, CASE WHEN l_discount > 0.05 THEN 'В' || (l_partkey % 7) END AS root FROM lineitem WHERE l_returnflag <> 'N'),
 s AS (SELECT obj, sheet, stage, any_value(discipline) AS discipline, coalesce(list(DISTINCT floor) FILTER (floor IS NOT NULL), []) AS floors, coalesce(list(DISTINCT root) FILTER (root IS NOT NULL), []) AS roots FROM l GROUP BY ALL),
 p AS (SELECT obj, sheet, discipline, CASE WHEN len(floors) > 0 THEN floors ELSE ['1'] END AS floors, roots FROM s WHERE stage = 'A'), r AS (SELECT * FROM s WHERE stage = 'R'),
 d AS (SELECT p.obj, p.sheet, r.sheet AS rd, p.floors AS pf, r.floors AS rf, list_has_any(p.roots, r.roots) AS alike FROM p JOIN r USING (obj, discipline)),
 n AS (SELECT obj, sheet, bool_or(alike) AS narrow FROM d GROUP BY ALL),
 f AS (SELECT d.obj, d.sheet, rd, rf, unnest(pf) AS floor FROM d JOIN n ON n.obj = d.obj AND n.sheet = d.sheet WHERE NOT narrow OR alike),
 k AS (SELECT obj, sheet, floor, rd FROM f WHERE list_contains(rf, floor) OR len(rf) = 0)"""


@query(_SHEETS + """ SELECT obj, sheet, 'MATCHED' AS status, floor, rd FROM k UNION ALL
 SELECT p.obj, p.sheet, CASE WHEN n.sheet IS NULL THEN 'RD_MISSING' ELSE 'NO_CANDIDATES' END, NULL, NULL FROM p LEFT JOIN n ON n.obj = p.obj AND n.sheet = p.sheet WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.obj = p.obj AND k.sheet = p.sheet)""")
def matched_sheets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")  # as-built papers are no sheets
    n = F.col("l_linenumber") + F.when((F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 4 == 0), 4).otherwise(0)
    rows = li.select(F.col("l_suppkey").alias("obj"), F.concat_ws("-", F.col("l_linenumber"), F.col("l_orderkey") % 6).alias("sheet"), F.col("l_returnflag").alias("stage"), F.concat(F.lit("D"), n % 6).alias("discipline"), F.when(F.col("l_quantity") > 40, (F.col("l_partkey") % 9).cast("string")).alias("floor"), F.when(F.col("l_discount") > 0.05, F.concat(F.lit("В"), F.col("l_partkey") % 7)).alias("root"))
    s = rows.groupBy("obj", "sheet", "stage").agg(F.first("discipline").alias("discipline"), F.collect_set("floor").alias("floors"), F.collect_set("root").alias("roots"))
    side = lambda f: s.where(F.col("stage") == f).drop("stage")
    return matching.match(side("A"), side("R"), ["obj"]).select("obj", "sheet", "status", "floor", "rd")


#: Title, floors.
TITLES = [("План 3-го этажа", "3"), ("Схема с 2 по 4 этаж", "2,3,4"), ("Подвал на отм. -3.000 и кровля", "0,ROOF"), ("План на отм. +6.300", "3"), ("Общие данные", ""), ("этаж 99", ""), ("Экспликация, отм. 0,000", "1")]


@query(_twin(TITLES, lambda c: [_lit(c[1])], "floors"))
def sheet_floors(spark, sf_dir):
    found = matching.floors(F.col("text"), F.array().cast("array<string>"))
    return _texts(spark, sf_dir, TITLES).select("key", F.array_join(found, ",").alias("floors"))

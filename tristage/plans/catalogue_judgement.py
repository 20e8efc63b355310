"""Queries of what findings may claim, in the manner of catalogue.py. A line item is a finding of its part's brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.operators import judgement
from tristage.plans.catalogue import query, table

_LABELS = {"A": "VIOLATION_PRESENT", "R": "NO_VIOLATION", "N": "COMPARISON_IMPOSSIBLE"}
_GRADES = ["Критическое (приостановка работ)", "Существенное (предписание)", "Незначительное", ""]
_TABLE = {"критическое (приостановка работ)": "STOP", "существенное (предписание)": "ORDER", "незначительное": "NOTE"}


def _findings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    label = F.coalesce(*(F.when(F.col("l_returnflag") == k, v) for k, v in _LABELS.items()))
    grade = F.element_at(F.array(*map(F.lit, _GRADES)), (F.col("l_quantity") % 4 + 1).cast("int"))
    side = lambda v, read: F.struct(v.alias("value"), F.when(read, "RECOGNIZED").otherwise("LAYER").alias("source"), F.when(F.col("l_partkey") % 5 == 0, F.array(v + 1)).alias("layer_conflict"), F.when(F.col("l_partkey") % 7 == 0, F.array(F.lit("7"))).alias("doubtful"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.concat(F.when(F.col("l_linenumber") == 7, "FREE-").otherwise(""), "p_brand").alias("parameter_code"), F.when(F.col("l_linestatus") == "F", "FREE_SEARCH").alias("matrix_scope"), label.alias("label"), grade.alias("criticality"), F.when(F.col("l_orderkey") % 3 == 0, "order").alias("protocol_status"), side(F.col("l_quantity") % 3, F.col("l_orderkey") % 2 == 0).alias("pd"), side(F.col("l_linenumber") % 3, F.col("l_orderkey") % 5 == 0).alias("rd"), F.lit(None).cast("struct<value:double,source:string,layer_conflict:array<double>,doubtful:array<string>>").alias("built"), (F.col("l_linenumber") == 6).alias("values_are_set"))


_FINDINGS = f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linenumber = 7 THEN 'FREE-' ELSE '' END || p_brand AS code, l_linestatus = 'F' AS free, CASE l_returnflag {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items())} END AS label,
 {_GRADES}[CAST(l_quantity AS INTEGER) % 4 + 1] AS own, CASE WHEN l_orderkey % 3 = 0 THEN 'order' END AS status, l_quantity % 3 AS pv, l_linenumber % 3 AS rv, l_orderkey % 2 = 0 AS pr, l_orderkey % 5 = 0 AS rr, l_partkey % 5 = 0 AS conflict, l_partkey % 7 = 0 AS doubt FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(_FINDINGS + f""", c AS (SELECT 'Brand#' || n AS code, {_GRADES}[n % 4 + 1] AS known FROM range(1, 26) t(n)), j AS (SELECT f.*, CASE WHEN label = 'VIOLATION_PRESENT' AND NOT free AND code NOT LIKE 'FREE-%' AND known <> '' THEN known END AS known FROM f LEFT JOIN c USING (code)),
 s AS (SELECT *, coalesce(known, own) AS severity FROM j), b AS (SELECT *, CASE severity WHEN 'Критическое (приостановка работ)' THEN 'STOP' WHEN 'Существенное (предписание)' THEN 'ORDER' WHEN 'Незначительное' THEN 'NOTE' END AS by_severity FROM s)
 SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, severity, known IS NOT NULL AND own <> '' AND own <> known AS severity_differs, CASE WHEN status IS NULL THEN CASE label WHEN 'NO_VIOLATION' THEN 'OK' WHEN 'COMPARISON_IMPOSSIBLE' THEN label ELSE by_severity END WHEN severity = own THEN 'ORDER' ELSE by_severity END AS protocol FROM b""")
def finding_severity(spark, sf_dir):
    brands = spark.range(1, 26).select(F.concat(F.lit("brand#"), "id").alias("parameter_code"), F.element_at(F.array(*map(F.lit, _GRADES)), (F.col("id") % 4 + 1).cast("int")).alias("criticality"))
    out = judgement.severity(_findings(spark, sf_dir), brands)
    status = judgement.protocol_status(F.col("label"), F.col("protocol_status"), F.col("criticality"), F.col("severity"), _TABLE)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "severity", "severity_differs", status.alias("protocol"))


@query(_FINDINGS + """ SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, concat_ws(',', CASE WHEN pr THEN 'pd' END, CASE WHEN rr THEN 'rd' END) AS machine,
 concat_ws(',', CASE WHEN (pr OR rr) AND label = 'VIOLATION_PRESENT' THEN 'VIOLATION_ON_READING' END, CASE WHEN pr AND conflict THEN 'LAYER_CONFLICT:pd' END, CASE WHEN pr AND NOT rr AND l_linenumber <> 6 AND pv <> rv THEN 'READING_DIFFERS:pd' END, CASE WHEN doubt THEN 'DOUBTFUL:pd' END,
  CASE WHEN rr AND conflict THEN 'LAYER_CONFLICT:rd' END, CASE WHEN rr AND NOT pr AND l_linenumber <> 6 AND pv <> rv THEN 'READING_DIFFERS:rd' END, CASE WHEN doubt THEN 'DOUBTFUL:rd' END) AS ask FROM f""")
def readings_to_confirm(spark, sf_dir):
    out = judgement.recognized_review(_findings(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.array_join("machine", ",").alias("machine"), F.array_join("ask", ",").alias("ask"))


@query("""WITH c AS (SELECT DISTINCT source AS code, doc_id AS file FROM documents), n AS (SELECT code, unnest(list_filter(regexp_split_to_array(d.text, '[^0-9.,]+'), lambda x: regexp_full_match(x, '[0-9]{3,5}'))) AS v FROM c JOIN documents d ON d.doc_id = c.file AND d.source = c.code WHERE regexp_matches(d.text, '[0-9]{3}'))
 SELECT code, array_to_string(list_sort(list(DISTINCT CAST(v AS INTEGER))), ',') AS nums FROM n WHERE CAST(v AS INTEGER) BETWEEN 150 AND 90000 GROUP BY code""")
def known_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cands = d.select("source", F.col("source").alias("parameter_code"), F.col("doc_id").alias("file_id"))
    rules = d.select(F.col("source").alias("parameter_code")).distinct().select("parameter_code", F.lit("[0-9]{3}").alias("sheet_text"), F.lit(150.0).alias("low"), F.lit(90000.0).alias("high"))
    out = judgement.known_values(d.select("source", F.col("doc_id").alias("file_id"), "text"), cands, rules, ["source"])
    return out.select(F.col("parameter_code").alias("code"), F.array_join(F.col("values").cast("array<string>"), ",").alias("nums"))

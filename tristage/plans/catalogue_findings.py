"""Queries of whole findings, in the manner of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.operators import changes, findings
from tristage.plans.catalogue import CANDS, FINE, candidates, fine, query, table

_KIND = "CASE CAST(replace(code, 'Brand#', '') AS INTEGER) % 3 WHEN 0 THEN 'relative' WHEN 1 THEN 'decrease' ELSE 'any_change' END"
_PAIR = "CASE WHEN {0} IS NULL AND {1} IS NULL THEN NULL WHEN {0} IS NULL OR {1} IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN abs({0} - {1}) <= 0.5 THEN 'NO_VIOLATION' WHEN kind = 'any_change' OR kind = 'relative' AND abs({1} - {0}) / {0} > 0.3 OR kind = 'decrease' AND {1} < {0} THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END"
_WHY = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN NULL WHEN abs({0} - {1}) <= 0.5 THEN 'EQUAL_PD_RD' WHEN kind = 'any_change' OR kind = 'relative' AND abs({1} - {0}) / {0} > 0.3 THEN 'VALUE_MISMATCH' WHEN kind = 'decrease' AND {1} < {0} THEN 'VALUE_DECREASE' ELSE 'NON_TRIGGERING_DIFFERENCE_NO_DECREASE' END"


@query(CANDS + f""", dense AS (SELECT file_id, page, count(DISTINCT code) AS density FROM cands GROUP BY ALL),
 l AS (SELECT * FROM (SELECT *, max(rank) OVER (PARTITION BY code, stage, chain) AS top FROM cands) WHERE rank = top),
 k AS (SELECT *, NOT has AS fallback FROM (SELECT *, bool_or(section = 'PROMO' AND chain % 3 = 0) OVER (PARTITION BY code, stage) AS has FROM l) WHERE NOT has OR section = 'PROMO' AND chain % 3 = 0),
 v AS (SELECT code, stage, value, sum(1 + density) AS weight, count(*) AS pages FROM (SELECT DISTINCT code, stage, value, file_id, page FROM k) JOIN dense USING (file_id, page) GROUP BY ALL),
 b AS (SELECT code, stage, value FROM (SELECT *, row_number() OVER (PARTITION BY code, stage ORDER BY weight DESC, pages DESC, value) AS r FROM v) WHERE r = 1), f AS (SELECT code, stage, bool_or(fallback) AS fallback FROM k GROUP BY ALL),
 s AS (SELECT code, max(value) FILTER (stage = 'PD') AS pd, max(value) FILTER (stage = 'RD') AS rd, max(value) FILTER (stage = 'ID') AS built, coalesce(bool_or(fallback) FILTER (stage = 'PD'), false) AS pf, coalesce(bool_or(fallback) FILTER (stage = 'RD'), false) AS rf FROM b JOIN f USING (code, stage) GROUP BY code),
 q AS (SELECT *, {_KIND} AS kind, coalesce(rd, pd) AS ref, CAST(replace(code, 'Brand#', '') AS INTEGER) % 5 = 0 AS strict FROM s),
 j AS (SELECT *, {_PAIR.format('pd', 'rd')} AS l1, {_WHY.format('pd', 'rd')} AS r1, CASE WHEN built IS NOT NULL AND ref IS NOT NULL THEN {_PAIR.format('ref', 'built')} END AS l2, CASE WHEN built IS NOT NULL AND ref IS NOT NULL THEN {_WHY.format('ref', 'built')} END AS r2 FROM q),
 x AS (SELECT *, l2 = 'NO_VIOLATION' AND l1 = 'COMPARISON_IMPOSSIBLE' AND (pd IS NULL) <> (rd IS NULL) AS alone FROM j),
 y AS (SELECT *, CASE WHEN l2 = 'VIOLATION_PRESENT' THEN l2 WHEN alone THEN 'NO_VIOLATION' ELSE l1 END AS label0, CASE WHEN l2 = 'VIOLATION_PRESENT' THEN r2 WHEN l2 = 'NO_VIOLATION' AND l1 = 'NO_VIOLATION' AND r1 = 'EQUAL_PD_RD' AND r2 = 'EQUAL_PD_RD' THEN 'EQUAL_ALL_AVAILABLE_STAGES' WHEN alone THEN CASE WHEN r2 = 'EQUAL_PD_RD' THEN 'EQUAL_ALL_AVAILABLE_STAGES' ELSE r2 END ELSE r1 END AS result0 FROM x),
 z AS (SELECT *, CASE WHEN label0 IS NOT NULL AND coalesce(pf AND rf AND pd <> rd OR strict AND (pf OR rf), false) THEN 'COMPARISON_IMPOSSIBLE' ELSE label0 END AS label FROM y)
 SELECT code, kind, label, CASE WHEN label = label0 THEN result0 END AS result, pd, rd, built, CASE WHEN label = 'COMPARISON_IMPOSSIBLE' THEN CASE WHEN pd IS NULL OR rd IS NULL THEN 'MISSING_EVIDENCE' ELSE 'NOT_COMPARABLE' END ELSE 'CANDIDATE' END AS status FROM z WHERE label IS NOT NULL""")
def build_findings(spark, sf_dir):
    number = F.regexp_replace("code", "Brand#", "").cast("int")
    rules = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code")).distinct()
    rules = rules.select("code", F.expr(_KIND).alias("kind"), F.lit(0.3).alias("threshold"), F.lit(0.0).alias("tolerance"), (number % 5 == 0).alias("strict"))
    wanted = (F.col("section") == "PROMO") & (F.col("chain") % 3 == 0)
    return findings.build(candidates(spark, sf_dir), rules, ["file_id", "page"], wanted, "rank", "chain", ["relative", "decrease", "any_change"])


@query(FINE + """, s AS (SELECT code, chain, coalesce(list_sort(list(DISTINCT value) FILTER (stage = 'PD')), []) AS pd, coalesce(list_sort(list(DISTINCT value) FILTER (stage = 'RD')), []) AS rd FROM cands GROUP BY ALL),
 c AS (SELECT *, len(pd) > 0 AND len(rd) > 0 AS two, len(pd) > 0 AND len(rd) > 0 AND abs(list_max(rd) - list_max(pd)) / list_max(pd) > 0.02 AS changed FROM s),
 g AS (SELECT code, count(*) FILTER (changed) AS n, count(*) FILTER (two) AS keys, count(*) FILTER (len(pd) > 0) AS p, count(*) FILTER (len(rd) > 0) AS r, coalesce(array_to_string(list_sort(list(DISTINCT chain) FILTER (changed)), ','), '') AS changes FROM c GROUP BY code)
 SELECT code, CASE WHEN n > 0 THEN 'VIOLATION_PRESENT' WHEN p = 0 OR r = 0 OR keys = 0 THEN 'COMPARISON_IMPOSSIBLE' ELSE 'NO_VIOLATION' END AS label, CASE WHEN n > 0 THEN 'VALUE_MISMATCH' WHEN p = 0 OR r = 0 OR keys = 0 THEN NULL ELSE 'EQUAL_PD_RD' END AS result, keys, changes, n > 0 AS hypothesis FROM g""")
def keyed_findings(spark, sf_dir):
    keyed = changes.sides(fine(candidates(spark, sf_dir)), ["code", "chain"])
    out = findings.of_keys(keyed, ["code"], "chain", changes.off_by(F.col("pd"), F.col("rd")))
    return out.withColumn("changes", F.array_join(F.col("changes").cast("array<string>"), ","))

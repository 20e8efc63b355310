"""Queries of comparisons: typed results, sets by key, boxes, sheets; in the manner of catalogue.py.

A part is a key; the quantities of its returned line items are its design values, those of accepted ones the working
values (stages PD and RD of the candidates).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.operators import changes, compare, ordered, spatial
from tristage.plans.catalogue import CANDS, FINE, candidates, fine, query, table

#: Sides of a part in SQL, as arrays.
SIDES = CANDS + """, s AS (SELECT chain, coalesce(list_sort(list(DISTINCT value) FILTER (stage = 'PD')), []) AS pd, coalesce(list_sort(list(DISTINCT value) FILTER (stage = 'RD')), []) AS rd FROM cands GROUP BY chain)"""
_NEW = "len(list_filter(rd, lambda x: NOT list_contains(pd, x)))"
_GONE = "len(list_filter(pd, lambda x: NOT list_contains(rd, x)))"
_BOTH = "len(pd) > 0 AND len(rd) > 0"
_TESTS = {
    "replaced": f"{_BOTH} AND pd <> rd",
    "added": f"{_BOTH} AND {_NEW} > 0",
    "exchanged": f"{_NEW} > 0 AND {_GONE} > 0",
    "larger": f"{_BOTH} AND list_max(rd) > list_max(pd) + 1e-9",
    "smaller": f"{_BOTH} AND list_min(rd) < list_min(pd) - 1e-9",
    "below_largest": f"{_BOTH} AND list_min(rd) < list_max(pd)",
    "off_by": f"{_BOTH} AND abs(list_max(rd) - list_max(pd)) / list_max(pd) > 0.02",
    "worse_percent": f"{_BOTH} AND floor((list_max(rd) - list_max(pd)) / list_max(pd) * 100 + 0.5 + 1e-9) > 2",
}
_SET_SQL = SIDES + " " + " UNION ALL ".join(f"SELECT chain, '{k}' AS kind, coalesce({t}, false) AS changed FROM s" for k, t in _TESTS.items())


def _sides(spark, sf_dir):
    return changes.sides(candidates(spark, sf_dir), ["chain"])


@query(_SET_SQL)
def set_change_kinds(spark, sf_dir):
    pd, rd = F.col("pd"), F.col("rd")
    tests = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(getattr(changes, k)(pd, rd), F.lit(False)).alias("changed")) for k in _TESTS))
    return _sides(spark, sf_dir).select("chain", F.explode(tests).alias("x")).select("chain", "x.*")


@query(SIDES + f""" SELECT chain, len(pd) % 2 = 0 AS is_limit, coalesce({_BOTH} AND (list_max(rd) > CASE WHEN len(pd) % 2 = 0 THEN list_min(pd) ELSE list_max(pd) END + 1e-9 OR (len(pd) % 2 = 1 AND list_min(rd) < list_min(pd) - 1e-9)), false) AS outside,
 CASE WHEN {_BOTH} AND {_NEW} > 0 THEN CASE WHEN {_NEW} = len(rd) THEN 'OTHER' ELSE 'ADDED' END END AS colours FROM s""")
def ranges_and_colours(spark, sf_dir):
    limit = F.size("pd") % 2 == 0
    return _sides(spark, sf_dir).select("chain", limit.alias("is_limit"), F.coalesce(changes.outside(F.col("pd"), F.col("rd"), limit), F.lit(False)).alias("outside"), changes.not_within(F.col("pd"), F.col("rd")).alias("colours"))


@query(CANDS + """, t AS (SELECT chain, sum(value) FILTER (stage = 'PD') AS pd, sum(value) FILTER (stage = 'RD') AS rd FROM cands GROUP BY chain)
 SELECT chain, CASE WHEN pd IS NULL THEN 'ADDED' WHEN rd IS NULL THEN 'MISSING' WHEN round_even((pd - rd) * 100 / pd, 0) > 5 THEN 'FEWER' ELSE 'SAME' END AS status, coalesce((rd - pd) / pd > 0.1, false) AS exceeds FROM t""")
def totals_by_kind(spark, sf_dir):
    t = candidates(spark, sf_dir).groupBy("chain").agg(*(F.sum(F.when(F.col("stage") == s, F.col("value"))).alias(s.lower()) for s in ("PD", "RD")))
    return t.select("chain", changes.fewer_percent(F.col("pd"), F.col("rd")).alias("status"), changes.exceeds(F.col("pd"), F.col("rd")).alias("exceeds"))


@query(FINE + """, n AS (SELECT DISTINCT chain AS system, stage, 'K' || CAST(chain AS VARCHAR) || CASE WHEN (file_id + CASE stage WHEN 'PD' THEN 0 ELSE 1 END) % 7 = 0 THEN '' ELSE '-' || CAST(page AS VARCHAR) END AS name FROM cands),
 s AS (SELECT system, coalesce(list(name) FILTER (stage = 'PD'), []) AS pd, coalesce(list(name) FILTER (stage = 'RD'), []) AS rd FROM n GROUP BY system)
 SELECT system, len(pd) > 0 AND len(rd) > 0 AND NOT list_has_any(pd, rd) AND (len(list_filter(pd, lambda x: NOT contains(x, '-'))) > 0) <> (len(list_filter(rd, lambda x: NOT contains(x, '-'))) > 0) AS mismatch FROM s""")
def numbering_mismatch(spark, sf_dir):
    c = fine(candidates(spark, sf_dir)).withColumn("system", F.col("chain"))
    bare = (F.col("file_id") + F.when(F.col("stage") == "PD", 0).otherwise(1)) % 7 == 0
    name = F.concat(F.lit("K"), F.col("system").cast("string"), F.when(bare, "").otherwise(F.concat(F.lit("-"), F.col("page").cast("string"))))
    s = changes.sides(c.withColumn("name", name), ["system"], value="name")
    return s.select("system", changes.unnumbered(F.col("pd"), F.col("rd")).alias("mismatch"))


_CASES = FINE + """, c AS (SELECT DISTINCT chain, stage, page % 3 + 1 AS jets, value % 4 + 1 AS flow FROM cands),
 s AS (SELECT chain, coalesce(list_sort(list({'jets': jets, 'flow': flow}) FILTER (stage = 'PD')), []) AS pd, coalesce(list_sort(list({'jets': jets, 'flow': flow}) FILTER (stage = 'RD')), []) AS rd FROM c GROUP BY chain)"""


@query(_CASES + """, l AS (SELECT *, len(list_filter(rd, lambda r: NOT list_contains(pd, r) AND len(list_filter(pd, lambda p: r.jets < p.jets OR r.flow < p.flow)) > 0)) AS low FROM s)
 SELECT chain, CASE WHEN len(pd) = 0 AND len(rd) = 0 THEN NULL WHEN len(pd) = 0 OR len(rd) = 0 THEN 'COMPARISON_IMPOSSIBLE' WHEN pd = rd THEN 'NO_VIOLATION' WHEN low > 0 AND len(pd) = 1 THEN 'VIOLATION_PRESENT' WHEN low > 0 THEN 'COMPARISON_IMPOSSIBLE' ELSE 'NO_VIOLATION' END AS label,
 CASE WHEN len(pd) = 0 OR len(rd) = 0 THEN NULL WHEN pd = rd THEN 'EQUAL_PD_RD' WHEN low > 0 AND len(pd) = 1 THEN 'VALUE_DECREASE' WHEN low > 0 THEN NULL ELSE 'NON_TRIGGERING_DIFFERENCE_NO_DECREASE' END AS result FROM l""")
def jet_decisions(spark, sf_dir):
    c = fine(candidates(spark, sf_dir)).withColumn("case", F.struct((F.col("page") % 3 + 1).alias("jets"), (F.col("value") % 4 + 1).alias("flow")))
    return changes.sides(c, ["chain"], value="case").select("chain", changes.jets(F.col("pd"), F.col("rd")).alias("x")).select("chain", "x.*")


@query(_CASES + """ SELECT chain, len(list_filter(rd, lambda r: NOT list_contains(pd, r) AND r.jets < list_max(list_transform(pd, lambda p: p.jets)))) > 0 AS flow, len(list_filter(rd, lambda r: NOT list_contains(pd, r) AND r.flow < list_max(list_transform(pd, lambda p: p.flow)))) > 0 AS pressure FROM s""")
def duty_reductions(spark, sf_dir):
    c = fine(candidates(spark, sf_dir)).withColumn("case", F.struct((F.col("page") % 3 + 1).alias("flow"), (F.col("value") % 4 + 1).alias("pressure")))
    out = changes.sides(c, ["chain"], value="case").select("chain", changes.duty(F.col("pd"), F.col("rd")).alias("x"))
    return out.select("chain", F.array_contains("x", "FLOW").alias("flow"), F.array_contains("x", "PRESSURE").alias("pressure"))


@query(FINE + """, n AS (SELECT DISTINCT chain, stage, CASE WHEN page % 3 = 0 THEN 'LED' WHEN page % 3 = 1 THEN 'HALOGEN' ELSE 'LUMINESCENT' END AS kind FROM cands),
 s AS (SELECT chain, coalesce(list_sort(list(kind) FILTER (stage = 'PD')), []) AS pd, coalesce(list_sort(list(kind) FILTER (stage = 'RD')), []) AS rd FROM n GROUP BY chain)
 SELECT chain, CASE WHEN len(pd) = 0 AND len(rd) = 0 THEN NULL WHEN len(pd) = 0 OR len(rd) = 0 THEN 'COMPARISON_IMPOSSIBLE' WHEN list_contains(pd, 'LED') AND len(list_filter(rd, lambda x: x <> 'LED' AND NOT list_contains(pd, x))) > 0 THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END AS lighting,
 CASE WHEN list_contains(pd, 'LED') AND list_contains(rd, 'LED') THEN 'EQUAL_PD_RD' WHEN list_contains(rd, 'LED') THEN 'NON_TRIGGERING_DIFFERENCE_NO_DECREASE' END AS metering FROM s""")
def lighting_and_metering(spark, sf_dir):
    third = F.col("page") % 3
    c = fine(candidates(spark, sf_dir)).withColumn("kind", F.when(third == 0, "LED").when(third == 1, "HALOGEN").otherwise("LUMINESCENT"))
    s = changes.sides(c, ["chain"], value="kind")
    return s.select("chain", changes.light(F.col("pd"), F.col("rd"), "LED").label.alias("lighting"), changes.meter(F.array_contains("pd", "LED"), F.array_contains("rd", "LED")).result.alias("metering"))


_CABLES = FINE + """, n AS (SELECT DISTINCT chain, stage, CASE page % 3 WHEN 0 THEN 'VVG-FRLS' WHEN 1 THEN 'VVG-LS' ELSE 'PPG-HF' END AS mark, page % 2 + 3 AS cores, value % 6 + 1.5 AS section FROM cands),
 c AS (SELECT chain, stage, {'mark': mark, 'cores': cores, 'section': section, 'family': regexp_replace(mark, '(?i)-?(?:FR)?(?:LS|HF|LTX)$', ''), 'fire': contains(mark, 'FR')} AS c FROM n),
 s AS (SELECT chain, coalesce(list(c) FILTER (stage = 'PD'), []) AS pd, coalesce(list(c) FILTER (stage = 'RD'), []) AS rd FROM c GROUP BY chain)"""


@query(_CABLES + """ SELECT chain, len(rd) > 0 AND len(list_filter(pd, lambda p: p.fire)) > 0 AND len(list_filter(rd, lambda p: p.fire)) = 0 AS lost_fire,
 len(list_filter(pd, lambda p: NOT list_contains(rd, p) AND coalesce(list_max(list_transform(list_filter(rd, lambda r: r.cores = p.cores AND r.family = p.family), lambda r: r.section)) < p.section, false))) AS thinner FROM s""")
def cable_changes(spark, sf_dir):
    third = F.col("page") % 3
    mark = F.when(third == 0, "VVG-FRLS").when(third == 1, "VVG-LS").otherwise("PPG-HF")
    c = F.struct(mark.alias("mark"), (F.col("page") % 2 + 3).alias("cores"), (F.col("value") % 6 + 1.5).alias("section"), changes.family(mark).alias("family"), mark.contains("FR").alias("fire"))
    s = changes.sides(fine(candidates(spark, sf_dir)).withColumn("c", c), ["chain"], value="c")
    return s.select("chain", changes.lost_fire_cable(F.col("pd"), F.col("rd")).alias("lost_fire"), F.size(changes.thinner_cable(F.col("pd"), F.col("rd"))).cast("long").alias("thinner"))


@query("""WITH s AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_size || '(1x' || (p_partkey % 90 + 1) || ')+1х35' WHEN 1 THEN ' ' || p_size || ' × ' || (p_partkey % 9) || ',5' WHEN 2 THEN p_size || 'х4' ELSE 'без размера' END AS size FROM part),
 t AS (SELECT k, replace(replace(regexp_replace(size, '\\s', '', 'g'), 'х', 'x'), '×', 'x') AS t FROM s)
 SELECT k, CASE WHEN k % 4 = 0 THEN try_cast(regexp_extract(t, '^([0-9]+)', 1) AS INTEGER) * 1 ELSE try_cast(regexp_extract(t, '^([0-9]{1,2})x', 1) AS INTEGER) END AS cores,
 try_cast(replace(CASE WHEN k % 4 = 0 THEN regexp_extract(t, '\\(1x([0-9]+)\\)', 1) ELSE regexp_extract(t, '^[0-9]{1,2}x([0-9]{1,3}(?:,[0-9])?)', 1) END, ',', '.') AS DOUBLE) AS section FROM t""")
def cable_sizes(spark, sf_dir):
    text = "CASE p_partkey % 4 WHEN 0 THEN p_size || '(1x' || (p_partkey % 90 + 1) || ')+1х35' WHEN 1 THEN ' ' || p_size || ' × ' || (p_partkey % 9) || ',5' WHEN 2 THEN p_size || 'х4' ELSE 'без размера' END"
    cores, section = changes.cable(F.expr(text))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), cores.alias("cores"), section.alias("section"))


_PRINTED = """WITH r AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE p_size || ',' || (p_partkey % 10) END AS pd_raw,
 CASE p_partkey % 6 WHEN 0 THEN p_size || '.' || (p_partkey % 10) || '0' WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN p_size || ',' || (p_partkey % 7) WHEN 3 THEN NULL ELSE (p_size - p_partkey % 3) || ',' || (p_partkey % 10) || (p_partkey % 8) END AS rd_raw FROM part)"""
_PRINTED_SQL = _PRINTED + """, v AS (SELECT *, CAST(replace(pd_raw, ',', '.') AS DOUBLE) AS pd, CAST(replace(rd_raw, ',', '.') AS DOUBLE) AS rd, length(regexp_extract(pd_raw, '[.,]([0-9]+)$', 1)) AS dp, length(regexp_extract(rd_raw, '[.,]([0-9]+)$', 1)) AS dr FROM r),
 e AS (SELECT *, abs(pd - rd) <= 0.5 * power(10.0, -least(dp, dr)) AS same FROM v)"""


def _printed(kind: str, change: str, result: str) -> str:
    none = "pd IS NULL AND rd IS NULL"
    return f"SELECT k, '{kind}' AS kind, CASE WHEN {none} THEN NULL WHEN pd IS NULL OR rd IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN NOT same AND {change} THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END AS label, CASE WHEN pd IS NULL OR rd IS NULL THEN NULL WHEN same THEN CASE WHEN pd_raw = rd_raw THEN 'EQUAL_PD_RD' ELSE 'EQUAL_AFTER_DECIMAL_NORMALIZATION' END WHEN {change} THEN '{result}' ELSE 'NON_TRIGGERING_DIFFERENCE_NO_DECREASE' END AS result FROM e"


@query(_PRINTED_SQL + " " + " UNION ALL ".join([_printed("any_change", "true", "VALUE_MISMATCH"), _printed("relative", "(pd = 0 OR abs(rd - pd) / abs(pd) > 0.05)", "VALUE_MISMATCH"), _printed("decrease", "rd < pd", "VALUE_DECREASE"), _printed("increase", "rd > pd", "VALUE_MISMATCH")])
       + " UNION ALL SELECT k, 'decrease_or_text_change', CASE WHEN pd IS NULL AND rd IS NULL THEN NULL WHEN pd IS NULL OR rd IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN rd < pd OR pd_raw <> rd_raw THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END, CASE WHEN pd IS NULL OR rd IS NULL THEN NULL WHEN rd < pd THEN 'DIMENSION_REDUCED' WHEN pd_raw <> rd_raw THEN 'VALUE_MISMATCH' ELSE 'EQUAL_PD_RD' END FROM e")
def decide_printed(spark, sf_dir):
    """Values as printed, with decimals on either side."""
    raw = _PRINTED[_PRINTED.index("SELECT") : _PRINTED.rindex(")")].replace("FROM part", "")
    part = table(spark, sf_dir, "part")
    pd_sql, rd_sql = raw[raw.index("CASE p_partkey % 5") :].split(" AS pd_raw,")
    rows = part.select(F.col("p_partkey").alias("k"), F.expr(pd_sql).alias("pd_raw"), F.expr(rd_sql.replace(" AS rd_raw", "")).alias("rd_raw"))
    number = lambda c: F.regexp_replace(c, ",", ".").try_cast("double")
    rows = rows.withColumn("pd", number("pd_raw")).withColumn("rd", number("rd_raw"))
    every = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    kinds = ["any_change", "relative", "decrease", "increase", "decrease_or_text_change"]
    judged = [F.struct(F.lit(k).alias("kind"), compare.judge(k, F.col("pd"), F.col("rd"), every("pd"), every("rd"), pd_raw=F.col("pd_raw"), rd_raw=F.col("rd_raw"), pd_row=F.col("pd_raw"), rd_row=F.col("rd_raw"), threshold=0.05).alias("j")) for k in kinds]
    return rows.select("k", F.explode(F.array(*judged)).alias("x")).select("k", "x.kind", "x.j.label", "x.j.result")


@query(SIDES + """, d AS (SELECT chain, CASE WHEN len(pd) > 0 THEN pd END AS pd, CASE WHEN len(rd) > 0 THEN rd END AS rd, chain % 3 = 0 AS clause, list_filter(rd, lambda x: x % 5 = 0) AS listed, CASE WHEN chain % 2 = 0 THEN list_filter(pd, lambda x: x % 2 = 0) ELSE [] END AS named FROM s),
 l AS (SELECT *, list_filter(rd, lambda x: x < list_min(pd)) AS lower FROM d),
 m AS (SELECT *, len(list_filter(lower, lambda x: NOT list_contains(listed, x) AND NOT list_contains(named, x))) = 0 AS excused, list_has_any(pd, rd) OR len(list_filter(lower, lambda x: NOT list_contains(named, x))) = 0 AS harmless, len(list_filter(rd, lambda x: NOT list_contains(pd, x) AND x < list_max(pd))) > 0 AS fresh FROM l)
 SELECT chain, CASE WHEN pd IS NULL AND rd IS NULL THEN NULL WHEN pd IS NULL OR rd IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN pd = rd THEN 'NO_VIOLATION' WHEN len(lower) > 0 THEN CASE WHEN excused AND harmless THEN 'NO_VIOLATION' WHEN excused OR NOT clause THEN 'COMPARISON_IMPOSSIBLE' ELSE 'VIOLATION_PRESENT' END WHEN fresh THEN 'COMPARISON_IMPOSSIBLE' ELSE 'NO_VIOLATION' END AS label FROM m""")
def element_sets(spark, sf_dir):
    s = _sides(spark, sf_dir)
    listed = F.filter("rd", lambda x: x % 5 == 0)
    named = F.when(F.col("chain") % 2 == 0, F.filter("pd", lambda x: x % 2 == 0)).otherwise(F.array().cast("array<double>"))
    s = s.select("chain", *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("pd", "rd")), F.when(F.col("chain") % 3 == 0, "CLAUSE").otherwise("SHEET").alias("binding"), listed.alias("listed"), named.alias("named"))
    return s.select("chain", compare.decide_set(F.col("pd"), F.col("rd"), F.col("binding"), F.col("listed"), F.col("named")).label.alias("label"))


@query(CANDS + """, s AS (SELECT code, chain, max(value) FILTER (stage = 'PD') AS pd, max(value) FILTER (stage = 'RD') AS rd, max(value) FILTER (stage = 'ID') AS built FROM cands GROUP BY code, chain),
 a AS (SELECT *, coalesce(rd, pd) AS ref, CASE WHEN pd IS NULL OR rd IS NULL THEN CASE WHEN pd IS NULL AND rd IS NULL THEN NULL ELSE 'COMPARISON_IMPOSSIBLE' END WHEN abs(pd - rd) <= 0.5 OR rd >= pd THEN 'NO_VIOLATION' ELSE 'VIOLATION_PRESENT' END AS l, CASE WHEN abs(pd - rd) <= 0.5 THEN 'EQUAL_PD_RD' WHEN rd < pd THEN 'VALUE_DECREASE' WHEN rd > pd THEN 'NON_TRIGGERING_DIFFERENCE_NO_DECREASE' END AS r FROM s),
 b AS (SELECT *, CASE WHEN built IS NULL OR ref IS NULL THEN NULL WHEN abs(ref - built) <= 0.5 OR built >= ref THEN 'NO_VIOLATION' ELSE 'VIOLATION_PRESENT' END AS bl, CASE WHEN abs(ref - built) <= 0.5 THEN 'EQUAL_PD_RD' WHEN built < ref THEN 'VALUE_DECREASE' WHEN built > ref THEN 'NON_TRIGGERING_DIFFERENCE_NO_DECREASE' END AS br FROM a)
 SELECT code, chain, CASE WHEN bl IS NULL THEN l WHEN bl = 'VIOLATION_PRESENT' THEN bl WHEN l = 'NO_VIOLATION' THEN l WHEN l = 'COMPARISON_IMPOSSIBLE' AND (pd IS NULL) <> (rd IS NULL) THEN 'NO_VIOLATION' ELSE l END AS label,
 CASE WHEN bl IS NULL THEN r WHEN bl = 'VIOLATION_PRESENT' THEN br WHEN l = 'NO_VIOLATION' THEN CASE WHEN r = 'EQUAL_PD_RD' AND br = 'EQUAL_PD_RD' THEN 'EQUAL_ALL_AVAILABLE_STAGES' ELSE r END WHEN l = 'COMPARISON_IMPOSSIBLE' AND (pd IS NULL) <> (rd IS NULL) THEN CASE WHEN br = 'EQUAL_PD_RD' THEN 'EQUAL_ALL_AVAILABLE_STAGES' ELSE br END ELSE r END AS result FROM b""")
def as_built_review(spark, sf_dir):
    c = candidates(spark, sf_dir)
    s = c.groupBy("code", "chain").agg(*(F.max(F.when(F.col("stage") == x, F.col("value"))).alias(y) for x, y in (("PD", "pd"), ("RD", "rd"), ("ID", "built"))))
    every = lambda v: F.filter(F.array(v), lambda x: x.isNotNull())
    pair = lambda a, b: compare.judge("decrease", a, b, every(a), every(b))
    ref = F.coalesce("rd", "pd")
    s = s.withColumn("first", pair(F.col("pd"), F.col("rd"))).withColumn("with_built", F.when(F.col("built").isNotNull() & ref.isNotNull(), pair(ref, F.col("built"))))
    out = compare.id_review(F.col("first"), F.col("with_built"), F.col("pd").isNotNull(), F.col("rd").isNotNull())
    return s.select("code", "chain", out.alias("x")).select("code", "chain", "x.*")


@query("""WITH b AS (SELECT p_partkey AS k, p_size / 10.0 AS x0, p_size / 7.0 AS y0, p_size / 10.0 + 1 + p_partkey % 5 AS x1, p_size / 7.0 + 1 + p_partkey % 3 AS y1 FROM part),
 o AS (SELECT k, x0, y0, x1, y1, 2.0 AS a0, 3.0 AS b0, 5.0 AS a1, 5.5 AS b1 FROM b), i AS (SELECT *, greatest(least(x1, a1) - greatest(x0, a0), 0) * greatest(least(y1, b1) - greatest(y0, b0), 0) AS i FROM o)
 SELECT k, round(i / ((x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) - i), 6) AS iou FROM i""")
def box_iou(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    box = [s / 10.0, s / 7.0, s / 10.0 + 1 + k % 5, s / 7.0 + 1 + k % 3]
    return table(spark, sf_dir, "part").select(k.alias("k"), F.round(changes.iou(box, [F.lit(v) for v in (2.0, 3.0, 5.0, 5.5)]), 6).alias("iou"))


_SHEETS = """WITH r AS (SELECT user_id AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, event_id, value FROM events),
 s AS (SELECT f, page, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 11 = 0 THEN page + 3 ELSE page + 2 END AS sheet, CASE WHEN event_id % 8 = 0 THEN page + 2 WHEN event_id % 8 = 4 THEN page + 5 END AS weak FROM r)"""
_CHECKED = _SHEETS + """, o AS (SELECT *, page - sheet AS o FROM s),
 n AS (SELECT f, page, sheet, weak, o, lag(page) OVER w AS bp, lag(o) OVER w AS bo, lead(page) OVER w AS fp, lead(o) OVER w AS fo FROM o WHERE sheet IS NOT NULL WINDOW w AS (PARTITION BY f ORDER BY page)),
 c AS (SELECT f, page, o, CASE WHEN page - bp <= 5 THEN bo END AS l, CASE WHEN fp - page <= 5 THEN fo END AS r FROM n),
 d AS (SELECT f, page, CASE WHEN coalesce(l = o, false) OR coalesce(r = o, false) THEN 'CONFIRMED' WHEN coalesce(l = r, false) THEN 'CONFLICT' ELSE 'UNCONFIRMED' END AS sheet_check FROM c),
 k AS (SELECT s.f, s.page, CASE WHEN sheet_check = 'CONFLICT' THEN NULL ELSE sheet END AS sheet, weak, sheet_check FROM s LEFT JOIN d ON s.f = d.f AND s.page = d.page)"""


def _sheets(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("f"), "event_id")
    e = e.withColumn("page", F.row_number().over(Window.partitionBy("f").orderBy("event_id")).cast("long"))
    n = F.col("event_id")
    return e.select("f", "page", F.when(n % 4 == 0, None).when(n % 11 == 0, F.col("page") + 3).otherwise(F.col("page") + 2).alias("sheet"), F.when(n % 8 == 0, F.col("page") + 2).when(n % 8 == 4, F.col("page") + 5).alias("weak"))


@query(_CHECKED + " SELECT f, page, sheet, sheet_check FROM k")
def sheet_check(spark, sf_dir):
    return ordered.check(_sheets(spark, sf_dir), ["f"], "page", "sheet").select("f", "page", "sheet", "sheet_check")


@query(_CHECKED + """ SELECT k.f, k.page, CASE WHEN k.sheet IS NULL AND k.weak IS NOT NULL AND (coalesce(b.page >= k.page - 5 AND b.page - b.sheet = k.page - k.weak, false) OR coalesce(n.page <= k.page + 5 AND n.page - n.sheet = k.page - k.weak, false)) THEN k.weak ELSE k.sheet END AS sheet
 FROM k LEFT JOIN LATERAL (SELECT page, sheet FROM k b WHERE b.f = k.f AND b.page < k.page AND b.sheet IS NOT NULL ORDER BY page DESC LIMIT 1) b ON true LEFT JOIN LATERAL (SELECT page, sheet FROM k n WHERE n.f = k.f AND n.page > k.page AND n.sheet IS NOT NULL ORDER BY page LIMIT 1) n ON true""")
def weak_sheets(spark, sf_dir):
    checked = ordered.check(_sheets(spark, sf_dir), ["f"], "page", "sheet")
    return ordered.accept_weak(checked, ["f"], "page", "sheet", "weak").select("f", "page", "sheet")


@query(_CHECKED + """, a AS (SELECT f, page, page - sheet AS o, lead(page) OVER w AS np, lead(page - sheet) OVER w AS nxt FROM k WHERE sheet_check = 'CONFIRMED' WINDOW w AS (PARTITION BY f ORDER BY page))
 SELECT k.f, k.page, coalesce(k.sheet, k.page - a.o) AS sheet, k.sheet IS NULL AND a.f IS NOT NULL AS inferred FROM k LEFT JOIN a ON a.f = k.f AND k.page > a.page AND k.page < a.np AND a.o = a.nxt AND a.np - a.page <= 10 AND k.sheet IS NULL""")
def fill_gaps(spark, sf_dir):
    checked = ordered.check(_sheets(spark, sf_dir), ["f"], "page", "sheet")
    return ordered.fill(checked, ["f"], "page", "sheet", F.col("sheet_check") == "CONFIRMED").select("f", "page", "sheet", "inferred")


_WORDS = "SELECT l_suppkey AS f, l_linenumber AS page, l_quantity AS x, l_discount * 100 AS y, 'w' || CAST(l_partkey % 7 AS VARCHAR) AS t, l_orderkey AS word FROM lineitem"


def _words(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("f"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.concat(F.lit("w"), (F.col("l_partkey") % 7).cast("string")).alias("t"), F.col("l_orderkey").alias("word"))


@query(f"WITH w AS ({_WORDS}), n AS (SELECT f, count(DISTINCT page) AS pages FROM w GROUP BY f), s AS (SELECT f, t, CAST(floor(x / 5) AS BIGINT) AS i, CAST(floor(y / 5) AS BIGINT) AS j, count(DISTINCT page) AS n FROM w GROUP BY ALL) SELECT f, t, i, j, n, pages FROM s JOIN n USING (f) WHERE pages >= 3 AND n >= 0.6 * pages")
def page_furniture(spark, sf_dir):
    return spatial.furniture(_words(spark, sf_dir), ["f"], "page", 5.0)


@query(f"WITH w AS ({_WORDS}), c AS (SELECT l_suppkey AS f, l_linenumber AS page, l_orderkey AS cell, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 4 AS x1, l_discount * 100 + 3 AS y1 FROM lineitem) SELECT f, page, word, cell FROM w JOIN c USING (f, page) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def words_in_cells(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cells = li.select(F.col("l_suppkey").alias("f"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("cell"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + 4).alias("x1"), (F.col("l_discount") * 100 + 3).alias("y1"))
    return spatial.within(_words(spark, sf_dir).select("f", "page", "word", "x", "y"), cells, ["f", "page"], 8.0)


@query(f"WITH w AS (SELECT DISTINCT f, page, x, y FROM ({_WORDS})), d AS (SELECT *, CASE WHEN y - lag(y) OVER v > 1 OR lag(y) OVER v IS NULL THEN 1 ELSE 0 END AS new FROM w WINDOW v AS (PARTITION BY f, page ORDER BY y, x)) SELECT f, page, x, y, CAST(sum(new) OVER (PARTITION BY f, page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM d")
def word_lines(spark, sf_dir):
    return spatial.lines(_words(spark, sf_dir).select("f", "page", "x", "y").distinct(), ["f", "page"], 1.0)


@query(f"""WITH w AS (SELECT f, page, t || '-' || (word % 11) AS t, x, y FROM ({_WORDS})), n AS (SELECT f, page, t, x + 5 AS x, y + t.len AS y FROM (SELECT *, length(t) AS len FROM w) t),
 k AS (SELECT f, page, t FROM w GROUP BY ALL HAVING count(*) <= 3), o AS (SELECT w.* FROM w JOIN k USING (f, page, t)), p AS (SELECT n.* FROM n JOIN k USING (f, page, t))
 SELECT f, page, CAST(round((p.x - o.x) / 2) AS BIGINT) AS dx, CAST(round((p.y - o.y) / 2) AS BIGINT) AS dy, count(*) AS votes FROM p JOIN o USING (f, page, t) GROUP BY ALL""")
def page_displacement(spark, sf_dir):
    w = _words(spark, sf_dir).select("f", "page", F.concat("t", F.lit("-"), F.col("word") % 11).alias("t"), "x", "y")
    moved = w.withColumn("x", F.col("x") + 5).withColumn("y", F.col("y") + F.char_length("t"))
    return spatial.displacement(w, moved, ["f", "page"], 2.0)

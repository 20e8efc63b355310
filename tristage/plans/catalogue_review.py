"""Queries of language functions and of what follows a decision, in the manner of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions import language as L
from tristage.operators import review
from tristage.operators.compare import IMPOSSIBLE, OK, VIOLATION
from tristage.plans.catalogue import pages, query, table


def _case(key: str, some: list[str]) -> str:
    """SQL of both engines: one of some expressions by key."""
    return f"CASE {key} % {len(some)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(some)) + " END"


def _parts(spark, sf_dir, **columns):
    p = pages(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("int").alias("a"))
    return p.select("k", *(F.expr(sql).alias(name) for name, sql in columns.items()))


def _from(**columns: str) -> str:
    return "(SELECT k, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM (SELECT p_partkey AS k, CAST(p_size AS INTEGER) AS a FROM part))"


_PHRASE = _case("k", ["'Тёплые полы с ограждениями'", "'тёплый пол — ограждение'", "'монтаж армированных конструкций'", "'Полов нет, сталь ' || a", "'дом'", "NULL"])
_ENDING = "|".join(sorted(L.ENDINGS, key=len, reverse=True))
def _stems(text: str) -> str:
    folded = f"translate(lower(coalesce({text}, '')), 'ё‐‑–—', 'е----')"
    return f"list_distinct(list_transform(regexp_extract_all({folded}, '[0-9a-zа-я]+'), lambda w: regexp_replace(w, '^(.{{3,}}?)(?:{_ENDING})$', '\\1')))"


@query(f"SELECT k, array_to_string(list_sort({_stems('t')}), ' ') AS stems, list_has_all({_stems('t')}, ['тепл', 'пол']) AS floor, list_has_all({_stems('t')}, ['тепл', 'пол']) OR list_has_all({_stems('t')}, ['ограждени']) AS term FROM {_from(t=_PHRASE)}")
def word_stems(spark, sf_dir):
    s = _parts(spark, sf_dir, t=_PHRASE).withColumn("s", L.stems(F.col("t")))
    variants = F.array(F.lit("тёплых полах"), F.lit("ограждениями"))
    return s.select("k", F.array_join(F.array_sort("s"), " ").alias("stems"), L.variant_matches(F.lit("тёплый пол"), F.col("s")).alias("floor"), L.term_matches(variants, F.col("s")).alias("term"))


_UNIT = _case("k", ["'мм'", "' М. '", "'кв.м'", "'метров'", "'дюйм'", "'л/сек'", "'куб.м.'", "'кг'", "NULL"])
_WANT = _case("k", ["'м'", "'см'", "'га'", "'м'", "'м'", "'м³/ч'", "'л'", "'тонн'", "'м'"])


@query(f"""SELECT k, CASE k % 9 WHEN 0 THEN 'мм' WHEN 1 THEN 'м' WHEN 2 THEN 'м²' WHEN 3 THEN 'м' WHEN 5 THEN 'л/с' WHEN 6 THEN 'м³' WHEN 7 THEN 'кг' END AS unit,
 CASE k % 9 WHEN 0 THEN 'length' WHEN 1 THEN 'length' WHEN 2 THEN 'area' WHEN 3 THEN 'length' WHEN 5 THEN 'flow_sec' WHEN 6 THEN 'volume' WHEN 7 THEN 'mass' END AS dimension,
 CASE k % 9 WHEN 0 THEN round(a * 0.001::DOUBLE / 1.0, 6) WHEN 1 THEN round(a * 1.0::DOUBLE / 0.01, 6) WHEN 2 THEN round(a * 1.0::DOUBLE / 10000.0, 6) WHEN 3 THEN a::DOUBLE WHEN 6 THEN round(a * 1.0::DOUBLE / 0.001, 6) WHEN 7 THEN round(a * 0.001::DOUBLE / 1.0, 6) END AS converted,
 coalesce(CASE k % 9 WHEN 0 THEN a < 10 WHEN 1 THEN a > 100 WHEN 2 THEN a < 0.1 WHEN 3 THEN a > 100 WHEN 6 THEN a < 0.01 END, false) AS implausible FROM {_from(a="a")}""")
def unit_conversion(spark, sf_dir):
    p = _parts(spark, sf_dir, a="a", u=_UNIT, w=_WANT)
    unit = L.canon(F.col("u"))
    return p.select("k", unit.alias("unit"), L.dimension(unit).alias("dimension"), L.convert(F.col("a").cast("double"), F.col("u"), F.col("w")).alias("converted"), L.implausible(F.col("a").cast("double"), F.col("u")).alias("implausible"))


_BROKEN = _case("k", ["'Áåòîí êëàññà ' || a", "'Áåòîí B' || a", "'Кирпич М' || a", "'Ïëàí ýòàæà ¨ëêà ' || a || ' ïîë'"])


@query(f"SELECT k, CASE k % 4 WHEN 0 THEN 'Бетон класса ' || a WHEN 1 THEN 'Áåòîí B' || a WHEN 2 THEN 'Кирпич М' || a ELSE 'План этажа Ёлка ' || a || ' пол' END AS text, CASE k % 4 WHEN 0 THEN 2 WHEN 3 THEN 4 ELSE 0 END AS n FROM {_from(a='a')}")
def mended_pages(spark, sf_dir):
    return _parts(spark, sf_dir, t=_BROKEN).select("k", L.mend(F.col("t")).alias("m")).select("k", "m.*")


_CODE = _case("k", ["'12 - AР.' || a", "'12 / AP-' || a", "'КЖ1.' || a", "NULL"])
_ROOM = _case("k", ["'00' || a", "'0' || a || '.05'", "a || 'а'"])


@query(f"SELECT k, regexp_replace(translate(upper(coalesce(c, '')), 'ABCEHKMOPTXY', 'АВСЕНКМОРТХУ'), '[\\s.,/-]+', '', 'g') AS code, regexp_replace(r, '^0+([0-9])', '\\1') AS room FROM {_from(c=_CODE, r=_ROOM)}")
def document_codes(spark, sf_dir):
    p = _parts(spark, sf_dir, c=_CODE, r=_ROOM)
    return p.select("k", L.code(F.col("c")).alias("code"), L.room_number(F.col("r")).alias("room"))


@query("""SELECT conv_id, turn, len(l) AS n, coalesce(array_to_string(l, '|'), '') AS lines FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM conversations)""")
def page_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", L.page_lines(F.col("text")).alias("l"))
    return c.select("conv_id", "turn", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("lines"))


_REF = _case("k", ["'70.13330.20' || (10 + a % 20)", "'12-03-2001'", "'3262-' || (10 + a % 90)", "'21.1101'", "'2.1.3684-21'"])
_REF_B = _case("k", ["'70.1330.20' || (10 + a % 20)", "'12-04-2001'", "'3262-75'", "'21.110'", "'2.1.3684-' || (20 + a % 3)"])
def _year(y: str) -> str:
    return f"CASE WHEN {y} = '' THEN NULL WHEN length({y}) = 4 THEN CAST({y} AS INTEGER) WHEN CAST({y} AS INTEGER) < 30 THEN 2000 + CAST({y} AS INTEGER) ELSE 1900 + CAST({y} AS INTEGER) END"


def _tail(number: str, group: int) -> str:
    return f"regexp_extract({number}, '^(.*?)[.\\-/]((?:19|20)[0-9]{{2}}|[0-9]{{2}})$', {group})"




@query(f"""WITH s AS (SELECT k, a, b, {_tail('a', 2)} AS ya, {_tail('b', 2)} AS yb FROM {_from(a=_REF, b=_REF_B)}),
 n AS (SELECT k, CASE WHEN ya = '' THEN a ELSE {_tail('a', 1)} END AS na, CASE WHEN yb = '' THEN b ELSE {_tail('b', 1)} END AS nb, {_year('ya')} AS year_a, {_year('yb')} AS year_b FROM s),
 d AS (SELECT *, na = nb AS same, k % 5 IN (0, 3) AND na <> nb AS typo FROM n)
 SELECT k, na AS number, year_a AS year, CASE WHEN NOT same AND NOT typo THEN 'OTHER_DOCUMENT' WHEN year_a IS NULL OR year_b IS NULL THEN 'NO_EDITION' WHEN year_a <> year_b THEN 'OTHER_EDITION' WHEN typo THEN 'TYPO' ELSE 'EXACT' END AS verdict FROM d""")
def norm_editions(spark, sf_dir):
    p = _parts(spark, sf_dir, a=_REF, b=_REF_B)
    (na, ya), (nb, yb) = L.split_year(F.col("a")), L.split_year(F.col("b"))
    kind = F.lit("СП")
    return p.select("k", na.alias("number"), ya.alias("year"), L.compare_references(kind, na, ya, kind, nb, yb).alias("verdict"))


_V = _case("k", ["'PENDING'", "'CONFIRMED_VIOLATION'", "'NEGATIVE_VERIFIED'", "'CLARIFICATION_REQUIRED'", "'SPLIT'", "'NOT_REQUIRED'", "'PENDING'"])
_LABEL = _case("a", [f"'{VIOLATION}'", f"'{OK}'", f"'{IMPOSSIBLE}'", "'MISSING_DOCUMENT'", "NULL"])
_RECORD = {"section": "a % 6", "verification": _V, "label": _LABEL, "hypothesis": "k % 11 = 0", "changed": "a % 3 = 0", "pd": _case("k", ["'1'", "''", "NULL"]), "rd": _case("a", ["'2'", "NULL"]), "action": _case("k", ["'RESET'", "'DISPUTE'", "'PROMOTE'", "'CONFIRM'"]), "process": _case("a", ["'COMPLETED'", "'VERIFYING'", "'VERIFYING'"])}
_RECORDS = _from(**_RECORD)
_D = "('CONFIRMED_VIOLATION', 'NEGATIVE_VERIFIED', 'CLARIFICATION_REQUIRED')"


@query(f"""WITH c AS (SELECT section, count(*) AS total, count(*) FILTER (verification NOT IN ('NOT_REQUIRED', 'SPLIT') AND NOT (hypothesis AND verification = 'PENDING')) AS candidates, count(*) FILTER (verification = 'PENDING' AND NOT hypothesis) AS pending,
 count(*) FILTER (verification = 'PENDING' AND hypothesis) AS hypotheses, count(*) FILTER (verification = 'CONFIRMED_VIOLATION') AS confirmed, count(*) FILTER (verification = 'NEGATIVE_VERIFIED') AS rejected, count(*) FILTER (verification = 'CLARIFICATION_REQUIRED') AS clarification,
 count(*) FILTER (verification = 'SPLIT') AS split, count(*) FILTER (verification = 'NOT_REQUIRED' AND label = '{OK}') AS no_violation, count(*) FILTER (verification = 'NOT_REQUIRED' AND label IN ('{IMPOSSIBLE}', 'MISSING_DOCUMENT')) AS not_comparable, count(*) FILTER (changed AND verification IN {_D}) AS revisit FROM {_RECORDS} GROUP BY section)
 SELECT *, CASE WHEN confirmed + rejected + clarification = 0 AND split = 0 THEN 'READY' WHEN pending = 0 THEN 'COMPLETED' ELSE 'VERIFYING' END AS status FROM c""")
def record_counts(spark, sf_dir):
    c = review.counts(_parts(spark, sf_dir, **_RECORD), ["section"])
    return c.withColumn("status", review.settle(*(F.col(x) for x in ("confirmed", "rejected", "clarification", "split", "pending"))))


@query(f"""SELECT k, CASE WHEN process = 'COMPLETED' AND action NOT IN ('RESET', 'DISPUTE') THEN 'VERIFICATION_COMPLETED' WHEN action = 'DISPUTE' THEN CASE WHEN verification <> 'NOT_REQUIRED' OR label IS DISTINCT FROM '{OK}' THEN 'NOT_AUTO_NEGATIVE' END WHEN verification = 'NOT_REQUIRED' THEN 'NOT_A_CANDIDATE' WHEN verification = 'SPLIT' THEN 'FINDING_SPLIT'
 WHEN hypothesis AND action <> 'PROMOTE' THEN 'HYPOTHESIS_NOT_CANDIDATE' WHEN NOT hypothesis AND action = 'PROMOTE' THEN 'NOT_A_HYPOTHESIS' WHEN action = 'RESET' AND verification NOT IN {_D} AND NOT changed THEN 'NOT_DECIDED' END AS refusal FROM {_RECORDS}""")
def decision_guard(spark, sf_dir):
    r = _parts(spark, sf_dir, **_RECORD)
    return r.select("k", review.refusal(*(F.col(c) for c in ("action", "process", "verification", "label", "hypothesis", "changed"))).alias("refusal"))


_NO_VALUE = "(coalesce(pd, '') = '' OR coalesce(rd, '') = '')"
_ABSENT = f"CASE WHEN label IN ('{VIOLATION}', '{OK}') THEN NULL WHEN coalesce(pd, '') = '' AND NOT list_contains(present, 'PD') THEN 'PD' WHEN coalesce(rd, '') = '' AND NOT list_contains(present, 'RD') THEN 'RD' END"


@query(f"""WITH p AS (SELECT *, CASE section WHEN 0 THEN ['PD'] WHEN 1 THEN ['RD'] ELSE ['PD', 'RD'] END AS present FROM {_RECORDS}), s AS (SELECT *, {_ABSENT} AS stage, CASE WHEN label IN ('{VIOLATION}', '{OK}') THEN 'COMPLETE' WHEN {_ABSENT} IS NOT NULL OR label = 'MISSING_DOCUMENT' OR {_NO_VALUE} THEN 'MISSING_EVIDENCE' ELSE 'NOT_COMPARABLE' END AS completeness FROM p)
 SELECT k, CASE WHEN stage IS NOT NULL THEN 'MISSING_DOCUMENT' ELSE label END AS violation_label, stage || '_MISSING' AS protocol_status, completeness,
 CASE WHEN label = 'MISSING_DOCUMENT' THEN 'MISSING_EVIDENCE' WHEN label = '{IMPOSSIBLE}' THEN CASE WHEN changed THEN 'MISSING_EVIDENCE' ELSE 'NOT_COMPARABLE' END ELSE 'CANDIDATE' END AS finding_status,
 CASE WHEN hypothesis AND NOT changed THEN 'SUSPICION' WHEN label = '{VIOLATION}' THEN CASE WHEN verification IN {_D} THEN verification ELSE 'CANDIDATE' END WHEN label = '{OK}' THEN 'NEGATIVE_VERIFIED' WHEN completeness = 'NOT_COMPARABLE' THEN 'NOT_COMPARABLE' ELSE 'MISSING_EVIDENCE' END AS shown,
 CASE WHEN label IN ('{VIOLATION}', '{OK}') THEN CASE WHEN section = 0 THEN 'LOW' WHEN section = 1 THEN 'MEDIUM' ELSE 'HIGH' END END AS confidence FROM s""")
def record_states(spark, sf_dir):
    marks = F.when(F.col("section") == 0, F.array(F.lit("PD_UPLOADED"), F.lit("RD_MISSING"))).when(F.col("section") == 1, F.array(F.lit("RD_PARTIAL"))).otherwise(F.array(F.lit("PD_PARTIAL"), F.lit("RD_UPLOADED")))
    r = _parts(spark, sf_dir, **_RECORD).withColumn("present", review.stages_present(marks))
    label, pd, rd, present = (F.col(c) for c in ("label", "pd", "rd", "present"))
    whole = review.completeness(label, pd, rd, present)
    shown = review.view_status(label, F.col("verification"), F.col("hypothesis"), F.col("changed"), whole)
    low, medium = (F.when(F.col("section") == i, 1).otherwise(0) for i in (0, 1))
    out = r.select("k", review.mark_absent(label, pd, rd, present).alias("m"), whole.alias("completeness"), review.finding_status(label, F.lit(None).cast("string"), F.col("changed")).alias("finding_status"), shown.alias("shown"), review.confidence(label, low, medium).alias("confidence"))
    return out.select("k", "m.*", "completeness", "finding_status", "shown", "confidence")


_OLD = {"label": _LABEL, "pd": "CAST(a AS STRING)", "rd": "CAST(a + 1 AS STRING)", "verification": _V, "origin": _case("a", ["'INSPECTOR_SPLIT'", "'RUN'", "'RUN'"]), "mark": _case("k", ["'promoted_at'", "'changed_after_decision'", "'other'", "'reopened'", "'disputed_at'", "NULL"])}
_NEW = {"label": _case("k", [f"'{VIOLATION}'", f"'{OK}'"]), "pd": "CAST(a AS STRING)", "rd": "CAST(a + 2 AS STRING)", "candidate": "k % 2 = 0"}


@query(f"""WITH o AS (SELECT * FROM {_from(**_OLD)} WHERE k % 7 <> 0), n AS (SELECT *, CASE WHEN candidate THEN 'PENDING' ELSE 'NOT_REQUIRED' END AS v FROM {_from(**_NEW)} WHERE k % 5 <> 0),
 b AS (SELECT coalesce(o.k, n.k) AS k, o.k IS NOT NULL AS was, n.k IS NOT NULL AS here, o.label AS ol, n.label AS nl, o.pd AS op, n.pd AS np, o.rd AS orr, n.rd AS nr, verification AS ov, v, origin, mark, v = 'NOT_REQUIRED' AND verification IN ('CONFIRMED_VIOLATION', 'CLARIFICATION_REQUIRED') AS reopens FROM o FULL JOIN n ON o.k = n.k)
 SELECT k, CASE WHEN here THEN nl ELSE ol END AS label, CASE WHEN here THEN np ELSE op END AS pd, CASE WHEN here THEN nr ELSE orr END AS rd, origin,
 CASE WHEN NOT was THEN v WHEN NOT here THEN ov WHEN ov = 'SPLIT' THEN 'SPLIT' WHEN mark = 'disputed_at' THEN 'PENDING' WHEN reopens THEN 'PENDING' WHEN mark = 'reopened' AND ov = 'PENDING' THEN 'PENDING' WHEN v = 'NOT_REQUIRED' THEN 'NOT_REQUIRED' WHEN ov = 'NOT_REQUIRED' THEN 'PENDING' ELSE ov END AS verification,
 CASE WHEN NOT here THEN coalesce(mark, '') ELSE array_to_string(list_sort(list_filter([CASE WHEN mark IN ('promoted_at', 'disputed_at') OR mark = 'changed_after_decision' AND ov IN {_D} AND v <> 'NOT_REQUIRED' OR mark = 'reopened' AND ov = 'PENDING' AND NOT coalesce(reopens, false) THEN mark END, CASE WHEN reopens THEN 'reopened' END], lambda x: x IS NOT NULL)), ',') END AS marks
 FROM b WHERE here OR origin = 'INSPECTOR_SPLIT'""")
def merged_findings(spark, sf_dir):
    old = _parts(spark, sf_dir, **_OLD).where("k % 7 <> 0")
    marks = F.when(F.col("mark").isNotNull(), F.create_map("mark", F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    out = review.merge(old.withColumn("marks", marks), _parts(spark, sf_dir, **_NEW).where("k % 5 <> 0"), ["k"])
    return out.withColumn("marks", F.array_join(F.array_sort(F.map_keys("marks")), ","))


@query(f"""WITH s AS (SELECT section, list(DISTINCT CASE WHEN label = '{VIOLATION}' THEN CASE WHEN verification IN {_D} THEN verification ELSE 'CANDIDATE' END ELSE 'NEGATIVE_VERIFIED' END) AS s, max(a0) AS criticality FROM (SELECT *, {_case('section', ["'Критическое нарушение'", "'Существенное'", "'Иное'"])} AS a0 FROM (SELECT *, k % 60 AS cell FROM {_RECORDS}) WHERE cell >= 0) GROUP BY section)
 SELECT section, CASE WHEN section = 5 THEN 'NOT_CHECKED' WHEN list_contains(s, 'CONFIRMED_VIOLATION') THEN 'VIOLATION' WHEN list_has_any(s, ['CANDIDATE', 'CLARIFICATION_REQUIRED']) THEN 'CANDIDATE' ELSE 'CLEAN' END AS state, CASE section % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM s""")
def dashboard_cells(spark, sf_dir):
    r = _parts(spark, sf_dir, **_RECORD)
    status = review.view_status(F.col("label"), F.col("verification"), F.lit(False), F.lit(False), F.lit(""))
    s = r.groupBy("section").agg(F.collect_set(F.when(F.col("label") == VIOLATION, status).otherwise("NEGATIVE_VERIFIED")).alias("s"))
    criticality = F.expr(_case("section", ["'Критическое нарушение'", "'Существенное'", "'Иное'"]))
    return s.select("section", review.cell(F.col("section") != 5, F.col("s"), F.lit("NOT_CHECKED")).alias("state"), review.priority(criticality).alias("priority"))


_CHAIN = "SELECT o_custkey AS chain, o_orderkey AS file, o_orderdate AS rank, o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS approved, o_orderkey % 17 = 0 AS chosen FROM orders"


def _chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("file"), F.struct("o_orderdate", "o_orderkey").alias("rank"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0)).alias("approved"), (F.col("o_orderkey") % 17 == 0).alias("chosen"))


@query(f"WITH c AS ({_CHAIN}), r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY rank DESC, file DESC) AS r, max(CAST(approved AS INTEGER)) OVER (PARTITION BY chain) AS held FROM c) SELECT chain, file AS latest, CASE WHEN approved OR held = 0 THEN 'RESOLVED' ELSE 'CLARIFICATION_REQUIRED' END AS status FROM r WHERE r = 1")
def approval_gate(spark, sf_dir):
    return review.approval(_chain(spark, sf_dir), ["chain"], "rank")


@query(f"WITH c AS ({_CHAIN}), t AS (SELECT chain, file AS top FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY rank DESC, file DESC) AS r FROM c WHERE chosen) WHERE r = 1) SELECT chain, file, CASE WHEN file = top THEN 'CURRENT' WHEN top IS NOT NULL THEN 'SUPERSEDED' END AS member_status FROM c LEFT JOIN t USING (chain)")
def manual_choice(spark, sf_dir):
    return review.choose(_chain(spark, sf_dir), ["chain"], "rank").select("chain", "file", "member_status")


@query("SELECT o_custkey, CAST(coalesce(max(o_orderkey % 50), 0) + 1 AS BIGINT) AS next_version FROM orders GROUP BY o_custkey")
def version_append(spark, sf_dir):
    return review.next_version(table(spark, sf_dir, "orders").withColumn("version", F.col("o_orderkey") % 50), ["o_custkey"])


@query("WITH c AS (SELECT l_orderkey AS file, l_linenumber % 2 AS key, l_quantity AS value, l_tax > 0.05 AS strong FROM lineitem), m AS (SELECT *, bool_or(strong) OVER (PARTITION BY file, key) AS held FROM c) SELECT file, key, value, strong FROM m WHERE strong OR NOT held")
def strong_statements(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") % 2).alias("key"), F.col("l_quantity").alias("value"), (F.col("l_tax") > 0.05).alias("strong"))
    return review.strong_first(c, ["file", "key"], "strong").select("file", "key", "value", "strong")


@query("WITH n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, l_suppkey % 3 AS value, count(DISTINCT l_linenumber) AS readings FROM lineitem GROUP BY ALL) SELECT l_orderkey, value, readings, n = 1 OR readings >= 2 AS accepted FROM s JOIN n USING (l_orderkey)")
def reading_votes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("value"))
    return review.agreed(rows, ["l_orderkey"], "l_linenumber", "value")


@query("WITH b AS (SELECT p_brand, p_name, p_size * 100 AS w, p_size * 50 AS h, max(p_partkey % 9 + 1) AS n FROM part GROUP BY ALL) SELECT p_brand, CAST(sum(n) AS BIGINT) AS windows, round(sum(n * w * h) / 1e6, 2) AS area FROM b GROUP BY p_brand")
def window_totals(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("mark"), (F.col("p_size") * 100).alias("w"), (F.col("p_size") * 50).alias("h"), (F.col("p_partkey") % 9 + 1).alias("n"))
    return review.window_totals(p, ["p_brand"])


@query("WITH c AS (SELECT p_partkey AS k, p_brand AS object, p_type || ' ' || p_name AS model, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size % 2 END AS zone FROM part), z AS (SELECT object, model, min(zone) AS a FROM c WHERE zone IS NOT NULL GROUP BY ALL HAVING min(zone) = max(zone)) SELECT k, object, model, coalesce(zone, a) AS zone FROM c LEFT JOIN z USING (object, model)")
def adopted_zones(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("object"), F.concat("p_type", F.lit(" "), "p_name").alias("model"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") % 2).alias("zone"))
    return review.one_zone(c, ["object"], "model", "zone").select("k", "object", "model", "zone")


@query("""WITH r AS (SELECT l_orderkey AS sheet, 'K-' || CAST(l_linenumber AS VARCHAR) AS mark, l_quantity - 25 AS v FROM lineitem), m AS (SELECT o_orderkey AS sheet, max(o_orderkey % 20 + 1) AS "limit" FROM orders GROUP BY 1)
 SELECT sheet, regexp_replace(mark, '[^0-9]', '', 'g') AS digits, v, min(mark) AS mark, max("limit") AS "limit" FROM r JOIN m USING (sheet) WHERE abs(v) > "limit" GROUP BY ALL""")
def tolerance_excesses(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.concat(F.lit("K-"), F.col("l_linenumber").cast("string")).alias("mark"), (F.col("l_quantity") - 25).alias("v"))
    limits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sheet"), (F.col("o_orderkey") % 20 + 1).alias("limit"))
    return review.excesses(rows, limits, ["sheet"])


_FILES = "SELECT o_custkey AS process, CASE o_orderkey % 5 WHEN 0 THEN 'RD_ID_MIXED' WHEN 1 THEN 'PD' WHEN 2 THEN 'RD' WHEN 3 THEN 'ID' ELSE 'UNKNOWN' END AS stage, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 3 = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN '.SIG' ELSE '.pdf' END AS extension FROM orders"
_COUNTED = f"WITH f AS ({_FILES}), e AS (SELECT process, unnest(CASE WHEN stage = 'RD_ID_MIXED' THEN ['RD', 'ID'] ELSE [stage] END) AS stage, status, extension FROM f), c AS (SELECT process, stage, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status <> 'ACCEPTED' AND lower(extension) <> '.sig') AS rejected, count(*) FILTER (status <> 'ACCEPTED' AND lower(extension) = '.sig') AS signatures FROM e WHERE stage <> 'UNKNOWN' GROUP BY ALL)"


def _files(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stage = F.when(k % 5 == 0, "RD_ID_MIXED").when(k % 5 == 1, "PD").when(k % 5 == 2, "RD").when(k % 5 == 3, "ID").otherwise("UNKNOWN")
    return o.select(F.col("o_custkey").alias("process"), stage.alias("stage"), F.when((F.col("o_orderstatus") == "F") | (k % 3 == 0), "ACCEPTED").otherwise("REJECTED").alias("status"), F.when(k % 4 == 0, ".SIG").otherwise(".pdf").alias("extension"))


@query(_COUNTED + " SELECT * FROM c")
def stage_file_counts(spark, sf_dir):
    return review.file_counts(_files(spark, sf_dir), ["process"])


@query(_COUNTED + """, s AS (SELECT process, list(stage) FILTER (accepted > 0) AS have, bool_or(accepted > 0 AND rejected > 0) AS partial, list(stage) FILTER (accepted > 0 AND rejected > 0) AS p FROM c GROUP BY process)
 SELECT process, array_to_string(list_transform(['PD', 'RD', 'ID'], lambda x: x || CASE WHEN NOT list_contains(coalesce(have, []), x) THEN '_MISSING' WHEN list_contains(coalesce(p, []), x) THEN '_PARTIAL' ELSE '_UPLOADED' END), ',') AS statuses,
 CASE WHEN partial THEN 'PARTIALLY_LOADED' WHEN len(have) = 3 THEN 'FULL' WHEN len(have) = 2 THEN array_to_string(list_filter(['PD', 'RD', 'ID'], lambda x: list_contains(have, x)), '_') || '_ONLY' WHEN len(have) = 1 THEN 'SINGLE_ONLY' END AS scenario FROM s""")
def upload_status(spark, sf_dir):
    out = review.upload_status(review.file_counts(_files(spark, sf_dir), ["process"]), ["process"])
    return out.withColumn("statuses", F.array_join("statuses", ","))


@query('SELECT lang, source, count(*) AS documents, count(DISTINCT text) AS "distinct", CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY ALL')
def registry_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", F.sha2("text", 256).alias("digest"), "n_chars")
    return review.registry_summary(d, ["lang", "source"], "digest", "n_chars")

"""Queries of editions and of their pages, in the manner of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions import text as T
from tristage.operators import alignment, revisions
from tristage.plans.catalogue import pages, query, table

_MARKS = {
    "archive": "o_orderstatus = 'F' AND o_orderkey % 5 = 0",
    "year": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 2020 + o_custkey % 2 END",
    "issue_corr": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END",
    "correction": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 3 END",
    "correction_sub": "o_orderkey % 2",
    "gip": "0",
    "change": "o_orderkey % 3",
    "version": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 END",
    "date": "CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate END",
}
_SIGN = "CASE WHEN {0} > {1} THEN 1 WHEN {0} < {1} THEN -1 {2}END"
_LEVEL = "(coalesce({0}.correction, 0) * 1000 + coalesce({0}.correction_sub, 0) * 10 + coalesce({0}.gip, 0))"
_ISSUE = f"CASE WHEN a.archive AND NOT b.archive THEN -1 WHEN NOT a.archive AND b.archive THEN 1 ELSE coalesce({_SIGN.format('a.year', 'b.year', '')}, CASE WHEN a.year IS NOT DISTINCT FROM b.year THEN {_SIGN.format('a.issue_corr', 'b.issue_corr', '')} END) END"
_PAIRS = (
    "WITH m AS (SELECT o_custkey AS chain, o_orderkey AS file, " + ", ".join(f"{sql} AS {k}" for k, sql in _MARKS.items()) + " FROM orders),"
    f" p AS (SELECT a.chain, a.file, {_ISSUE} AS i, {_SIGN.format(_LEVEL.format('a'), _LEVEL.format('b'), 'ELSE 0 ')} AS c, {_SIGN.format('coalesce(a.change, 0)', 'coalesce(b.change, 0)', 'ELSE 0 ')} AS h,"
    f" {_SIGN.format('coalesce(a.version, 0)', 'coalesce(b.version, 0)', 'ELSE 0 ')} AS v, {_SIGN.format('a.date', 'b.date', '')} AS d FROM m a JOIN m b ON a.chain = b.chain AND a.file <> b.file),"
    " r AS (SELECT *, CASE WHEN c <> 0 THEN c WHEN h <> 0 THEN h ELSE v END AS marks FROM p),"
    " o AS (SELECT chain, file, i, coalesce(i, CASE WHEN c <> 0 AND h <> 0 AND c <> h THEN NULL WHEN d IS NULL THEN marks WHEN marks = 0 THEN d WHEN marks = d THEN marks END) AS o FROM r),"
    " e AS (SELECT m.chain, m.file, count(*) FILTER (o = -1) AS later, count(*) FILTER (o.file IS NOT NULL AND (o IS NULL OR o = 0)) AS open, coalesce(bool_or(i = -1), false) AS older FROM m LEFT JOIN o ON m.chain = o.chain AND m.file = o.file GROUP BY ALL),"
    " t AS (SELECT chain, count(*) FILTER (later = 0) AS tops, max(open) FILTER (later = 0) AS blocked FROM e GROUP BY chain)"
)


@query(_PAIRS + " SELECT chain, file, CASE WHEN tops = 1 AND blocked = 0 THEN CASE WHEN later = 0 THEN 'CURRENT' ELSE 'SUPERSEDED' END WHEN older THEN 'SUPERSEDED' ELSE 'CLARIFICATION_REQUIRED' END AS status, CASE WHEN tops = 1 AND blocked = 0 THEN later END AS place FROM e JOIN t USING (chain)")
def edition_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("file"), *(F.expr(sql).alias(k) for k, sql in _MARKS.items()))
    return revisions.resolve(m, ["chain"], "file")


_TURNS = "SELECT conv_id AS v, turn AS p, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda x: x <> '')) AS w FROM conversations"


def _turns(spark, sf_dir, odd):
    c = pages(spark, sf_dir, "conversations", "conv_id", "turn").select(F.col("conv_id").alias("v"), F.col("turn").alias("p"), T.word_set(F.col("text")).alias("w"))
    return c.where((F.col("p") % 2 == 1) == F.lit(odd)) if odd is not None else c


@query(f"WITH s AS ({_TURNS}), o AS (SELECT v, p AS i, w FROM s WHERE p % 2 = 0), n AS (SELECT v, p AS j, w FROM s WHERE p % 2 = 1) SELECT v, i, j, round(len(list_intersect(o.w, n.w)) / len(list_distinct(list_concat(o.w, n.w))), 6) AS similarity FROM o JOIN n USING (v) WHERE len(list_intersect(o.w, n.w)) > 0 AND len(list_intersect(o.w, n.w)) / len(list_distinct(list_concat(o.w, n.w))) >= 0.05")
def similar_pages(spark, sf_dir):
    out = alignment.similar_pages(_turns(spark, sf_dir, False), _turns(spark, sf_dir, True), ["v"], "p", "w", 0.05)
    return out.withColumn("similarity", F.round("similarity", 6))


def aligned_pages(spark, sf_dir):
    """A heaviest chain has no plain SQL; tests hold it against the table of all prefixes."""
    pairs = alignment.similar_pages(_turns(spark, sf_dir, False), _turns(spark, sf_dir, True), ["v"], "p", "w", 0.05)
    return alignment.align(pairs, ["v"])


query()(aligned_pages)


@query(f"WITH s AS ({_TURNS}), o AS (SELECT v, p AS i, w FROM s WHERE p % 2 = 0), n AS (SELECT v, p AS j, w FROM s WHERE p % 2 = 1), b AS (SELECT coalesce(o.v, n.v) AS v, i, j, o.w AS ow, n.w AS nw FROM o FULL JOIN n ON o.v = n.v AND n.j = o.i + 1) SELECT v, i, j, CASE WHEN ow IS NULL THEN 'ADDED' WHEN nw IS NULL THEN 'REMOVED' WHEN len(list_intersect(ow, nw)) < len(ow) OR len(list_intersect(ow, nw)) < len(nw) THEN 'CHANGED' ELSE 'SAME' END AS state, CASE WHEN ow IS NULL OR nw IS NULL THEN 0 ELSE len(nw) - len(list_intersect(ow, nw)) END AS came, CASE WHEN ow IS NULL OR nw IS NULL THEN 0 ELSE len(ow) - len(list_intersect(ow, nw)) END AS went FROM b")
def page_states(spark, sf_dir):
    old, new = _turns(spark, sf_dir, False), _turns(spark, sf_dir, True)
    aligned = old.select("v", F.col("p").alias("i"), (F.col("p") + 1).alias("j"))
    return alignment.page_states(old, new, aligned.join(new.select("v", F.col("p").alias("j")), ["v", "j"]), ["v"], "p", "w")


_NAMES = ["'Том 5_изм. ' || (a % 30 + 1) || ' корр. ' || (a % 9) || '.pdf'", "'КЖ1 корр. ГИП 2023-05-' || (10 + a % 20) || ' (2).PDF'", "'АР изм. по замечаниям от 05.0' || (a % 9 + 1) || '.24 ЭЦП.pdf.docx'", "'ОВ в.' || (a % 40) || ' 45132023.xlsx'", "'plan rev.' || (a % 20) || ' в производство'", "'Поверка изм2023 МГЭ 01022022.doc'"]


@query("""SELECT k, CASE k % 6 WHEN 0 THEN a % 9 END AS correction, k % 6 = 1 AS gip, k % 6 = 2 AS by_comments, CASE k % 6 WHEN 0 THEN a % 30 + 1 END AS change, CASE k % 6 WHEN 3 THEN a % 40 WHEN 4 THEN a % 20 END AS version,
 CASE k % 6 WHEN 1 THEN '2023-05-' || (10 + a % 20) WHEN 2 THEN '2024-0' || (a % 9 + 1) || '-05' WHEN 5 THEN '2022-02-01' END AS date, CASE k % 6 WHEN 1 THEN 2 END AS copy, CASE k % 6 WHEN 2 THEN 'E_SIGNATURE' WHEN 4 THEN 'ISSUED_FOR_CONSTRUCTION' WHEN 5 THEN 'STATE_EXPERTISE' END AS approval FROM (SELECT p_partkey AS k, CAST(p_size AS INTEGER) AS a FROM part)""")
def name_marks(spark, sf_dir):
    p = pages(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("int").alias("a"))
    name = "CASE k % 6 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_NAMES)) + " END"
    return p.select("k", revisions.name_marks(F.expr(name)).alias("m")).select("k", "m.*")

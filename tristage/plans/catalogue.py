"""Every query of the engine's own operators, with SQL that gives the same rows.

The tables at hand have no construction stages, so views lend them: a line item is a candidate, its part's brand the
parameter, its return flag the stage (A design, R working, N as-built), order and line number its file and page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tristage.functions import text as T
from tristage.operators import compare, incremental, joins, ordered, project, resolve, voting
from tristage.sources import registry
from tristage.streaming import upserts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "findings_relative"

STAGES = {"A": "PD", "R": "RD", "N": "ID"}
SCALE = ["PROMO", "LARGE", "STANDARD", "MEDIUM", "ECONOMY", "SMALL"]

#: The candidates in SQL; ends open, so that a query goes on with its own common table expressions.
CANDS = """WITH cands AS (SELECT p_brand AS code, CASE l_returnflag WHEN 'A' THEN 'PD' WHEN 'R' THEN 'RD' ELSE 'ID' END AS stage,
 l_quantity AS value, l_orderkey AS file_id, l_linenumber AS page, l_partkey AS chain, l_shipdate AS rank, l_linestatus AS source,
 p_type AS section FROM lineitem JOIN part ON l_partkey = p_partkey)"""
#: With finer chains: a seventh of a part's line items each.
FINE = CANDS.replace("l_partkey AS chain", "l_partkey * 7 + l_orderkey % 7 AS chain")
VOTE = """, density AS (SELECT file_id, page, count(DISTINCT code) AS density FROM cands GROUP BY ALL),
 votes AS (SELECT code, stage, value, sum(1 + density) AS weight, count(*) AS pages FROM (SELECT DISTINCT code, stage, value, file_id, page FROM cands) JOIN density USING (file_id, page) GROUP BY ALL),
 sides AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, stage ORDER BY weight DESC, pages DESC, value) AS r, count(*) OVER (PARTITION BY code, stage) - 1 AS alternatives FROM votes) WHERE r = 1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, name: str, *key: str) -> DataFrame:
    """A table whose rows become pages of text, dealt to as many tasks as a shuffle has: its file is small, so one task
    or two would read it, and what each page takes is work on its text. The count of tasks is given, as it would else be
    fitted to the size of the rows."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, name).repartition(n, *key)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    stage = F.when(F.col("l_returnflag") == "A", "PD").when(F.col("l_returnflag") == "R", "RD").otherwise("ID")
    both = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("p_brand").alias("code"), stage.alias("stage"), F.col("l_quantity").alias("value"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("chain"), F.col("l_shipdate").alias("rank"), F.col("l_linestatus").alias("source"), F.col("p_type").alias("section"))


def fine(c: DataFrame) -> DataFrame:
    return c.withColumn("chain", F.col("chain") * 7 + F.col("file_id") % 7)


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def stage_sides(c: DataFrame) -> DataFrame:
    """code with pd, rd (voted values) and pd_all, rd_all (all values), in one row."""
    voted = voting.weighted_vote(c, ["code", "stage"], ["file_id", "page"])
    chosen = voted.groupBy("code").agg(*(F.max(F.when(F.col("stage") == s, F.col("value"))).alias(s.lower()) for s in ("PD", "RD")))
    every = c.groupBy("code").agg(*(F.sort_array(F.collect_set(F.when(F.col("stage") == s, F.col("value")))).alias(f"{s.lower()}_all") for s in ("PD", "RD")))
    return chosen.join(every, "code")


@query(CANDS + VOTE + """, pair AS (SELECT code, max(CASE WHEN stage = 'PD' THEN value END) AS pd, max(CASE WHEN stage = 'RD' THEN value END) AS rd FROM sides GROUP BY code)
 SELECT code, pd, rd, CASE WHEN pd IS NULL OR rd IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN abs(pd - rd) < 0.5 THEN 'NO_VIOLATION' WHEN pd = 0 OR abs(rd - pd) / abs(pd) > 0.1 THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END AS label FROM pair""")
def findings_relative(spark, sf_dir):
    s = stage_sides(candidates(spark, sf_dir))
    return s.select("code", "pd", "rd", compare.decide("relative", F.col("pd"), F.col("rd"), F.col("pd_all"), F.col("rd_all"), threshold=0.1).alias("label"))


@query(CANDS + VOTE + " SELECT code, stage, value, CAST(weight AS BIGINT) AS weight, pages, alternatives FROM sides")
def weighted_vote(spark, sf_dir):
    return voting.weighted_vote(candidates(spark, sf_dir), ["code", "stage"], ["file_id", "page"])


@query(CANDS + " SELECT file_id, page, count(DISTINCT code) AS density FROM cands GROUP BY ALL")
def page_density(spark, sf_dir):
    return voting.density(candidates(spark, sf_dir), ["file_id", "page"])


_DECIDE = CANDS + VOTE + """, s AS (SELECT code, max(CASE WHEN stage = 'PD' THEN value END) AS pd, max(CASE WHEN stage = 'RD' THEN value END) AS rd FROM sides GROUP BY code),
 a AS (SELECT code, min(CASE WHEN stage = 'PD' THEN value END) AS plo, max(CASE WHEN stage = 'PD' THEN value END) AS phi, min(CASE WHEN stage = 'RD' THEN value END) AS rlo, max(CASE WHEN stage = 'RD' THEN value END) AS rhi FROM cands GROUP BY code),
 x AS (SELECT code, count(*) AS n_new FROM (SELECT DISTINCT code, value FROM cands WHERE stage = 'RD' EXCEPT SELECT DISTINCT code, value FROM cands WHERE stage = 'PD') GROUP BY code),
 j AS (SELECT s.*, plo, phi, rlo, rhi, coalesce(n_new, 0) AS n_new FROM s JOIN a USING (code) LEFT JOIN x USING (code))
 SELECT code, 'min_absolute' AS kind, CASE WHEN rd IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN rd < 20 THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END AS label FROM j
 UNION ALL SELECT code, 'min_trigger', CASE WHEN rlo IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN rlo < 1 - 1e-9 OR rlo < plo - 1e-9 THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END FROM j
 UNION ALL SELECT code, 'max_trigger', CASE WHEN rhi IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN rhi > 50 + 1e-9 OR rhi > phi + 1e-9 THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END FROM j
 UNION ALL SELECT code, 'presence', CASE WHEN plo IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN rlo IS NULL THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END FROM j
 UNION ALL SELECT code, 'set_decrease', CASE WHEN plo IS NULL OR rlo IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN rhi < plo * 0.95 THEN 'VIOLATION_PRESENT' WHEN rlo < plo * 0.95 THEN 'COMPARISON_IMPOSSIBLE' ELSE 'NO_VIOLATION' END FROM j
 UNION ALL SELECT code, 'set_change', CASE WHEN plo IS NULL OR rlo IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN n_new > 0 THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END FROM j
 UNION ALL SELECT code, 'any_change', CASE WHEN pd IS NULL OR rd IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN abs(pd - rd) < 0.5 THEN 'NO_VIOLATION' ELSE 'VIOLATION_PRESENT' END FROM j
 UNION ALL SELECT code, 'relative', CASE WHEN pd IS NULL OR rd IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN abs(pd - rd) < 0.5 THEN 'NO_VIOLATION' WHEN pd = 0 OR abs(rd - pd) / abs(pd) > 0.1 THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END FROM j
 UNION ALL SELECT code, 'decrease', CASE WHEN pd IS NULL OR rd IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN abs(pd - rd) >= 0.5 AND rd < pd THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END FROM j
 UNION ALL SELECT code, 'increase', CASE WHEN pd IS NULL OR rd IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN abs(pd - rd) >= 0.5 AND rd > pd THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END FROM j"""
_LIMITS = {"min_absolute": {"threshold": 20.0}, "min_trigger": {"threshold": 1.0}, "max_trigger": {"threshold": 50.0}, "set_decrease": {"tolerance": 0.05}, "relative": {"threshold": 0.1}}


@query(_DECIDE)
def decide_types(spark, sf_dir):
    s = stage_sides(candidates(spark, sf_dir))
    kinds = [k for k in compare.TYPES if k not in ("class_downgrade", "decrease_or_text_change")]
    labels = F.array(*(F.struct(F.lit(k).alias("kind"), compare.decide(k, F.col("pd"), F.col("rd"), F.col("pd_all"), F.col("rd_all"), **_LIMITS.get(k, {})).alias("label")) for k in kinds))
    return s.select("code", F.explode(labels).alias("x")).select("code", "x.*")


@query(CANDS + """, n AS (SELECT code, stage, section, count(*) AS n FROM cands GROUP BY ALL),
 m AS (SELECT code, stage, section FROM (SELECT *, row_number() OVER (PARTITION BY code, stage ORDER BY n DESC, section) AS r FROM n) WHERE r = 1),
 s AS (SELECT code, max(CASE WHEN stage = 'PD' THEN section END) AS pd, max(CASE WHEN stage = 'RD' THEN section END) AS rd FROM m GROUP BY code),
 o AS (SELECT code, pd, rd, list_position(['PROMO','LARGE','STANDARD','MEDIUM','ECONOMY','SMALL'], pd) AS i, list_position(['PROMO','LARGE','STANDARD','MEDIUM','ECONOMY','SMALL'], rd) AS j FROM s)
 SELECT code, pd, rd, CASE WHEN pd IS NULL AND rd IS NULL THEN NULL WHEN i IS NULL OR j IS NULL THEN 'COMPARISON_IMPOSSIBLE' WHEN j > i THEN 'VIOLATION_PRESENT' ELSE 'NO_VIOLATION' END AS label FROM o""")
def class_downgrade(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("zero", F.lit(0))
    m = voting.mode(c, ["code", "stage"], "section", "zero")
    s = m.groupBy("code").agg(*(F.max(F.when(F.col("stage") == x, F.col("section"))).alias(x.lower()) for x in ("PD", "RD")))
    empty = F.array().cast("array<string>")
    return s.withColumn("label", compare.decide("class_downgrade", F.col("pd"), F.col("rd"), empty, empty, scale=SCALE))


@query(CANDS + """, b AS (SELECT *, CASE source WHEN 'O' THEN 1 ELSE 2 END AS binding FROM cands), m AS (SELECT *, min(binding) OVER (PARTITION BY code, stage) AS best FROM b)
 SELECT code, stage, best AS binding, array_to_string(list_sort(list(DISTINCT CAST(value AS INTEGER))), ',') AS vals, count(*) AS support FROM m WHERE binding = best GROUP BY code, stage, best""")
def strongest_set(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("binding", F.when(F.col("source") == "O", 1).otherwise(2)).withColumn("value", F.col("value").cast("int"))
    out = voting.strongest_set(c, ["code", "stage"], "binding")
    return out.select("code", "stage", "binding", F.array_join(F.col("values").cast("array<string>"), ",").alias("vals"), "support")


@query(CANDS + """, n AS (SELECT code, stage, CAST(CAST(value AS INTEGER) AS VARCHAR) AS raw, count(*) AS n FROM cands WHERE source = 'F' GROUP BY ALL)
 SELECT DISTINCT r.code, r.stage, r.raw, r.n FROM n r JOIN n o ON r.code = o.code AND r.stage = o.stage AND length(r.raw) = length(o.raw) AND o.n >= 3 * r.n
 WHERE (CASE WHEN substr(r.raw, 1, 1) <> substr(o.raw, 1, 1) THEN 1 ELSE 0 END) + (CASE WHEN substr(r.raw, 2, 1) <> substr(o.raw, 2, 1) THEN 1 ELSE 0 END) = 1""")
def recognized_doubts(spark, sf_dir):
    c = candidates(spark, sf_dir).where("source = 'F'").withColumn("raw", F.col("value").cast("int").cast("string"))
    return voting.doubtful(c, ["code", "stage"])


@query(CANDS + ", f AS (SELECT section, file_id, code, sum(value) AS n FROM cands GROUP BY ALL), g AS (SELECT section, code, max(n) AS n FROM f GROUP BY ALL) SELECT code, sum(n) AS total FROM g GROUP BY code")
def three_level_totals(spark, sf_dir):
    return voting.totals(candidates(spark, sf_dir), "file_id", "code", "section", "value")


@query(CANDS + ", v AS (SELECT code, value, count(*) AS votes, min(page) AS nearest FROM cands GROUP BY ALL) SELECT code, value, votes, nearest FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY votes DESC, nearest, value) AS r FROM v) WHERE r = 1")
def vote_mode(spark, sf_dir):
    return voting.mode(candidates(spark, sf_dir), ["code"], "value", "page")


@query('SELECT p_name, p_size, count(DISTINCT p_brand) AS "values" FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) > 1')
def ambiguous_marks(spark, sf_dir):
    return voting.ambiguous(table(spark, sf_dir, "part"), ["p_name", "p_size"], "p_brand")


@query(CANDS + ", k AS (SELECT stage, file_id, page, count(DISTINCT code) AS keys FROM cands GROUP BY ALL) SELECT stage, file_id, page, keys, place FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY keys DESC, file_id, page) AS place FROM k) WHERE place <= 3")
def evidence_pages(spark, sf_dir):
    return voting.top_pages(candidates(spark, sf_dir), ["stage"], ["file_id", "page"], "code")


@query("""WITH n AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS total FROM n),
 f AS (SELECT *, n >= greatest(2.0, 0.1 * total) AS often FROM s)
 SELECT p_brand, p_name, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(often AS INTEGER) DESC, CASE WHEN often THEN length(p_name) ELSE 0 END DESC, n DESC, p_name) AS r FROM f) WHERE r = 1""")
def specific_code(spark, sf_dir):
    return voting.specific(table(spark, sf_dir, "part"), ["p_brand"], "p_name")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 250000) AS large, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS late FROM orders GROUP BY 1")
def filtered_counts(spark, sf_dir):
    flags = {"finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 250000, "late": F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")}
    return voting.filtered_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], flags)


@query(CANDS + ", m AS (SELECT *, max(rank) OVER (PARTITION BY stage, code, chain) AS top FROM cands) SELECT stage, code, count(*) AS n, sum(value) AS total FROM m WHERE rank = top GROUP BY ALL")
def latest_only(spark, sf_dir):
    out = resolve.latest_only(candidates(spark, sf_dir), ["stage", "code", "chain"], "rank")
    return out.groupBy("stage", "code").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(CANDS + ", m AS (SELECT *, max(CASE WHEN section = 'PROMO' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id) AS has FROM cands) SELECT stage, has = 0 AS fallback, count(*) AS n, sum(value) AS total FROM m WHERE has = 0 OR section = 'PROMO' GROUP BY ALL")
def prefer_source(spark, sf_dir):
    out = resolve.prefer_source(candidates(spark, sf_dir), ["file_id"], F.col("section") == "PROMO")
    return out.groupBy("stage", "fallback").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(CANDS + ", m AS (SELECT *, max(value) OVER (PARTITION BY chain, stage) AS top FROM cands) SELECT chain, stage, max(value) AS value, count(*) AS n FROM m WHERE value = top GROUP BY chain, stage")
def choose_max(spark, sf_dir):
    return resolve.choose_max(candidates(spark, sf_dir), ["chain", "stage"]).groupBy("chain", "stage").agg(F.max("value").alias("value"), F.count("*").alias("n"))


@query(CANDS + ', s AS (SELECT chain, file_id, list_sort(list(DISTINCT value)) AS v FROM cands GROUP BY ALL) SELECT chain, count(*) AS files, count(DISTINCT v) AS "sets" FROM s GROUP BY chain HAVING count(DISTINCT v) > 1')
def revision_conflicts(spark, sf_dir):
    return resolve.conflicts(candidates(spark, sf_dir), ["chain"], "file_id")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders) WHERE next IS NOT NULL")
def revision_pairs(spark, sf_dir):
    return resolve.consecutive(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_custkey", "o_orderkey", "next")


@query("""WITH m AS (SELECT DISTINCT o_custkey, o_orderdate, o_totalprice FROM orders)
 SELECT o_custkey, count(*) AS maximal, CASE WHEN count(*) = 1 THEN 'RESOLVED' ELSE 'CLARIFICATION_REQUIRED' END AS status FROM m a
 WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.o_custkey = b.o_custkey AND b.o_orderdate >= a.o_orderdate AND b.o_totalprice >= a.o_totalprice AND (b.o_orderdate > a.o_orderdate OR b.o_totalprice > a.o_totalprice)) GROUP BY o_custkey""")
def revision_resolution(spark, sf_dir):
    return resolve.maximal(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_totalprice"])


@query(CANDS + """, p AS (SELECT code, chain AS k, max(value) AS v FROM cands WHERE stage = 'PD' GROUP BY ALL), r AS (SELECT code, chain AS k, max(value) AS v FROM cands WHERE stage = 'RD' GROUP BY ALL)
 SELECT code, CASE WHEN r.v IS NULL THEN 'REMOVED' WHEN p.v IS NULL THEN 'ADDED' WHEN p.v = r.v THEN 'SAME' ELSE 'CHANGED' END AS status, count(*) AS n FROM p FULL JOIN r USING (code, k) GROUP BY ALL""")
def keyed_comparison(spark, sf_dir):
    c = candidates(spark, sf_dir)
    side = lambda s: c.where(F.col("stage") == s).groupBy("code", "chain").agg(F.max("value").alias("value"))
    return compare.keyed(side("PD"), side("RD"), ["code", "chain"]).groupBy("code", "status").agg(F.count("*").alias("n"))


@query(CANDS + """, p AS (SELECT chain, value FROM cands WHERE stage = 'PD'), top AS (SELECT chain, max(value) AS m FROM p GROUP BY chain),
 r AS (SELECT DISTINCT chain, value FROM cands WHERE stage = 'RD' EXCEPT SELECT chain, value FROM p), b AS (SELECT chain FROM cands WHERE stage = 'RD' GROUP BY chain)
 SELECT top.chain, count(r.value) > 0 AS reduced FROM top JOIN b USING (chain) LEFT JOIN r ON r.chain = top.chain AND r.value < top.m GROUP BY top.chain""")
def set_reductions(spark, sf_dir):
    c = candidates(spark, sf_dir)
    s = c.groupBy("chain").agg(*(F.collect_set(F.when(F.col("stage") == x, F.col("value"))).alias(x.lower()) for x in ("PD", "RD")))
    return s.where((F.size("pd") > 0) & (F.size("rd") > 0)).select("chain", compare.reduced(F.col("pd"), F.col("rd")).alias("reduced"))


@query(CANDS + ", s AS (SELECT code, sum(CASE WHEN stage = 'PD' THEN value END) AS pd, sum(CASE WHEN stage = 'RD' THEN value END) AS rd FROM cands GROUP BY code) SELECT code, pd, rd, CAST(round_even((pd - rd) / pd * 100, 0) AS INTEGER) AS percent, round_even((pd - rd) / pd * 100, 0) > 5 AS fewer FROM s")
def percent_lower(spark, sf_dir):
    s = candidates(spark, sf_dir).groupBy("code").agg(*(F.sum(F.when(F.col("stage") == x, F.col("value"))).alias(x.lower()) for x in ("PD", "RD")))
    out = s.withColumn("percent", compare.percent_lower(F.col("pd"), F.col("rd")).cast("int"))
    return out.withColumn("fewer", F.col("percent") > 5)


@query("""WITH l AS (SELECT p_partkey AS k, p_size % 7 + 1 AS line FROM part),
 e AS (SELECT l_partkey AS k, l_linenumber AS line, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey) AS r FROM lineitem) WHERE r = 1),
 f AS (SELECT l_partkey AS k, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS r FROM lineitem) WHERE r = 1)
 SELECT l.k, l.line, coalesce(e.l_orderkey, f.l_orderkey) AS file_id, CASE WHEN e.l_orderkey IS NOT NULL THEN 'EXACT' WHEN f.l_orderkey IS NOT NULL THEN 'FALLBACK' ELSE 'NONE' END AS found_by FROM l LEFT JOIN e USING (k, line) LEFT JOIN f USING (k)""")
def lookup_with_fallback(spark, sf_dir):
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 7 + 1).alias("line"))
    index = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("file_id"))
    return joins.lookup(left, index, ["k", "line"], "file_id", ["file_id"]).select("k", "line", "file_id", "found_by")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest FROM events")
def backward_nearest(spark, sf_dir):
    return joins.backward_nearest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", "event_id").select("event_id", "user_id", "nearest")


@query("""WITH w AS (SELECT p_partkey AS k, p_brand, p_type, p_size, list_distinct(string_split(p_name, ' ')) AS w FROM part)
 SELECT a.k AS x, b.k AS y, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 4) AS similarity FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.k < b.k AND len(list_intersect(a.w, b.w)) > 0
 WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.3""")
def name_similarity(spark, sf_dir):
    return joins.similar_rows(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey", "p_name", 0.3)


@query(CANDS + ", e AS (SELECT DISTINCT chain, stage, source FROM cands) SELECT a.stage AS from_stage, b.stage AS to_stage, a.source AS state, count(*) AS n FROM e a JOIN e b ON a.chain = b.chain AND a.source = b.source AND a.stage < b.stage GROUP BY ALL")
def stage_links(spark, sf_dir):
    return joins.stage_links(candidates(spark, sf_dir), ["chain"], "stage", "source")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS place FROM lineitem),
 w AS (SELECT *, lag(place - l_linenumber) OVER v AS po, lag(place) OVER v AS pp FROM o WINDOW v AS (PARTITION BY l_orderkey ORDER BY place)),
 i AS (SELECT *, sum(CASE WHEN po IS NULL OR place - l_linenumber <> po OR place - pp > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM w)
 SELECT l_orderkey, CAST(run AS BIGINT) AS run, min(place) AS "first", max(place) AS "last", count(*) AS n FROM i GROUP BY l_orderkey, run HAVING count(*) > 1""")
def sheet_runs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(w).cast("long"))
    return ordered.runs(rows, ["l_orderkey"], "place", "l_linenumber").withColumn("run", F.col("run").cast("long"))


@query("""WITH d AS (SELECT DISTINCT p_brand, p_size FROM part), w AS (SELECT *, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS a, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS b FROM d)
 SELECT p_brand, p_size, CASE WHEN p_size - a <= 3 THEN a END AS previous, CASE WHEN b - p_size <= 3 THEN b END AS following FROM w""")
def neighbours(spark, sf_dir):
    return ordered.neighbours(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


@query("""WITH f AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority, o_totalprice FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS p FROM f),
 e AS (SELECT o_custkey, o_orderstatus, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ';') AS evidence, count(*) AS merged FROM f GROUP BY ALL)
 SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice, evidence, merged FROM r JOIN e USING (o_custkey, o_orderstatus) WHERE p = 1""")
def submission(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority", "o_totalprice")
    out = project.submission(f, ["o_custkey", "o_orderstatus"], F.col("o_totalprice"), "o_orderpriority", ["o_orderkey"])
    return out.withColumn("evidence", F.array_join("evidence", ";"))


@query("""WITH f AS (SELECT l_partkey AS k, CASE WHEN sum(l_quantity) > 800 THEN 'VIOLATION_PRESENT' WHEN sum(l_quantity) > 500 THEN 'COMPARISON_IMPOSSIBLE' ELSE 'UNKNOWN' END AS label FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey, l_linenumber),
 b AS (SELECT k, min(CASE label WHEN 'VIOLATION_PRESENT' THEN 1 WHEN 'COMPARISON_IMPOSSIBLE' THEN 2 ELSE 3 END) AS r, count(*) AS n FROM f GROUP BY k)
 SELECT p_partkey AS k, coalesce(n, 0) AS n_findings, CASE r WHEN 1 THEN 'COMPLETE' WHEN 2 THEN 'NOT_COMPARABLE' WHEN 3 THEN 'MISSING_EVIDENCE' ELSE 'NOT_CHECKED' END AS status FROM part LEFT JOIN b ON p_partkey = k""")
def coverage(spark, sf_dir):
    total = F.sum("l_quantity")
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k"), "l_linenumber").agg(F.when(total > 800, "VIOLATION_PRESENT").when(total > 500, "COMPARISON_IMPOSSIBLE").otherwise("UNKNOWN").alias("label"))
    return project.coverage(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), found, "k", "label").select("k", "n_findings", "status")


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-06-01' AND l_quantity > 45 GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 47 GROUP BY 1)
 SELECT k, a.n AS was, b.n AS now, CASE WHEN a.n IS NULL THEN 'ADDED' WHEN b.n IS NULL THEN 'REMOVED' WHEN a.n = b.n THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM a FULL JOIN b USING (k)""")
def version_difference(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    side = lambda c: lines.where(c).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    old = (F.col("l_shipdate") < F.lit("1999-06-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 45)
    return project.difference(side(old), side(F.col("l_quantity") > 47), ["k"], "n")


@query("SELECT o_custkey, sha256(array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus)), chr(10))) AS version, count(*) AS n FROM orders GROUP BY 1")
def manifest(spark, sf_dir):
    return project.manifest(table(spark, sf_dir, "orders"), ["o_custkey"], F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"))


@query("SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents")
def registry_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return registry.mark_duplicates(rows, "sha256", "doc_id")


@query("""WITH n AS (SELECT doc_id, sha256(text) AS d, lang AS s FROM documents), o AS (SELECT doc_id, d, s FROM n WHERE s <> 'es')
 SELECT count(o.doc_id) AS previous, count(*) FILTER (n.doc_id IS NULL) AS lost, count(*) FILTER (n.doc_id IS NOT NULL AND o.doc_id IS NOT NULL AND n.s IS DISTINCT FROM o.s) AS restaged,
 count(*) FILTER (n.doc_id IS NOT NULL AND n.d IS DISTINCT FROM o.d) AS changed, CASE WHEN count(o.doc_id) = 0 OR count(*) FILTER (n.doc_id IS NULL) > 0 THEN 'FULL' ELSE 'PARTIAL' END AS mode FROM n FULL JOIN o USING (doc_id)""")
def incremental_plan(spark, sf_dir):
    now = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"), F.col("lang").alias("s"))
    return incremental.plan(now, now.where("s <> 'es'"), "doc_id", "d", "s")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    out = upserts.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_upsert(spark, sf_dir):
    return upserts.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_access(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS n_flat, len(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?)', 1)) AS n_numbers FROM documents")
def text_flat_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.char_length(T.flat(F.col("text"))).alias("n_flat"), F.size(T.numbers(F.col("text"))).cast("long").alias("n_numbers"))


@query("""WITH o AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda x: x <> '')) AS w FROM conversations),
 p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM o)
 SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(w, b))) = 0 THEN 0.0 ELSE len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) END, 6) AS similarity FROM p WHERE b IS NOT NULL""")
def page_similarity(spark, sf_dir):
    from pyspark.sql import Window

    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.word_set(F.col("text")).alias("w"))
    w = w.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return w.select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("b")), 6).alias("similarity"))


@query("""WITH t AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS term FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark)
 SELECT term, count(*) AS df, round(ln(max(n) / count(*)), 6) AS idf FROM t, n WHERE term <> '' GROUP BY term""")
def term_idf(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    n = b.count()
    terms = b.select("item_id", F.explode(T.word_set(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.round(F.log(F.lit(float(n)) / F.col("df")), 6))


@query("""WITH c AS (SELECT label, list(e ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS e FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY label)
 SELECT vec_id, e.label, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), c), 4) AS score FROM embeddings e JOIN c USING (label)""")
def centroid_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    flat = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("c"))
    return e.join(centre, "label").select("vec_id", "label", F.round(T.cosine(F.col("embedding"), F.col("c")), 4).alias("score"))

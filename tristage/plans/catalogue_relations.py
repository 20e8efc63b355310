"""Queries of joins, aggregates and choices between records, in the manner of catalogue.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions import language as L
from tristage.functions import text as T
from tristage.operators import relations as R
from tristage.plans.catalogue import CANDS, FINE, candidates, fine, query, table


def _stage(c, s):
    return c.where(F.col("stage") == s)


@query(FINE + ", n AS (SELECT DISTINCT chain, 'p' || CAST(page AS VARCHAR) AS n FROM cands) SELECT chain, array_to_string(list_sort(list(n)), ',') AS names FROM n GROUP BY chain")
def union_presence(spark, sf_dir):
    c = fine(candidates(spark, sf_dir)).select("chain", F.array(F.concat(F.lit("p"), F.col("page").cast("string"))).alias("names"))
    return R.union_of(c, ["chain"], "names").select("chain", F.array_join("names", ",").alias("names"))


@query(CANDS + """, s AS (SELECT chain, rank, list_sort(list(DISTINCT value)) AS v FROM cands GROUP BY ALL), l AS (SELECT chain, max(rank) AS top, arg_max(v, rank) AS used FROM s GROUP BY chain)
 SELECT chain, rank, len(v) AS n, len(used) AS n_used FROM s JOIN l USING (chain) WHERE rank < top AND v <> used""")
def revision_history(spark, sf_dir):
    out = R.history(candidates(spark, sf_dir), ["chain"], "rank")
    return out.select("chain", "rank", F.size("values").cast("long").alias("n"), F.size("used").cast("long").alias("n_used"))


@query("""WITH m AS (SELECT l_suppkey AS stage, l_orderkey AS file, sum(l_linenumber) = max(l_orderkey % 20) AS consistent, CAST(sum(l_linenumber) AS BIGINT) AS parts FROM lineitem GROUP BY ALL)
 SELECT stage, file, consistent, parts FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY CAST(consistent AS INTEGER) DESC, file) AS r FROM m) WHERE r = 1""")
def stage_mix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stage"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") % 20).alias("total"))
    return R.consistent_mix(rows, ["stage"], "file")


@query(CANDS + ", k AS (SELECT code, count(DISTINCT chain) AS keys, min(value) AS low, max(value) AS high FROM cands GROUP BY code) SELECT * FROM k")
def keyed_summary(spark, sf_dir):
    return R.keyed_summary(candidates(spark, sf_dir), ["code"], "chain")


@query(CANDS + ", s AS (SELECT DISTINCT file_id, page, code FROM cands) SELECT file_id, page, array_to_string(list_sort(list(code)), ',') AS codes FROM s GROUP BY ALL")
def page_codes(spark, sf_dir):
    return R.sets_by(candidates(spark, sf_dir), ["file_id", "page"], "code").select("file_id", "page", F.array_join("values", ",").alias("codes"))


@query("""WITH one AS (SELECT l_partkey AS room, l_orderkey AS file, arg_min(l_quantity, (l_linenumber, l_quantity)) AS v FROM lineitem GROUP BY ALL), v AS (SELECT room, list_sort(list(v)) AS v FROM one GROUP BY room),
 g AS (SELECT room, v, list_reduce(list_prepend([[]::DOUBLE[]], list_transform(v, lambda x: [[x]])), lambda acc, x: CASE WHEN len(acc[len(acc)]) > 0 AND (x[1][1] - acc[len(acc)][1]) / x[1][1] <= 0.05 THEN list_append(acc[1:len(acc) - 1], list_append(acc[len(acc)], x[1][1])) ELSE list_append(acc, x[1]) END) AS g FROM v),
 b AS (SELECT room, len(v) AS n, list_max(list_transform(g, lambda x: len(x))) AS best FROM g) SELECT room, round(best / n, 6) AS share FROM b""")
def majority_share(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("room"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("area"))
    return R.majority(rows, ["room"], "file", "area").select("room", F.round("share", 6).alias("share"))


@query("WITH p AS (SELECT *, p_name || ' ' || p_size AS code FROM part), k AS (SELECT code FROM p GROUP BY code HAVING count(DISTINCT (p_brand, p_size % 3)) = 1) SELECT p_partkey, code FROM p JOIN k USING (code)")
def own_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 3).alias("k"), F.concat("p_name", F.lit(" "), "p_size").alias("code"))
    return R.own_codes(p, ["p_brand", "k"], "code").select("p_partkey", "code")


@query("""WITH s AS (SELECT l_orderkey AS file, l_linenumber AS page, CAST(l_quantity AS INTEGER) AS flow, CAST(l_partkey % 60 AS INTEGER) AS calc_flow, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 9 END AS pressure, l_suppkey % 7 AS calc_pressure FROM lineitem)
 SELECT file, page, flow, calc_flow, round((calc_flow - flow) / flow, 6) AS gap FROM s WHERE calc_flow < flow OR calc_pressure < coalesce(pressure, 0)""")
def below_duty(spark, sf_dir):
    s = F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("page"), F.col("l_quantity").cast("int").alias("flow"), (F.col("l_partkey") % 60).cast("int").alias("calc_flow"), F.when(s % 5 != 0, s % 9).alias("pressure"), (s % 7).alias("calc_pressure"))
    return R.below_duty(rows).select("file", "page", "flow", "calc_flow", "gap")


_PUMPS = FINE + """, p AS (SELECT chain AS key, stage, CASE WHEN file_id % 3 = 0 THEN NULL ELSE section END AS model, value AS flow, value * 2 + page AS head, page AS rank FROM cands),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, stage, model ORDER BY rank, flow, head) AS r FROM p) WHERE r = 1), n AS (SELECT *, count(*) OVER (PARTITION BY key, stage) AS n FROM b),
 a AS (SELECT * FROM n WHERE stage = 'PD'), z AS (SELECT * FROM n WHERE stage = 'RD'),
 c AS (SELECT a.key, a.model, a.flow AS pf, z.flow AS rf, a.head AS ph, z.head AS rh FROM a JOIN z ON a.key = z.key AND a.model = z.model),
 o AS (SELECT a.key, z.model, a.flow AS pf, z.flow AS rf, a.head AS ph, z.head AS rh FROM a JOIN z ON a.key = z.key AND a.n = 1 AND z.n = 1 WHERE a.key NOT IN (SELECT key FROM c))"""


@query(_PUMPS + " SELECT key, model, pf AS pd_flow, rf AS rd_flow, ph AS pd_head, rh AS rd_head, CASE WHEN rf / pf - 1 < -0.005 OR rh / ph - 1 < -0.005 THEN 'LOWER' WHEN rf / pf - 1 > 0.2 OR rh / ph - 1 > 0.2 THEN 'OVER' END AS state FROM (SELECT * FROM c UNION ALL SELECT * FROM o)")
def pump_comparison(spark, sf_dir):
    c = fine(candidates(spark, sf_dir))
    p = c.select(F.col("chain").alias("key"), "stage", F.when(F.col("file_id") % 3 != 0, F.col("section")).alias("model"), F.col("value").alias("flow"), (F.col("value") * 2 + F.col("page")).alias("head"), F.col("page").alias("rank"))
    return R.pump_pairs(_stage(p, "PD").drop("stage"), _stage(p, "RD").drop("stage"), "key")


_DOORS = FINE + """, d AS (SELECT DISTINCT chain, stage, page * 15 AS minutes, CASE file_id % 3 WHEN 0 THEN 'EI' WHEN 1 THEN 'EIW' ELSE 'E' END AS letters FROM cands),
 m AS (SELECT chain, stage, min(minutes) AS m FROM d GROUP BY ALL), l AS (SELECT DISTINCT chain, stage, unnest(string_split(letters, '')) AS l FROM d JOIN m USING (chain, stage) WHERE minutes = m),
 g AS (SELECT chain, list(l) FILTER (stage = 'PD') AS pl, list(l) FILTER (stage = 'RD') AS rl FROM l GROUP BY chain), s AS (SELECT chain, max(m) FILTER (stage = 'PD') AS pm, max(m) FILTER (stage = 'RD') AS rm FROM m GROUP BY chain)"""


@query(_DOORS + " SELECT chain, CASE WHEN rm < pm THEN 'LOWER' WHEN rm = pm AND NOT list_has_all(rl, pl) THEN 'LETTER' END AS state FROM s JOIN g USING (chain)")
def door_limits(spark, sf_dir):
    from tristage.operators.changes import sides

    third = F.col("file_id") % 3
    d = F.struct((F.col("page") * 15).alias("minutes"), F.when(third == 0, "EI").when(third == 1, "EIW").otherwise("E").alias("letters"))
    return sides(fine(candidates(spark, sf_dir)).withColumn("d", d), ["chain"], value="d").select("chain", R.door_limits(F.col("pd"), F.col("rd")).alias("state"))


@query(FINE + " SELECT DISTINCT code, chain FROM cands r WHERE stage = 'RD' AND NOT EXISTS (SELECT 1 FROM cands p WHERE p.stage = 'PD' AND p.code = r.code AND p.chain = r.chain) AND NOT EXISTS (SELECT 1 FROM cands i WHERE i.stage = 'ID' AND i.code = r.code AND i.chain = r.chain)")
def new_makers(spark, sf_dir):
    c = fine(candidates(spark, sf_dir))
    return R.new_makers(_stage(c, "PD"), _stage(c, "RD"), _stage(c, "ID"), ["code", "chain"])


@query("""WITH l AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS number, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS purpose, p_brand AS layers FROM part),
 r AS (SELECT l_partkey AS v, CASE WHEN p_partkey % 5 = 0 THEN p_size + 30 END AS number, CASE WHEN p_partkey % 7 = 0 THEN p_name END AS purpose, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS layers FROM lineitem JOIN part ON l_partkey = p_partkey),
 a AS (SELECT number, min(v) AS v0 FROM r GROUP BY 1), b AS (SELECT purpose, min(v) AS v1 FROM r GROUP BY 1), c AS (SELECT layers, min(v) AS v2 FROM r GROUP BY 1)
 SELECT k, coalesce(v0, v1, v2) AS v, CASE WHEN v0 IS NOT NULL THEN 'number' WHEN v1 IS NOT NULL THEN 'purpose' WHEN v2 IS NOT NULL THEN 'layers' END AS tier FROM l LEFT JOIN a USING (number) LEFT JOIN b USING (purpose) LEFT JOIN c USING (layers)""")
def tiered_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    left = p.select(k.alias("k"), F.when(k % 4 != 0, F.col("p_size")).alias("number"), F.when(k % 3 != 0, F.col("p_name")).alias("purpose"), F.col("p_brand").alias("layers"))
    both = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == k)
    right = both.select(F.col("l_partkey").alias("v"), F.when(k % 5 == 0, F.col("p_size") + 30).alias("number"), F.when(k % 7 == 0, F.col("p_name")).alias("purpose"), F.when(k % 2 == 0, F.col("p_brand")).alias("layers"))
    return R.tiers(left, right, ["number", "purpose", "layers"], "v").select("k", "v", "tier")


_ROOMS = """WITH s AS (SELECT l_suppkey % 20 AS object, l_partkey % 1000 AS room, l_returnflag AS f, l_linenumber AS system, l_linestatus = 'O' AS own FROM lineitem),
 o AS (SELECT object, f, bool_or(own) AS has FROM s GROUP BY ALL), k AS (SELECT DISTINCT object, f, room, system FROM s JOIN o USING (object, f) WHERE own OR NOT has),
 p AS (SELECT object, room, list_sort(list(system)) AS pd FROM k WHERE f = 'A' GROUP BY ALL), r AS (SELECT object, room, list_sort(list(system)) AS rd FROM k WHERE f = 'R' GROUP BY ALL),
 n AS (SELECT object, count(*) AS np FROM p GROUP BY 1), m AS (SELECT object, count(*) AS nr FROM r GROUP BY 1)"""


@query(_ROOMS + """ SELECT object, room, len(pd) AS n, CASE WHEN np < 5 OR coalesce(nr, 0) < 5 THEN 'REFUSED' WHEN rd IS NULL THEN CASE WHEN coalesce(nr, 0) < 0.6 * np THEN 'MISSING_DOUBT' ELSE 'MISSING' END WHEN NOT list_has_all(rd, pd) THEN 'FEWER' ELSE 'SAME' END AS state FROM p LEFT JOIN r USING (object, room) JOIN n USING (object) LEFT JOIN m USING (object)""")
def room_comparison(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.select((F.col("l_suppkey") % 20).alias("object"), (F.col("l_partkey") % 1000).alias("room"), F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("system"), (F.col("l_linestatus") == "O").alias("own"))
    kept = R.authoritative(s, ["object", "f"], F.col("own"), ["room", "system"])
    side = lambda f: R.sets_by(kept.where(F.col("f") == f), ["object", "room"], "system")
    return R.rooms(side("A"), side("R"), ["object"]).select("object", "room", F.size("pd").cast("long").alias("n"), "state")


@query("SELECT room, len(list(DISTINCT l_linenumber)) AS n FROM (SELECT l_linenumber, unnest([l_suppkey % 10, l_partkey % 10]) AS room FROM lineitem) GROUP BY room")
def served_map(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_suppkey") % 10, F.col("l_partkey") % 10).alias("rooms"), "l_linenumber")
    return R.served(rows, "rooms", "l_linenumber").select("room", F.size("values").cast("long").alias("n"))


@query("WITH s AS (SELECT l_returnflag AS f, l_linenumber * 1000 + l_partkey % 1000 AS type, CAST(l_quantity AS INTEGER) AS total, CAST(l_discount * 100 AS INTEGER) AS living, CAST(l_tax * 100 AS INTEGER) AS summer FROM lineitem) SELECT DISTINCT type, total, living, summer FROM s r WHERE f = 'R' AND EXISTS (SELECT 1 FROM s p WHERE p.f = 'A' AND p.type = r.type AND p.total = r.total) AND NOT EXISTS (SELECT 1 FROM s p WHERE p.f = 'A' AND p.type = r.type AND p.total = r.total AND p.living = r.living AND p.summer = r.summer)")
def apartment_areas(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_returnflag").alias("f"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("type"), F.col("l_quantity").cast("int").alias("total"), F.round(F.col("l_discount") * 100).cast("int").alias("living"), F.round(F.col("l_tax") * 100).cast("int").alias("summer"))
    return R.areas(s.where("f = 'A'"), s.where("f = 'R'"), ["type", "total"], ["living", "summer"])


@query("""WITH c AS (SELECT o_orderkey AS clause, o_custkey * 2 AS term, o_orderkey % 50 AS address FROM orders), o AS (SELECT * FROM c WHERE term NOT IN (SELECT l_partkey FROM lineitem)),
 p AS (SELECT l_suppkey % 60 AS address, l_orderkey AS file, min(l_linenumber) AS page FROM lineitem GROUP BY ALL), b AS (SELECT address, list((file, page) ORDER BY file) AS pages FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY file) AS r FROM p) WHERE r <= 3 GROUP BY address)
 SELECT clause, term, address, len(pages) AS n, pages[1][1] AS first_file FROM o JOIN b USING (address)""")
def proven_absent(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    clauses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clause"), (F.col("o_custkey") * 2).alias("term"), (F.col("o_orderkey") % 50).alias("address"))
    mentions = li.select(F.col("l_partkey").alias("term"))
    coverage = li.select((F.col("l_suppkey") % 60).alias("address"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("page"))
    out = R.proven_absent(clauses, mentions, coverage)
    return out.select("clause", "term", "address", F.size("pages").cast("long").alias("n"), F.get("pages", 0).file.alias("first_file"))


@query("SELECT p_partkey AS id, coalesce(list_has_any([p_size, p_partkey % 100], (SELECT list(DISTINCT CAST(s_suppkey AS BIGINT)) FROM supplier WHERE s_acctbal < 3000)), false) AS clarify FROM part")
def revision_clarity(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 100).alias("files"))
    return R.in_conflict(f, "files", table(spark, sf_dir, "supplier").where("s_acctbal < 3000"), "s_suppkey").select("id", "clarify")


@query("SELECT a.o_orderkey, b.o_orderstatus AS predecessor FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - 3")
def file_predecessors(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("before", F.col("o_orderkey") - 3)
    return R.predecessors(o, "o_orderkey", "before", "o_orderstatus").select("o_orderkey", "predecessor")


@query("WITH n AS (SELECT DISTINCT l_orderkey AS d, l_partkey * 10 + l_linenumber AS room FROM lineitem), f AS (SELECT room FROM n GROUP BY room HAVING count(*) BETWEEN 2 AND 8), k AS (SELECT n.* FROM n JOIN f USING (room)) SELECT a.d AS x, b.d AS y, count(*) AS rooms FROM k a JOIN k b ON a.room = b.room AND a.d < b.d GROUP BY ALL")
def shared_rooms(spark, sf_dir):
    return R.shared_rooms(table(spark, sf_dir, "lineitem").withColumn("room", F.col("l_partkey") * 10 + F.col("l_linenumber")), "l_orderkey", "room")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_suppkey * 11 FROM lineitem) AND p_partkey NOT IN (SELECT o_custkey FROM orders)")
def uncovered_parameters(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 11).alias("p_partkey"))
    listed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("p_partkey"))
    return R.uncovered(table(spark, sf_dir, "part"), found, listed, "p_partkey").select("p_partkey")


@query("""WITH t AS (SELECT conv_id AS volume, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda x: x <> '')) AS term FROM conversations), n AS (SELECT volume, term, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT conv_id AS volume, 4 + count(*) AS pages FROM conversations GROUP BY 1),
 s AS (SELECT * FROM n JOIN p USING (volume) WHERE pages >= 5), r AS (SELECT volume, sqrt(sum(n * n)) AS norm FROM s GROUP BY 1),
 d AS (SELECT a.volume AS x, b.volume AS y, sum(a.n * b.n) AS dot FROM s a JOIN s b ON a.term = b.term AND a.volume < b.volume AND abs(a.pages - b.pages) <= greatest(3, 0.03 * greatest(a.pages, b.pages)) GROUP BY ALL)
 SELECT x, y, round(dot / (p.norm * q.norm), 6) AS cosine FROM d JOIN r p ON p.volume = x JOIN r q ON q.volume = y WHERE dot / (p.norm * q.norm) >= 0.6""")
def same_content(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    terms = c.select(F.col("conv_id").alias("volume"), F.explode(F.filter(F.split(F.lower("text"), r"[ \n]+"), lambda x: x != "")).alias("term")).groupBy("volume", "term").agg(F.count("*").alias("n"))
    pages = c.groupBy(F.col("conv_id").alias("volume")).agg((F.count("*") + 4).alias("pages"))
    return R.same_content(R.profiled(terms.join(pages, "volume"), []), [], cosine=0.6, every=True)


@query("WITH w AS (SELECT DISTINCT l_orderkey AS page, l_quantity AS y FROM lineitem), g AS (SELECT *, lead(y) OVER (PARTITION BY page ORDER BY y) - y AS gap FROM w), m AS (SELECT page, median(gap) AS m, max(y) AS last FROM g GROUP BY page), c AS (SELECT g.page, min(y) AS cut FROM g JOIN m USING (page) WHERE gap > greatest(0.03, 1.5 * m) GROUP BY 1) SELECT page, coalesce(cut, last) AS \"end\" FROM m LEFT JOIN c USING (page)")
def table_ends(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y"))
    return R.table_end(w, ["page"], "y", times=1.5)


@query("""WITH e AS (SELECT DISTINCT item_id AS entry, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda x: x <> '')) AS term FROM benchmark), t AS (SELECT DISTINCT conv_id * 100 + turn AS text, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda x: x <> '')) AS term FROM conversations),
 i AS (SELECT term, ln((SELECT count(DISTINCT entry) FROM e) / count(*)) AS w FROM e GROUP BY term HAVING ln((SELECT count(DISTINCT entry) FROM e) / count(*)) > 0), c AS (SELECT * FROM e JOIN i USING (term)), q AS (SELECT * FROM t JOIN i USING (term)),
 nc AS (SELECT entry, sqrt(sum(w * w)) AS n FROM c GROUP BY 1), nq AS (SELECT text, sqrt(sum(w * w)) AS n FROM q GROUP BY 1), d AS (SELECT text, entry, sum(q.w * q.w) AS dot FROM q JOIN c USING (term) GROUP BY ALL),
 s AS (SELECT text, entry, round(dot / (nq.n * nc.n), 6) AS score FROM d JOIN nq USING (text) JOIN nc USING (entry)),
 r AS (SELECT *, row_number() OVER v AS place, round(score - coalesce(lead(score) OVER v, 0), 6) AS margin FROM s WINDOW v AS (PARTITION BY text ORDER BY score DESC, entry)) SELECT text, entry, score, place, margin FROM r WHERE place <= 3""")
def classify_texts(spark, sf_dir):
    terms = lambda df, k: df.select(k, F.explode(T.word_set(F.col("text_"))).alias("term"))
    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("text"), F.col("text").alias("text_"))
    entries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry"), F.col("text").alias("text_"))
    return R.classify(terms(texts, "text"), terms(entries, "entry"))


@query("WITH s AS (SELECT l_orderkey, CASE l_linenumber WHEN 3 THEN 'NOT_APPLICABLE' WHEN 2 THEN 'PLANNED' WHEN 5 THEN 'APPLICABLE' ELSE 'OTHER' END AS status FROM lineitem), n AS (SELECT l_orderkey, status, count(*) AS n, CASE status WHEN 'APPLICABLE' THEN 1 WHEN 'PLANNED' THEN 2 ELSE 3 END AS r FROM s WHERE status <> 'OTHER' GROUP BY ALL) SELECT l_orderkey, status, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r) AS p FROM n) WHERE p = 1")
def applicability(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(n == 3, "NOT_APPLICABLE").when(n == 2, "PLANNED").when(n == 5, "APPLICABLE").otherwise("OTHER").alias("status"))
    return R.priority_status(rows, ["l_orderkey"], ["APPLICABLE", "PLANNED", "NOT_APPLICABLE"])


@query("SELECT p_partkey, coalesce(verdict, 'SUBMIT') AS verdict FROM part LEFT JOIN (SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) AS p_brand, CASE WHEN n_regionkey = 1 THEN 'HOLD' ELSE 'NOTE' END AS verdict FROM nation) USING (p_brand)")
def expert_verdicts(spark, sf_dir):
    said = table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("p_brand"), F.when(F.col("n_regionkey") == 1, "HOLD").otherwise("NOTE").alias("verdict"))
    return R.verdicts(table(spark, sf_dir, "part"), said, ["p_brand"]).select("p_partkey", "verdict")


@query(CANDS + ", a AS (SELECT code FROM cands WHERE file_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)) UNION SELECT p_brand FROM part WHERE p_type = 'PROMO') SELECT code FROM a")
def affected_codes(spark, sf_dir):
    direct = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_brand").alias("code"))
    orders = table(spark, sf_dir, "orders")
    latest = orders.agg(F.max("o_orderdate").alias("o_orderdate"))  # what came in last
    changed = orders.join(F.broadcast(latest), "o_orderdate").select(F.col("o_orderkey").alias("file_id"))
    return R.affected(candidates(spark, sf_dir).join(changed, "file_id", "left_semi"), direct, "code")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_orderdate > TIMESTAMP '1998-06-01') AND NOT bool_and(o_orderdate > TIMESTAMP '1998-06-01')")
def broken_chains(spark, sf_dir):
    return R.broken_chains(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate") > F.lit("1998-06-01").cast("timestamp_ntz"))


@query("WITH w AS (SELECT l_suppkey AS object, l_linenumber AS mark, l_returnflag AS f, CAST(l_quantity AS BIGINT) AS w, l_partkey % 50 AS h FROM lineitem), m AS (SELECT object, mark, max(w * h) AS a FROM w WHERE f = 'A' GROUP BY ALL) SELECT DISTINCT object, mark, w.w, h FROM w JOIN m USING (object, mark) WHERE f = 'R' AND w.w * h < a")
def smaller_openings(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("object"), F.col("l_linenumber").alias("mark"), F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("long").alias("w"), (F.col("l_partkey") % 50).alias("h"))
    return R.smaller_openings(w.where("f = 'A'"), w.where("f = 'R'"), ["object"])


_NORM = "CASE k % 4 WHEN 0 THEN '70.13330' WHEN 1 THEN '70.1330' WHEN 2 THEN '21.1101' ELSE CAST(a AS STRING) || '.' || (k % 3) END"


@query(f"""WITH r AS (SELECT 'СП' AS kind, {_NORM} AS number, CASE WHEN k % 12 = 1 OR k % 4 <> 1 THEN 2012 ELSE 2000 + CAST(a % 3 AS INTEGER) END AS year, k FROM (SELECT p_partkey AS k, CAST(p_size AS INTEGER) AS a FROM part)), n AS (SELECT kind, number, year, count(*) AS mentions FROM r WHERE k % 8 <> 1 GROUP BY ALL)
 SELECT n.kind, n.number, n.year, n.mentions, CASE WHEN n.number = '70.1330' AND n.mentions < m.mentions THEN m.number WHEN n.number = '70.13330' AND n.mentions < o.mentions THEN o.number END AS typo_of FROM n LEFT JOIN n m ON m.number = '70.13330' AND m.year = n.year LEFT JOIN n o ON o.number = '70.1330' AND o.year = n.year""")
def norm_inventory(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("int").alias("a")).where("k % 8 <> 1")
    refs = p.select(F.lit("СП").alias("kind"), F.expr(_NORM).alias("number"), F.when((F.col("k") % 12 == 1) | (F.col("k") % 4 != 1), 2012).otherwise(2000 + F.col("a") % 3).alias("year"))
    return R.typos(refs, L.one_digit_apart(F.col("a.number"), F.col("b.number")))


@query("""WITH p AS (SELECT p_partkey AS k, p_brand, list_distinct(string_split(p_name, ' ')) AS w FROM part), l AS (SELECT *, lead(w) OVER (PARTITION BY p_brand ORDER BY k) AS b FROM p)
 SELECT k, round(s, 6) AS overlap, s >= 0.5 AS same FROM (SELECT k, CASE WHEN b IS NOT NULL THEN len(list_intersect(w, b)) / least(len(w), len(b)) END AS s FROM l)""")
def room_names(spark, sf_dir):
    """Names are the same if the smaller one shares half of its words; unknown if one has none (row 199)."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand", F.array_distinct(F.split("p_name", " ")).alias("w"))
    p = p.withColumn("b", F.lead("w").over(Window.partitionBy("p_brand").orderBy("k")))
    share = T.overlap(F.col("w"), F.col("b"))
    return p.select("k", F.round(share, 6).alias("overlap"), (share >= 0.5).alias("same"))


_NOW = "SELECT p_partkey AS file, p_name AS digest FROM part WHERE p_partkey % 10 <> 3"
_BEFORE = "SELECT p_partkey AS file, CASE WHEN p_partkey % 7 = 0 THEN 'old' ELSE p_name END AS digest FROM part WHERE p_partkey % 9 <> 4"


@query(f"""WITH n AS ({_NOW}), b AS ({_BEFORE}) SELECT file, 'changed' AS what FROM n LEFT JOIN b USING (file) WHERE n.digest IS DISTINCT FROM b.digest
 UNION ALL SELECT file, 'lost' FROM b WHERE file NOT IN (SELECT file FROM n) UNION ALL SELECT file, 'kept' FROM n JOIN b USING (file) WHERE n.digest = b.digest""")
def file_changes(spark, sf_dir):
    """New or different files, files that are gone, and rows of files that stay (rows 353 to 355)."""
    from tristage.operators import incremental as I

    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    now = p.where(k % 10 != 3).select(k.alias("file"), F.col("p_name").alias("digest"))
    before = p.where(k % 9 != 4).select(k.alias("file"), F.when(k % 7 == 0, "old").otherwise(F.col("p_name")).alias("digest"))
    changed = I.changed_files(now, before, "file", "digest")
    said = lambda df, what: df.select("file", F.lit(what).alias("what"))
    return said(changed, "changed").unionByName(said(I.lost_files(now, before, "file"), "lost")).unionByName(said(I.keep(now, changed, "file"), "kept"))


@query("SELECT l_suppkey AS k, coalesce(s_name, 'part ' || CAST(l_suppkey AS VARCHAR)) AS name FROM (SELECT DISTINCT l_suppkey FROM lineitem UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000) LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 2000) ON s_suppkey = l_suppkey")
def first_manifest(spark, sf_dir):
    """The first manifest that knows a key wins (row 003)."""
    from tristage.sources import registry

    s = table(spark, sf_dir, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).distinct().select("k", F.concat(F.lit("part "), F.col("k").cast("string")).alias("name"))
    return registry.first_manifest([s, li], "k").select("k", "name")


_SHEETS = """WITH s AS (SELECT o_custkey % 40 AS object, o_orderkey AS sheet, CASE WHEN o_orderkey % 2 = 0 THEN 'PD' ELSE 'RD' END AS stage, CASE o_orderkey % 5 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'AR' WHEN 2 THEN 'AR' ELSE 'OV' END AS section,
 CASE WHEN o_orderkey % 7 = 0 THEN []::VARCHAR[] ELSE ['w' || (o_orderkey % 9), 'v' || (o_orderkey % 4), 'план'] END AS words, ['n' || (o_orderkey % 3)] AS numbers, CASE o_orderkey % 6 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['VENT'] WHEN 2 THEN ['VENT', 'HEAT'] ELSE ['WATER'] END AS tags FROM orders),
 m AS (SELECT DISTINCT object, sheet, stage, CAST(l_partkey % 12 AS BIGINT) AS room FROM s JOIN lineitem ON l_orderkey = sheet), g AS (SELECT sheet, list(room) AS rooms FROM m GROUP BY sheet),
 a AS (SELECT s.*, coalesce(rooms, []) AS rooms FROM s LEFT JOIN g USING (sheet)),
 p AS (SELECT p.object, p.sheet AS pd, r.sheet AS rd, len(list_intersect(p.rooms, r.rooms)) AS shared, CASE WHEN len(p.rooms) = 0 THEN 0 ELSE len(list_intersect(p.rooms, r.rooms)) / len(p.rooms) END AS containment, len(p.rooms) AS nr,
  CASE WHEN len(p.words) = 0 OR len(r.words) = 0 OR p.numbers <> r.numbers THEN 0 ELSE len(list_intersect(list_concat(p.words, p.numbers), list_concat(r.words, r.numbers))) / len(list_distinct(list_concat(p.words, p.numbers, r.words, r.numbers))) END AS similarity,
  len(p.words) + 1 >= 3 AS informative, p.section = r.section AS same, p.section <> r.section AND p.section <> 'OTHER' AND r.section <> 'OTHER' AS apart, CASE WHEN len(p.tags) > 0 AND len(r.tags) > 0 THEN CASE WHEN list_has_any(p.tags, r.tags) THEN 0.25 ELSE -0.25 END ELSE 0 END AS bonus FROM a p JOIN a r ON p.object = r.object AND p.stage = 'PD' AND r.stage = 'RD'),
 f AS (SELECT *, shared >= 3 AND containment >= 0.15 AS by_rooms, similarity >= 0.6 AS named FROM p),
 k AS (SELECT *, round(containment + bonus + CASE WHEN similarity >= 0.999 THEN 2.0 WHEN named THEN 0.5 * similarity ELSE 0 END, 3) AS score, CASE WHEN by_rooms AND named THEN 'BOTH' WHEN by_rooms THEN 'ROOMS' ELSE 'NAME' END AS how FROM f WHERE NOT apart AND (by_rooms OR named AND informative AND same) AND (nr >= 3 OR informative))"""


@query(_SHEETS + " SELECT object, pd, rd, shared, round(containment, 3) AS containment, round(similarity, 3) AS similarity, how, score, place FROM (SELECT *, row_number() OVER (PARTITION BY object, pd ORDER BY score DESC, shared DESC, rd) AS place FROM k) WHERE place <= 12")
def sheet_pairs(spark, sf_dir):
    from tristage.operators import sheets

    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    none = F.array().cast("array<string>")
    text = lambda p, m: F.concat(F.lit(p), (k % m).cast("string"))
    s = o.select(
        (F.col("o_custkey") % 40).alias("object"),
        k.alias("sheet"),
        F.when(k % 2 == 0, "PD").otherwise("RD").alias("stage"),
        F.when(k % 5 == 0, "OTHER").when((k % 5).isin(1, 2), "AR").otherwise("OV").alias("section"),
        F.when(k % 7 == 0, none).otherwise(F.array(text("w", 9), text("v", 4), F.lit("план"))).alias("words"),
        F.array(text("n", 3)).alias("numbers"),
        F.when(k % 6 == 0, none).when(k % 6 == 1, F.array(F.lit("VENT"))).when(k % 6 == 2, F.array(F.lit("VENT"), F.lit("HEAT"))).otherwise(F.array(F.lit("WATER"))).alias("tags"),
    )
    rooms = table(spark, sf_dir, "lineitem").join(s.select("object", "sheet"), F.col("l_orderkey") == F.col("sheet")).select("object", "sheet", (F.col("l_partkey") % 12).alias("room"))
    return sheets.pairs(s, rooms, ["object"])

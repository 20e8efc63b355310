"""Queries of normalisation and of places, in the manner of catalogue.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tristage.functions import normalize as N
from tristage.functions import text as T
from tristage.operators import spatial
from tristage.plans.catalogue import query, table


@query("SELECT l_partkey, l_linenumber, s AS raw, array_to_string(list_transform(regexp_extract_all(s, '[0-9]+'), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), '.') AS location FROM (SELECT DISTINCT l_partkey, l_linenumber, 'axis 00' || l_linenumber || '-0' || l_partkey AS s FROM lineitem)")
def norm_location(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", F.concat(F.lit("axis 00"), "l_linenumber", F.lit("-0"), "l_partkey").alias("raw")).distinct()
    return rows.withColumn("location", N.location(F.col("raw")))


@query("SELECT o_orderkey, CAST(replace(replace(s, ' ', ''), ',', '.') AS DOUBLE) AS number FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || ' 200,25' AS s FROM orders)")
def parse_number(spark, sf_dir):
    raw = F.concat(F.floor(F.col("o_totalprice") / 1000).cast("bigint").cast("string"), F.lit(" 200,25"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.number(raw).alias("number"))


@query("""WITH u(unit, dimension, size) AS (VALUES ('mm', 'length', 0.001::DOUBLE), ('cm', 'length', 0.01::DOUBLE), ('m', 'length', 1.0::DOUBLE), ('km', 'length', 1000.0::DOUBLE), ('g', 'mass', 0.001::DOUBLE), ('kg', 'mass', 1.0::DOUBLE), ('t', 'mass', 1000.0::DOUBLE)),
 p AS (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 'mm' WHEN 1 THEN 'cm' WHEN 2 THEN 'kg' ELSE 'inch' END AS unit FROM part)
 SELECT p_partkey, p.unit, CASE WHEN u.dimension = 'length' THEN round(p_size * u.size / 1.0, 6) END AS converted FROM p LEFT JOIN u USING (unit)""")
def convert_units(spark, sf_dir):
    k = F.col("p_size") % 4
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(k == 0, "mm").when(k == 1, "cm").when(k == 2, "kg").otherwise("inch").alias("unit"), F.lit("m").alias("wanted"))
    return N.convert(rows, "p_size", "unit", "wanted").select("p_partkey", "unit", "converted")


@query("SELECT p_partkey, p_name AS base, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS revision FROM part")
def revision_key(spark, sf_dir):
    rev = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("_rev"), F.col("p_size")))
    base, n = N.revision_key(F.concat("p_name", rev, F.lit(".pdf")))
    return table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), n.alias("revision"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 1900 + p_size + 50 WHEN p_size < 30 THEN 2000 + p_size ELSE 1900 + p_size END AS year FROM part")
def edition_year(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mark = F.when(F.col("p_size") % 5 == 0, (1950 + F.col("p_size")).cast("string")).otherwise(F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return p.select("p_partkey", N.edition_year(F.concat(F.lit("N 12-"), mark)).alias("year"))


@query("SELECT term, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS term FROM part) GROUP BY term")
def observed_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split(N.fold(F.col("p_name")), " ")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[ \\n]+'), lambda x: x <> '') AS w FROM conversations),
 s AS (SELECT conv_id, turn, CASE WHEN len(w) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
 p AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s)
 SELECT conv_id, turn, len(s) AS n, round(CASE WHEN len(list_distinct(list_concat(s, b))) = 0 THEN 0.0 ELSE len(list_intersect(s, b)) / len(list_distinct(list_concat(s, b))) END, 6) AS similarity FROM p WHERE b IS NOT NULL""")
def masked_shingles(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", N.masked_shingles(F.col("text")).alias("s"))
    s = s.withColumn("b", F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return s.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.round(T.jaccard(F.col("s"), F.col("b")), 6).alias("similarity"))


@query("""WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations), p AS (SELECT *, lag(l) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM l)
 SELECT conv_id, turn, len(list_intersect(list_distinct(l), list_distinct(b))) AS same, len(list_distinct(l)) - len(list_intersect(list_distinct(l), list_distinct(b))) AS added, len(list_distinct(b)) - len(list_intersect(list_distinct(l), list_distinct(b))) AS removed FROM p WHERE b IS NOT NULL""")
def page_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("l"))
    rows = rows.withColumn("b", F.lag("l").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    n = lambda c: F.size(c).cast("long")
    return rows.select("conv_id", "turn", n(F.array_intersect("l", "b")).alias("same"), n(F.array_except("l", "b")).alias("added"), n(F.array_except("b", "l")).alias("removed"))


@query("""WITH d AS (SELECT a.p_brand, a.p_partkey, b.p_partkey AS k, round(sqrt(power(a.p_size - b.p_size, 2) + power(a.p_retailprice - b.p_retailprice, 2)), 6) AS d FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey)
 SELECT p_brand, p_partkey, k AS nearest, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_partkey ORDER BY d, k) AS r FROM d WHERE d <= 20) WHERE r = 1""")
def nearest_mark(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return spatial.nearest(p, p, ["p_brand"], "p_partkey", "p_size", "p_retailprice", 20.0)


@query("""WITH r AS (SELECT DISTINCT user_id, CAST(floor(value) AS INTEGER) AS s, CAST(floor(value) AS INTEGER) + event_id % 3 AS e FROM events),
 w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM w)
 SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY user_id, run""")
def merge_lines(spark, sf_dir):
    s = F.floor("value").cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", s.alias("s"), (s + F.col("event_id") % 3).alias("e")).distinct()
    return spatial.merged(rows, ["user_id"], "s", "e")


@query("SELECT user_id, arg_min(event_id, event_id) FILTER (event_type = 'view') AS view, arg_min(value, event_id) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def first_known(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("event_id")).alias("view"), F.when(F.col("event_type") == "error", F.col("value")).alias("error"))
    return spatial.first_known(e, ["user_id"], ["event_id"], ["view", "error"])


@query("SELECT o_orderkey, count(l_orderkey) AS inside FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 365 DAY GROUP BY 1")
def contained_words(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    inside = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"))
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & inside, "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("inside"))


@query("""WITH t AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda x: x <> '')) AS term FROM benchmark),
 d AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS term FROM documents)
 SELECT item_id, count(*) AS missing FROM t WHERE term NOT IN (SELECT term FROM d WHERE term IS NOT NULL) GROUP BY item_id""")
def missing_terms(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.word_set(F.col("text"))).alias("term"))
    d = table(spark, sf_dir, "documents").select(F.explode(T.word_set(F.col("text"))).alias("term")).distinct()
    return t.join(d, "term", "left_anti").groupBy("item_id").agg(F.count("*").alias("missing"))

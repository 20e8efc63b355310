"""Queries of page layout and of chains of editions, in the manner of catalogue.py.

A supplier's line items with one line number are the words of a page: quantity and discount place them, the part names
them. Parts of a brand are the documents of an object.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tristage.operators import chains, layout, rooms
from tristage.plans.catalogue import query, table

BY = ["f", "page"]
_MARKS = ["КЖ", "АР", "ОВ", "ТОМ"]
_STAMPS = ["В", "производство", "работ", "архивный", "№7", "страница", "12", "из", "40", "ГИП", "-", " "]


def _words(spark, sf_dir):
    """Words of two editions: the second has lost some and moved the rest by one of two amounts."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
    n = lambda c, k: F.round(F.col(c) * 100) * k
    w = li.select(F.col("l_suppkey").alias("f"), F.col("l_linenumber").alias("page"), F.row_number().over(order).alias("word"), F.concat(F.lit("w"), F.col("l_partkey") % 61).alias("t"), (100 + F.col("l_quantity") * 20 + F.col("l_partkey") % 10).alias("x"), (80 + n("l_discount", 60) + n("l_tax", 7)).alias("y"), F.col("l_orderkey").alias("o"))
    half = F.col("o") % 2 == 0
    new = w.where("o % 11 <> 0").select(*BY, F.col("word").alias("other"), "t", (F.col("x") + F.when(half, 30).otherwise(-45)).alias("x"), (F.col("y") + F.when(half, 12).otherwise(70)).alias("y"))
    return w, new


_WORDS = """WITH w AS (SELECT l_suppkey AS f, l_linenumber AS page, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice, l_quantity) AS word,
 'w' || (l_partkey % 61) AS t, 100 + l_quantity * 20 + l_partkey % 10 AS x, 80 + round(l_discount * 100) * 60 + round(l_tax * 100) * 7 AS y, l_orderkey AS o FROM lineitem),
 n AS (SELECT f, page, word AS other, t, x + CASE WHEN o % 2 = 0 THEN 30 ELSE -45 END AS x, y + CASE WHEN o % 2 = 0 THEN 12 ELSE 70 END AS y FROM w WHERE o % 11 <> 0)"""
_VOTES = (
    _WORDS
    + """, a AS (SELECT * FROM w QUALIFY count(*) OVER (PARTITION BY f, page, t) <= 3), b AS (SELECT * FROM n QUALIFY count(*) OVER (PARTITION BY f, page, t) <= 3),
 v AS (SELECT a.f, a.page, a.word, b.other, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, CAST(round_even((b.x - a.x) / 4, 0) AS BIGINT) AS i, CAST(round_even((b.y - a.y) / 4, 0) AS BIGINT) AS j FROM a JOIN b USING (f, page, t)),
 c AS (SELECT f, page, i, j, count(*) AS n, min((word, other)) AS first FROM v GROUP BY ALL),
 s AS (SELECT c.f, c.page, c.i, c.j, any_value(c.n) AS n, any_value(c.first) AS first, count(*) AS near, count(DISTINCT word) AS voters, median(dx) AS dx, median(dy) AS dy, min(x) - 60 AS x0, min(y) - 60 AS y0, max(x) + 60 AS x1, max(y) + 60 AS y1
  FROM c JOIN v ON c.f = v.f AND c.page = v.page AND abs(c.i - v.i) <= 1 AND abs(c.j - v.j) <= 1 GROUP BY c.f, c.page, c.i, c.j),
 r AS (SELECT *, row_number() OVER (PARTITION BY f, page ORDER BY n DESC, first) AS rank FROM s)"""
)


@query(_VOTES + " SELECT f, page, dx, dy FROM r WHERE rank = 1 AND near >= 3")
def page_shift(spark, sf_dir):
    return layout.peaks(*_words(spark, sf_dir), BY, first=True).select(*BY, "dx", "dy")


@query(_VOTES + """, q AS (SELECT *, min(CASE WHEN near < 6 THEN rank END) OVER (PARTITION BY f, page) AS stop FROM r), g AS (SELECT * FROM q WHERE stop IS NULL OR rank < stop),
 h AS (SELECT g.f, g.page, g.rank, count(*) AS held FROM g JOIN a ON a.f = g.f AND a.page = g.page AND a.x BETWEEN x0 AND x1 AND a.y BETWEEN y0 AND y1 GROUP BY ALL)
 SELECT f, page, dx, dy, x0 AS rx0, y1 AS ry1 FROM g JOIN h USING (f, page, rank) WHERE voters >= 0.3 * greatest(held, 1) QUALIFY row_number() OVER (PARTITION BY f, page ORDER BY rank) = 1""")
def part_shift(spark, sf_dir):
    return layout.peaks(*_words(spark, sf_dir), BY, first=False).select(*BY, "dx", "dy", "rx0", "ry1")


#: A box grows to the frame of all that it reaches, equal frames are one, until nothing grows, in however many rounds.
_ZONES = """, g AS (SELECT f, page, list(DISTINCT {'x0': x - 10, 'y0': y - 4, 'x1': x + 10, 'y1': y + 4}) AS z FROM w GROUP BY f, page),
 u AS (SELECT f, page, z, false AS still FROM g UNION ALL SELECT f, page, n, len(n) = len(z) AND len(list_filter(n, lambda a: NOT list_contains(z, a))) = 0 FROM (
  SELECT f, page, z, list_distinct(list_transform(list_transform(z, lambda a: list_filter(z, lambda b: a.x0 - 12 <= b.x1 AND b.x0 - 12 <= a.x1 AND a.y0 - 12 <= b.y1 AND b.y0 - 12 <= a.y1)),
   lambda m: {'x0': list_min(list_transform(m, lambda b: b.x0)), 'y0': list_min(list_transform(m, lambda b: b.y0)), 'x1': list_max(list_transform(m, lambda b: b.x1)), 'y1': list_max(list_transform(m, lambda b: b.y1))})) AS n FROM u WHERE NOT still)),
 e AS (SELECT f, page, unnest(z) AS b FROM u WHERE still)
 SELECT e.f, e.page, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, count(*) AS n FROM e JOIN w ON w.f = e.f AND w.page = e.page AND w.x BETWEEN b.x0 AND b.x1 AND w.y BETWEEN b.y0 AND b.y1 GROUP BY ALL"""


@query(_WORDS.replace("WITH w", "WITH RECURSIVE w") + _ZONES)
def word_zones(spark, sf_dir):
    w, _ = _words(spark, sf_dir)
    boxes = w.select(*BY, F.col("word").alias("box"), (F.col("x") - 10).alias("x0"), (F.col("y") - 4).alias("y0"), (F.col("x") + 10).alias("x1"), (F.col("y") + 4).alias("y1"))
    return layout.zones(boxes, BY, layout.ZONE_GAP)


def _stamped(spark, sf_dir):
    w, _ = _words(spark, sf_dir)
    t = F.element_at(F.array(*map(F.lit, _STAMPS)), (F.col("word") % len(_STAMPS) + 1).cast("int"))
    y = F.when(F.floor(F.col("word") / len(_STAMPS)) % 2 == 0, F.floor(F.col("word") / len(_STAMPS)) * 90.0).otherwise(F.col("y"))
    box = {"x0": F.col("x") - 10, "y0": F.col("y") - 4, "x1": F.col("x") + 10, "y1": F.col("y") + 4}
    return w.withColumns({"t": t, "y": y}).withColumns(box).select(*BY, "word", "t", "x0", "y0", "x1", "y1", F.lit(1190.0).alias("width"), F.lit(842.0).alias("height"))


_LIST = ", ".join(f"'{s}'" for s in _STAMPS)
_MM = "72 / 25.4"


@query(_WORDS + f""", k AS (SELECT f, page, word, trim([{_LIST}][word % 12 + 1]) AS t, x, CASE WHEN word // 12 % 2 = 0 THEN word // 12 * 90.0 ELSE y END AS y FROM w),
 l AS (SELECT * REPLACE (CASE WHEN t = '-' THEN '–' ELSE t END AS t) FROM k WHERE t <> ''),
 p AS (SELECT *, {", ".join(f"{fn}({c}, {k}) OVER o AS {c}{s}" for fn, k, s in (("lag", 1, "b"), ("lead", 1, "1"), ("lead", 2, "2"), ("lead", 3, "3")) for c in "txy")} FROM l WINDOW o AS (PARTITION BY f, page ORDER BY word)),
 q AS (SELECT *, CASE WHEN tb IS NULL OR t1 IS NULL THEN NULL
  WHEN starts_with(t, 'производств') AND tb = 'В' AND abs(yb - y) <= 3 AND starts_with(t1, 'работ') AND abs(y1 - y) <= 3 AND NOT coalesce(abs(y2 - y) <= 3 AND x2 > x1, false) THEN {{'x0': xb - 10 - 30 * {_MM}, 'y0': least(yb, y1) - 4 - 6 * {_MM}, 'x1': x1 + 10 + 40 * {_MM}, 'y1': greatest(yb, y1) + 4 + 65 * {_MM}}}
  WHEN starts_with(t, 'архивн') AND starts_with(t1, '№') AND abs(y1 - y) <= 3 THEN {{'x0': x - 10 - 15 * {_MM}, 'y0': least(y, y1) - 4 - 15 * {_MM}, 'x1': x1 + 10 + 60 * {_MM}, 'y1': greatest(y, y1) + 4 + 10 * {_MM}}}
  WHEN t = 'страница' AND t1 = '12' AND t2 = 'из' AND t3 = '40' AND abs(y3 - y) <= 3 THEN {{'x0': x - 10 - 60 * {_MM}, 'y0': least(y, y3) - 4 - 12 * {_MM}, 'x1': x3 + 10 + 30 * {_MM}, 'y1': greatest(y, y3) + 4 + 8 * {_MM}}} END AS stamp FROM p),
 s AS (SELECT f, page, list(stamp) FILTER (stamp IS NOT NULL) AS stamps, coalesce(bool_or(t = 'ГИП' AND x >= 1190 - 190 * {_MM} AND y >= 842 - 60 * {_MM}), false) AS first FROM q GROUP BY ALL)
 SELECT f, page, word, t, (x >= 1190 - 190 * {_MM} AND y >= 842 - CASE WHEN first THEN 60 ELSE 25 END * {_MM}) OR x <= 21 * {_MM} OR y <= 5 * {_MM} OR y >= 842 - 5 * {_MM} OR x >= 1190 - 5 * {_MM} OR (x >= 1190 - 45 * {_MM} AND y <= 15 * {_MM})
  OR len(list_filter(coalesce(stamps, []), lambda r: x BETWEEN r.x0 AND r.x1 AND y BETWEEN r.y0 AND r.y1)) > 0 AS service FROM q JOIN s USING (f, page)""")
def service_words(spark, sf_dir):
    return layout.service_zone(_stamped(spark, sf_dir), BY).select(*BY, "word", "t", "service")


@query()
def placed_pages(spark, sf_dir):
    """Two editions of every page, with all rounds of shifts: tests hold the operator against pages that are known."""
    w, new = _words(spark, sf_dir)
    box = {"x0": F.col("x") - 10, "y0": F.col("y") - 4, "x1": F.col("x") + 10, "y1": F.col("y") + 4, "width": F.lit(1290.0), "height": F.lit(942.0)}
    sides = [layout.service_zone(df.withColumns(box), BY) for df in (w, new.withColumnRenamed("other", "word"))]
    return layout.place(*sides, BY).pages.drop("offsets")


def _families(spark, sf_dir):
    """Families of a brand: by stage, building and mark of its parts; those with a part of one size may be one."""
    k = F.col("p_partkey")
    mark = F.concat(F.element_at(F.array(*map(F.lit, _MARKS)), (k % 4 + 1).cast("int")), F.when(k % 5 > 1, (k % 3 + 1).cast("string")).otherwise(""))
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("object"), k.alias("place"), mark.alias("mark"), F.when(k % 7 < 2, F.concat(F.lit("К"), k % 7)).otherwise("").alias("building"), "p_size")
    key = ["object", "mark", "building"]
    fams = p.groupBy(*key).agg(F.min("place").alias("family"), F.collect_set("p_size").alias("sizes"))
    groups = fams.select("object", "family", F.array("mark").alias("marks"), F.when(F.col("building") == "", F.array().cast("array<string>")).otherwise(F.array("building")).alias("parts"))
    each = fams.select("object", "family", F.explode("sizes").alias("size"))
    edges = each.withColumnRenamed("family", "a").join(each.withColumnRenamed("family", "b"), ["object", "size"]).where("a < b").select("object", "a", "b").distinct()
    return groups, edges


@query("""WITH RECURSIVE p AS (SELECT p_brand AS object, p_partkey AS k, ['КЖ', 'АР', 'ОВ', 'ТОМ'][p_partkey % 4 + 1] || CASE WHEN p_partkey % 5 > 1 THEN CAST(p_partkey % 3 + 1 AS VARCHAR) ELSE '' END AS mark, CASE WHEN p_partkey % 7 < 2 THEN 'К' || (p_partkey % 7) ELSE '' END AS building, p_size FROM part),
 f AS (SELECT object, mark, building, min(k) AS family, row_number() OVER (PARTITION BY object ORDER BY min(k)) AS i FROM p GROUP BY object, mark, building),
 l AS (SELECT object, list(family ORDER BY i) AS fams, list(mark ORDER BY i) AS marks, list(building ORDER BY i) AS buildings FROM f GROUP BY object),
 s AS (SELECT DISTINCT object, i, p_size FROM p JOIN f USING (object, mark, building)),
 e AS (SELECT object, a, b, row_number() OVER (PARTITION BY object ORDER BY a, b) AS step FROM (SELECT DISTINCT x.object, x.i AS a, y.i AS b FROM s x JOIN s y ON x.object = y.object AND x.p_size = y.p_size AND x.i < y.i)),
 u AS (SELECT object, 0 AS step, CAST(range(1, len(fams) + 1) AS BIGINT[]) AS roots FROM l
  UNION ALL SELECT q.object, q.step, CASE WHEN q.ra <> q.rb
   AND len(list_filter(range(1, len(roots) + 1), lambda x: roots[x] = ra AND len(list_filter(range(1, len(roots) + 1), lambda y: roots[y] = rb AND NOT (marks[x] = marks[y] OR starts_with(marks[x], 'ТОМ') OR starts_with(marks[y], 'ТОМ') OR (marks[x][1:2] = marks[y][1:2] AND (length(marks[x]) = 2 OR length(marks[y]) = 2))))) > 0)) = 0
   AND (len(pa) = 0 OR len(pb) = 0 OR pa = pb) THEN list_transform(roots, lambda r: CASE WHEN r = rb THEN ra ELSE r END) ELSE roots END
  FROM (SELECT u.object, e.step, u.roots, l.marks, u.roots[e.a] AS ra, u.roots[e.b] AS rb,
    list_sort(list_distinct(list_filter(list_transform(range(1, len(u.roots) + 1), lambda x: CASE WHEN u.roots[x] = u.roots[e.a] THEN l.buildings[x] ELSE '' END), lambda b: b <> ''))) AS pa,
    list_sort(list_distinct(list_filter(list_transform(range(1, len(u.roots) + 1), lambda x: CASE WHEN u.roots[x] = u.roots[e.b] THEN l.buildings[x] ELSE '' END), lambda b: b <> ''))) AS pb
   FROM u JOIN e ON e.object = u.object AND e.step = u.step + 1 JOIN l ON l.object = u.object) q),
 z AS (SELECT object, arg_max(roots, step) AS roots FROM u GROUP BY object)
 SELECT object, family, fams[roots[i]] AS root FROM z JOIN l USING (object) JOIN f USING (object)""")
def merged_families(spark, sf_dir):
    groups, edges = _families(spark, sf_dir)
    return chains.guarded_merge(groups, edges, ["object"])


@query("""WITH RECURSIVE d AS (SELECT p_brand AS o, p_partkey AS file_id, lag(p_partkey) OVER (PARTITION BY p_brand, p_size % 5 ORDER BY p_partkey) AS predecessor FROM part),
 w AS (SELECT o, file_id, file_id AS at, 0 AS rank FROM d UNION ALL SELECT w.o, w.file_id, d.predecessor, w.rank + 1 FROM w JOIN d ON d.o = w.o AND d.file_id = w.at AND d.predecessor IS NOT NULL)
 SELECT o AS brand, file_id, max(rank) AS rank FROM w GROUP BY ALL""")
def chain_places(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    before = F.lag("p_partkey").over(Window.partitionBy("p_brand", F.col("p_size") % 5).orderBy("p_partkey"))
    return chains.chain_index(p.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("file_id"), before.alias("predecessor")), ["brand"])


_LEFT, _RIGHT = 0.05, 0.55


def _room_words(spark, sf_dir):
    """Two tables side by side on the page of each brand, with a row for each part: some have no area or no category."""
    place = Window.partitionBy("p_brand", F.col("p_partkey") % 2).orderBy("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("i", F.row_number().over(place))
    x, y = F.when(F.col("p_partkey") % 2 == 0, _LEFT).otherwise(_RIGHT), 0.1 + F.col("i") * 0.012
    number = (F.when(F.col("p_partkey") % 2 == 0, 99).otherwise(499) + F.col("i")).cast("string")
    one = lambda dx, t, n: F.struct(F.lit(n).alias("n"), F.lit(dx).alias("dx"), t.alias("t"))
    names = F.transform(F.split("p_name", " "), lambda t, j: F.struct((F.lit(10) + j).alias("n"), (F.lit(0.08) + j * 0.05).alias("dx"), t.alias("t")))
    cells = F.concat(F.array(one(0.0, number, 1)), names, F.when(F.col("p_size") % 5 > 0, F.array(one(0.28, F.concat(F.col("p_size"), F.lit(",5")), 50))).otherwise(F.array().cast("array<struct<n:int,dx:double,t:string>>")), F.when(F.col("p_size") % 3 == 0, F.array(one(0.34, F.lit("В2"), 60))).otherwise(F.array().cast("array<struct<n:int,dx:double,t:string>>")))
    body = p.select("p_brand", (F.col("p_partkey") * 100).alias("o"), x.alias("x"), y.alias("y"), F.explode(cells).alias("c")).select("p_brand", (F.col("o") + F.col("c.n")).alias("word"), "c.t", (F.col("x") + F.col("c.dx")).alias("x0"), F.col("y").alias("y0"))
    head = [(x0 + dx, 0.09, t) for x0 in (_LEFT, _RIGHT) for dx, t in ((-0.02, "Номер"), (0.02, "пом."), (0.09, "Наименование"), (0.28, "Площадь,"), (0.34, "Кат."))] + [(_LEFT, 0.06, "Экспликация"), (_LEFT + 0.1, 0.06, "помещений")]
    heads = F.array(*(F.struct(F.lit(-i).alias("word"), F.lit(t).alias("t"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0")) for i, (x0, y0, t) in enumerate(head)))
    top = p.select("p_brand").distinct().select("p_brand", F.explode(heads).alias("h")).select("p_brand", "h.*")
    return body.unionByName(top).withColumns({"x1": F.col("x0") + 0.03, "y1": F.col("y0") + 0.006})


@query("""WITH n AS (SELECT p_brand AS brand, p_partkey % 2 AS side, CASE WHEN p_partkey % 2 = 0 THEN 99 ELSE 499 END + row_number() OVER (PARTITION BY p_brand, p_partkey % 2 ORDER BY p_partkey) AS number, p_name AS name,
 CASE WHEN p_size % 5 > 0 THEN p_size + 0.5::DOUBLE END AS area, CASE WHEN p_size % 3 = 0 THEN 'В2' END AS category FROM part),
 f AS (SELECT *, count(*) OVER (PARTITION BY brand, side, length(CAST(number AS VARCHAR))) AS alike FROM n),
 r AS (SELECT * FROM f WHERE number BETWEEN 10 AND 999 OR (number BETWEEN 1000 AND 9999 AND alike >= 2))
 SELECT brand, CAST(number AS VARCHAR) AS number, name, area, category, true AS labeled FROM r QUALIFY row_number() OVER (PARTITION BY brand, number ORDER BY side) = 1""")
def room_tables(spark, sf_dir):
    """What the tables were made of must come back from the boxes of their words, by the rules of rooms.rooms(): two or
    three digits are a number, four if the column repeats that form, more never; of tables side by side that repeat a
    number the first has the room."""
    found, _ = rooms.rooms(_room_words(spark, sf_dir), ["p_brand"])
    return found.select(F.col("p_brand").alias("brand"), "number", "name", "area", "category", "labeled")

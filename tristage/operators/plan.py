"""Rooms on plans with their names, marks of systems and positions (row 183), and whether a changed sheet says so (row 195).

Words of a plan: the keys of a page, word (reading order), t, x0, y0, x1, y1 as shares of the page, conf (null: sure),
width_mm and height_mm of the sheet (null: unknown). Distances are in heights of the line of a room's number, so they hold
on any format. Numbers and what may belong to them meet in grid cells as wide as the farthest reach on the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.operators.graph import greedy
from tristage.sources.shared import cut

#: Forms of numbers, positions, marks and words, Latin twins of Cyrillic letters, distances in heights of a
#: line and, where the sheet's size is unknown, as shares of the page.
NUM = r"^([0-9]{2,3}(?:\.[0-9]{1,2})?)[,;]?$"
POS, PREFIX = r"(?iu)^(?:поз|оз)\.?\s?[0-9]{1,4}$", r"(?iu)^(?:поз|оз|п)\.?$"
MARK = r"^(?:П|В|ПВ|ВЕ|ДУ|К|Т)\s?[0-9]{1,2}(?:\.[0-9]{1,2})?$"
WORD = r"^[А-ЯЁа-яё][А-ЯЁа-яё\-]{3,}$"
_EDGES = r"^[ \t\r\n\[\]()«»\"'|;:,.?!/\\“”„`~]+|[ \t\r\n\[\]()«»\"'|;:,.?!/\\“”„`~]+$"
LATIN, CYRILLIC = "BPTKEACHMOX", "ВРТКЕАСНМОХ"
LINE, NAME_X, BELOW_Y, BELOW_X, RADIUS, WORD_MM = 0.6, 7.6, 2.6, 3.4, 6.0, 2.5
SHARES = {"line": 0.005, "name": 0.045, "below_y": 0.022, "below_x": 0.020, "radius": 0.05}
LEAST_CONF, NAME_MOST, SMALL_CHANGE, SUBSTANTIAL = 20, 70, 3, 10


def clean(t: Column) -> Column:
    return F.regexp_replace(F.coalesce(t, F.lit("")), _EDGES, "")


def words_of(words: DataFrame, page: list[str]) -> DataFrame:
    """Words that were read well enough, with "pos." and the number behind it as one word; x, y: the centre."""
    w = words.where((F.coalesce("conf", F.lit(100)) >= LEAST_CONF) & (F.trim(F.coalesce("t", F.lit(""))) != "")).withColumn("_c", clean(F.col("t")))
    w = cut(w.withColumn("_y", (F.col("y0") + F.col("y1")) / 2))
    p = w.where(F.col("_c").rlike(PREFIX)).select(*page, F.col("word").alias("_p"), *(F.col(c).alias(f"_p{c}") for c in ("x0", "y0", "x1", "y1")), F.col("_y").alias("_py"))
    n = w.where(F.col("_c").rlike("^[0-9]{1,4}$"))
    met = p.join(n, page).where((F.col("x0") - F.col("_px1")).between(-0.005, 0.025) & (F.abs(F.col("_y") - F.col("_py")) <= 0.01))
    pairs = cut(greedy(met.select(*page, "_p", F.col("word").alias("_n")), page, [F.col("_p"), F.col("_n")], "_p", "_n"))
    gone = pairs.select(*page, F.explode(F.array("_p", "_n")).alias("word"))
    merged = pairs.join(p, [*page, "_p"]).join(w.withColumnRenamed("word", "_n"), [*page, "_n"])
    least = lambda c: F.least(c, f"_p{c}").alias(c)
    most = lambda c: F.greatest(c, f"_p{c}").alias(c)
    merged = merged.select(*page, F.col("_p").alias("word"), F.concat(F.lit("поз."), "_c").alias("t"), least("x0"), least("y0"), most("x1"), most("y1"), "width_mm", "height_mm")
    lone = w.join(gone, [*page, "word"], "left_anti").withColumn("t", F.when(F.col("_c").rlike(r"^8[0-9]\.[0-9]{1,2}$"), F.concat(F.lit("В"), F.substring("_c", 2, 20))).otherwise(F.col("t")))
    out = lone.select(*merged.columns).unionByName(merged)
    return out.withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2, "c": clean(F.col("t"))})


def plan_rooms(words: DataFrame, page: list[str], least: int = 1) -> DataFrame:
    """page, number, name, marks, positions and the box of each room on a plan (row 183).

    A mark or position belongs to the one number that is nearest within reach, the first of equals. A name is made of the
    words on the number's line or just below it, `least` of them at least. A number that stands twice, in a table and on
    the plan, is one room: the longest name, all marks, the box of the first that has marks.
    """
    w = words_of(words, page)
    known = F.col("width_mm").isNotNull() & F.col("height_mm").isNotNull()
    line = F.when(F.col("y1") > F.col("y0"), (F.col("y1") - F.col("y0")) * F.col("height_mm")).otherwise(WORD_MM)
    by = lambda k, share, over: F.when(known, k * line / F.col(over)).otherwise(SHARES[share])
    w = cut(w.withColumns({"sx": F.when(known, F.col("width_mm")).otherwise(1.0), "sy": F.when(known, F.col("height_mm")).otherwise(1.0)}))
    nums = w.where(F.col("c").rlike(NUM)).withColumns({"number": F.regexp_extract("c", NUM, 1), "dl": by(LINE, "line", "height_mm"), "dn": by(NAME_X, "name", "width_mm"), "db": by(BELOW_Y, "below_y", "height_mm"), "dx": by(BELOW_X, "below_x", "width_mm"), "r": F.when(known, RADIUS * line).otherwise(SHARES["radius"])})
    far = nums.groupBy(*page).agg(F.max(F.greatest("r", F.col("dn") * F.col("sx"), F.col("db") * F.col("sy"))).alias("_far"))
    cell = lambda c, s: F.floor(F.col(c) * F.col(s) / F.col("_far")).cast("long")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    nums = cut(nums.join(far, page).withColumns({"_i": cell("x", "sx"), "_j": cell("y", "sy")}))
    n = nums.select(*page, "_i", "_j", F.col("word").alias("n"), F.col("x").alias("nx"), F.col("y").alias("ny"), "number", "dl", "dn", "db", "dx", "r")
    others = w.join(far, page).withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around)).withColumns({"_i": cell("x", "sx") + F.col("_a"), "_j": cell("y", "sy") + F.col("_b")})
    met = others.join(n, [*page, "_i", "_j"]).where("word <> n")
    # marks and positions: each to its nearest number
    parts = F.filter(F.split("t", "[/,]"), lambda p: F.trim(p) != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array("t"))

    def item(p: Column) -> Column:
        bare = clean(p)
        norm = F.translate(bare, LATIN, CYRILLIC)
        norm = F.when(norm.rlike(r"^8[0-9](?:\.[0-9]{1,2})?$"), F.concat(F.lit("В"), F.substring(norm, 2, 20))).otherwise(norm)
        kind = F.when(norm.rlike(MARK), "mark").when(bare.rlike(POS), "position")
        return F.struct(kind.alias("kind"), F.replace(F.when(kind == "mark", norm).otherwise(bare), F.lit(" "), F.lit("")).alias("v"))

    items = F.filter(F.transform(parts, item), lambda x: x.kind.isNotNull())
    d = F.sqrt(F.pow((F.col("nx") - F.col("x")) * F.col("sx"), 2) + F.pow((F.col("ny") - F.col("y")) * F.col("sy"), 2))
    near = met.withColumn("_items", items).where(F.size("_items") > 0).withColumn("_d", d).where("_d < r")
    own = near.groupBy(*page, "word").agg(F.min(F.struct("_d", "n")).alias("_m"), F.first("_items").alias("_items"))
    held = own.select(*page, F.col("_m.n").alias("word"), F.explode("_items").alias("_x")).groupBy(*page, "word").agg(*(F.sort_array(F.collect_set(F.when(F.col("_x.kind") == k, F.col("_x.v")))).alias(c) for k, c in (("mark", "_marks"), ("position", "positions"))))
    same = (F.abs(F.col("y") - F.col("ny")) <= F.col("dl")) & (F.abs(F.col("x") - F.col("nx")) <= F.col("dn"))
    below = (F.col("y") > F.col("ny")) & (F.col("y") - F.col("ny") <= F.col("db")) & (F.abs(F.col("x") - F.col("nx")) <= F.col("dx"))
    named = met.where((same | below) & F.col("c").rlike(WORD)).groupBy(*page, F.col("n").alias("word")).agg(F.sort_array(F.collect_list(F.struct("y", "x", "c"))).alias("_n"))
    rows = nums.join(named, [*page, "word"], "left").join(held, [*page, "word"], "left")
    rows = rows.where(F.coalesce(F.size("_n"), F.lit(0)) >= least)
    none = F.array().cast("array<string>")
    marks = F.coalesce("_marks", none)
    dotted = F.transform(F.filter(marks, lambda m: m.contains(".")), lambda m: F.substring_index(m, ".", 1))
    lost = lambda m: F.regexp_replace(m, r"^([А-ЯA-Z]+[0-9])([0-9])$", "$1.$2")
    marks = F.transform(marks, lambda m: F.when((lost(m) != m) & F.array_contains(dotted, F.substring_index(lost(m), ".", 1)), lost(m)).otherwise(m))
    name = F.substring(F.array_join(F.transform(F.coalesce("_n", F.array().cast("array<struct<y:double,x:double,c:string>>")), lambda s: s.c), " "), 1, NAME_MOST)
    rows = rows.select(*page, "word", "number", name.alias("name"), marks.alias("marks"), F.coalesce("positions", none).alias("positions"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    return rows.groupBy(*page, "number").agg(
        F.max(F.struct(F.char_length("name").alias("l"), (-F.col("word")).alias("w"), "name"))["name"].alias("name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("marks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"),
        F.min(F.struct((F.size("marks") == 0).alias("e"), "word", "box")).box.alias("box"),
    )


def content_changed(row: Column) -> Column:
    """Whether a sheet's content changed, not only its service fields; null: not known.

    row: status, layout (null: not compared by place), removed, added (words of content), numbers (pairs of them).
    """
    asked = row.status.isin("CHANGED", "UNREADABLE")
    n = row.removed + row.added
    placed = F.when(n == 0, False).when((n < SMALL_CHANGE) & (row.numbers == 0), None).otherwise(True)
    return F.when(row.status.isin("ADDED", "REMOVED"), True).when(~asked, False).when(row.layout.isNull() | (row.layout == "RELAID"), None).otherwise(placed)


def registration(rows: DataFrame, old: DataFrame, stamps: DataFrame, listed: DataFrame, readable: DataFrame, by: list[str]) -> DataFrame:
    """rows with state, why, introduced and found: whether the change of each changed sheet is registered (row 195).

    New numbers of changes are those in the stamps and lists of the new edition that the old one lacks. REGISTERED: one
    stands in the sheet's stamp or beside it in a list; NOT_NEEDED: its content is the same; UNREGISTERED: it changed and
    none does; UNKNOWN with a reason otherwise. rows: by, page, sheet (its number, may be null), status, layout, removed,
    added, numbers; old: by, number; stamps: by, page, number; listed: by, sheet, number; readable: by, page (tables of
    changes that could be read). Rows of unchanged pages are left out.
    """
    new = stamps.select(*by, "number").union(listed.select(*by, "number")).distinct().join(old.select(*by, "number").distinct(), [*by, "number"], "left_anti")
    marks = new.groupBy(*by).agg(F.sort_array(F.collect_list("number")).alias("introduced"))
    some = listed.select(*by).distinct().withColumn("_listed", F.lit(True))
    gather = lambda df, k, c: df.join(new, [*by, "number"], "left_semi").groupBy(*by, k).agg(F.collect_set("number").alias(c))
    r = rows.where(F.col("status").isin("CHANGED", "UNREADABLE", "ADDED"))
    r = r.join(marks, by, "left").join(some, by, "left").join(gather(stamps, "page", "_s"), [*by, "page"], "left").join(gather(listed, "sheet", "_l"), [*by, "sheet"], "left").join(readable.select(*by, "page").distinct().withColumn("_read", F.lit(True)), [*by, "page"], "left")
    kind = dict(stamps.dtypes)["number"]
    none = F.array().cast(f"array<{kind}>")
    r = r.withColumns({"introduced": F.coalesce("introduced", none), "found": F.array_sort(F.array_union(F.coalesce("_s", none), F.coalesce("_l", none))), "_changed": content_changed(F.struct("status", "layout", "removed", "added", "numbers"))})
    big = (F.col("numbers") > 0) | (F.col("removed") + F.col("added") >= SUBSTANTIAL)
    why = F.when(~F.col("_changed"), "SAME_CONTENT").when(F.size("found") > 0, "MARKED").when(F.size("introduced") == 0, "NO_NEW_MARKS").when(F.col("sheet").isNull(), "NO_SHEET_NUMBER").when(F.col("_changed").isNull(), "NOT_COMPARED").when(F.col("_listed").isNull(), "NO_LIST").when(~F.coalesce(big, F.lit(False)), "SMALL_CHANGE").when(F.col("_read").isNull(), "STAMP_NOT_READ").when(F.col("status") == "ADDED", "NEW_SHEET").otherwise("NO_MARK")
    state = F.when(why == "SAME_CONTENT", "NOT_NEEDED").when(why == "MARKED", "REGISTERED").when(why == "NO_MARK", "UNREGISTERED").otherwise("UNKNOWN")
    return r.select(*rows.columns, state.alias("state"), why.alias("why"), "introduced", "found")

"""Room tables from the boxes of words (rows 333, 335, 337).

A table is found by the word that heads its column of names, its columns by where numbers, areas and categories stand
below, its rows by the height of its words. Pages are read together: words meet the few tables of their page, and lines,
columns and cells are groups and windows of one table.

Words: the keys of a page, word (reading order), t, x0, y0, x1, y1 as shares of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tristage.sources.shared import cut

#: Words of headers, forms of numbers, areas and categories, distances as shares of the page.
HEADER_WORDS = ["экспликация", "наименование", "площадь", "помещени"]
NUM = r"^([0-9]{2,3}(?:\.[0-9]{1,2})?)$"
NUM_CANDIDATE = r"^(?:[А-ЯA-Z]?[0-9]{1,4}(?:[.\-/][0-9]{1,3}){0,2}[а-яa-z]?|[А-ЯЁ])$"
AREA = r"^[0-9]{1,5}[.,][0-9]{1,2}$"
CATEGORY = r"^(?:[А-Я][0-9]|[А-Я][0-9][А-Я]?|Д|В[0-9])$"
ROOM_HEADER = r"(?iu)(?:^|[^а-яёa-z])(?:пом|комнат)"
TITLE = r"(?iu)(?:экспликаци|спецификаци)[0-9A-Za-zА-Яа-яЁё_]*\s+помещени"
HEADER_NUMBER = r"(?iu)(?:^|\s)(?:номер|№)"
HEAD_NUMBER, HEAD_AREA, CATEGORY_HEADS = "^(?:номер|№|n)", "^(?:площадь|s,)", ["Кат", "Кат."]
ROW_TOL, ROW_DEFAULT, HEAD_DY, TITLE_DY, HEAD_DX = 1.1, 0.006, 0.02, 0.04, 0.12
GAP_ROWS, GAP_LEAST, SHAPE_LEAST, NAME_LETTERS, NAME_MOST = 4, 0.03, 2, 3, 120


def shape(token: Column) -> Column:
    """The form of a number: 9 for a digit, A for a letter."""
    return F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), "[А-ЯA-Zа-яa-z]", "A")


def _bare(signs: str, t: Column) -> Column:
    return F.regexp_replace(t, rf"^[{signs}]+|[{signs}]+$", "")


def _head(pattern: str) -> Column:
    return F.lower(_bare(" .,:;", F.col("t"))).rlike(pattern)


def table_ends(columns: DataFrame, by: list[str]) -> DataFrame:
    """by and end: where a table ends below its heading, the middle of the first gap in its column of numbers larger than
    GAP_LEAST and GAP_ROWS times its median pitch; none (null) if the column has no such gap or under three lines.

    columns: by, y0 and t of the words in the column, below the heading. Lines before the first number do not count.
    """
    lines = columns.groupBy(*by, F.round("y0", 4).alias("_y")).agg(F.max(F.trim("t").rlike(NUM_CANDIDATE)).alias("_number"))
    order = Window.partitionBy(*by).orderBy("_y")
    begun = F.max("_number").over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("_begun", begun).where("_begun").withColumn("_next", F.lead("_y").over(order))
    steps = lines.groupBy(*by).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(F.col("_next") - F.col("_y"))).alias("_s"), F.sort_array(F.collect_list(F.struct("_y", "_next"))).alias("_p"))
    pitch = F.get("_s", F.floor(F.size("_s") / 2).cast("int"))
    gap = F.get(F.filter("_p", lambda p: p["_next"] - p["_y"] > F.greatest(F.lit(GAP_LEAST), GAP_ROWS * pitch)), 0)
    return steps.where("_n >= 3").select(*by, (gap["_y"] + (gap["_next"] - gap["_y"]) / 2).alias("end"))


def tables(words: DataFrame, page: list[str]) -> DataFrame:
    """Tables of each page (row 335): page, head (its word), left, right, y_head, name_x, end (null: not ended).

    Tables side by side end where the numbers of the next one begin; one wholly below another does not bound it.
    """
    w = words.where(F.trim("t") != "")
    about = [*page, "word", "t", "x0", "y0", "x1"]
    heads = w.where(_bare(" .,", F.col("t")).isin("Наименование", "Имя")).select(*page, F.col("word").alias("head"), _bare(" .,", F.col("t")).alias("_t"), F.col("x0").alias("hx"), F.col("x1").alias("hx1"), F.col("y0").alias("hy"))
    row = heads.join(w.select(*about), page).where((F.abs(F.col("y0") - F.col("hy")) <= HEAD_DY) & (F.col("word") != F.col("head")))
    left = (F.col("x0") < F.col("hx")) & (F.col("x0") > F.col("hx") - HEAD_DX)
    sides = row.groupBy(*page, "head").agg(F.min(F.when(left & _head(HEAD_NUMBER), F.col("x0"))).alias("number_x"), F.max(left & _head("^(?:номер|№)")).alias("_l"), F.max((F.col("x0") > F.col("hx1")) & (F.col("x0") < F.col("hx1") + HEAD_DX) & _head(HEAD_AREA)).alias("_r"))
    heads = heads.join(sides, [*page, "head"], "left").where((F.col("_t") == "Наименование") | (F.col("_l") & F.col("_r")))
    heads = cut(heads.select(*page, "head", "hx", "hy", "number_x"))
    column = heads.join(w.select(*about), page).where((F.col("x0") >= F.col("hx") - HEAD_DX) & (F.col("x0") < F.col("hx")) & (F.col("y0") > F.col("hy") + 0.002))
    heads = heads.join(table_ends(column, [*page, "head"]), [*page, "head"], "left")
    other = heads.select(*page, *(F.col(c).alias(f"_{c}") for c in ("head", "hx", "hy", "number_x", "end")))
    far = F.lit(float("inf"))
    beside = (F.col("hy") < F.coalesce("_end", far)) & (F.col("_hy") < F.coalesce("end", far)) & (F.col("_head") != F.col("head"))
    met = heads.join(other, page).where(beside)
    after = (F.col("_hx") > F.col("hx")) | ((F.col("_hx") == F.col("hx")) & (F.col("_head") > F.col("head")))
    near = met.groupBy(*page, "head").agg(F.min(F.when(after, F.struct("_hx", "_head", "_number_x"))).alias("_next"), F.max(F.when(~after, F.struct("_hx", "_head"))).alias("_before"))
    category = heads.join(w.where(_bare(" .,", F.col("t")).isin("Кат") | F.trim("t").isin(*CATEGORY_HEADS)).select(*page, F.col("x0").alias("_c0"), F.col("x1").alias("_c1")), page).where("_c0 > hx").groupBy(*page, "head").agg(F.min(F.struct("_c0", "_c1")).alias("_cat"))
    t = heads.join(near, [*page, "head"], "left").join(category, [*page, "head"], "left")
    upto = F.when(F.col("_next").isNull(), 1.0).otherwise(F.coalesce("_next._number_x", "_next._hx") - 0.004)
    t = cut(t.withColumn("_right", F.when(F.col("_cat").isNull(), upto).otherwise(F.least(upto, F.col("_cat._c1") + 0.03))))
    before = t.select(*page, F.col("head").alias("_head"), F.col("_right").alias("_prev"))
    t = t.withColumn("_head", F.col("_before._head")).join(before, [*page, "_head"], "left")
    edge = F.greatest(F.coalesce("_prev", F.lit(0.0)), F.coalesce("number_x", F.col("hx") - 0.09) - 0.002)
    return t.select(*page, "head", edge.alias("left"), F.greatest(F.col("_right"), F.col("hx") + 0.01).alias("right"), F.col("hy").alias("y_head"), F.col("hx").alias("name_x"), "end")


def explications(words: DataFrame, page: list[str]) -> DataFrame:
    """Pages that look like a room table: two of the words of its header or more stand on them."""
    seen = [F.max(F.lower("t").contains(h)).cast("int") for h in HEADER_WORDS]
    return words.groupBy(*page).agg(sum(seen[1:], seen[0]).alias("_hits")).where("_hits >= 2").select(*page)


def rooms(words: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rooms of the tables of each page and counts of their rows (row 337).

    Rooms: page, head (the table), row, number, name, area, category, labeled (the column of numbers is that of rooms).
    Which forms are numbers tells the column itself: two or three digits always, others if the column is headed as
    one of rooms and the form repeats. Of several numbers in a row each cell goes to the nearest by height. An empty cell
    is null; a row without a name of NAME_LETTERS letters is counted and gives no room; a number that tables side by
    side repeat is one room, the first. Counts: page, rows, parsed.
    """
    w = cut(words.where(F.trim("t") != "").join(explications(words, page), page, "left_semi").withColumn("t", F.trim("t")))
    t = cut(tables(w, page))
    key = [*page, "head"]
    far = F.lit(float("inf"))
    o = t.select(*page, F.col("head").alias("_head"), F.col("y_head").alias("_y"), F.col("name_x").alias("_x"), F.col("end").alias("_end"))
    below = (F.col("_y") >= F.coalesce("end", far)) & F.col("_x").between(F.col("left"), F.col("right"))
    level = (F.col("_y") < F.coalesce("end", far)) & (F.col("y_head") < F.coalesce("_end", far))
    bounds = t.join(o, page).groupBy(*key).agg(F.min(F.when(below, F.col("_y"))).alias("_below"), F.min(F.when(level, F.col("_y"))).alias("level"))
    t = t.drop("end").join(bounds, key)
    met = t.join(w, page)
    column = met.where((F.col("x0") >= F.col("left")) & (F.col("x0") < F.col("name_x")) & (F.col("y0") > F.col("y_head") + 0.002) & (F.col("y0") < F.coalesce("_below", far)))
    ends = table_ends(column, key)
    t = cut(t.join(ends, key, "left").withColumn("bottom", F.coalesce("end", "_below", far)).drop("end", "_below"))
    met = cut(t.join(w, page))
    line = lambda c, o: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct(o.alias("o"), F.col("word").alias("w"), F.col("t").alias("t"))))), lambda s: s.t), " ")
    header = (F.col("x0") >= F.col("left")) & (F.col("x0") < F.col("name_x")) & (F.abs(F.col("y0") - F.col("y_head")) < HEAD_DY)
    title = (F.col("x0") >= F.col("left") - 0.02) & (F.col("x0") < F.col("right")) & (F.col("y_head") - F.col("y0") > 0) & (F.col("y_head") - F.col("y0") <= TITLE_DY)
    named = met.groupBy(*key).agg(line(header, F.col("word")).alias("_header"), line(title, F.col("x0")).alias("title"))
    titled = F.col("title").rlike(TITLE) & F.col("_header").rlike(HEADER_NUMBER)
    named = named.select(*key, (F.col("_header").rlike(ROOM_HEADER) | titled).alias("labeled"), F.when(F.col("title").rlike(TITLE), F.col("title")).alias("title"))
    band = met.where((F.col("x0") >= F.col("left")) & (F.col("x0") <= F.col("right")) & (F.col("y0") > F.col("y_head") + 0.002) & (F.col("y0") < F.col("bottom") - 0.002)).join(named, key)
    band = cut(band.withColumns({"_center": (F.col("x0") + F.col("x1")) / 2, "_cy": (F.col("y0") + F.col("y1")) / 2, "_plain": F.col("t").rlike(NUM), "_shape": shape(F.col("t"))}))
    # forms of numbers that the column teaches
    left = band.where("x0 < name_x").where(F.col("t").rlike(NUM_CANDIDATE))
    forms = left.groupBy(*key, "_shape").agg(F.count("*").alias("_n"), F.max("labeled").alias("_l"), F.max("_plain").alias("_p")).where(f"_l AND _n >= {SHAPE_LEAST} AND NOT _p").select(*key, "_shape", F.lit(True).alias("_taught"))
    digits = left.where(F.col("t").rlike("[0-9]")).groupBy(*key).agg((F.min("x0") - 0.003).alias("_d0"), (F.max("x1") + 0.003).alias("_d1"))
    band = band.join(forms, [*key, "_shape"], "left").join(digits, key, "left")
    letter = ~F.col("t").rlike("^[А-ЯЁ]$") | F.coalesce(F.col("_center").between(F.col("_d0"), F.col("_d1")), F.lit(False))
    taught = F.coalesce("_taught", F.lit(False)) & (F.col("x0") < F.col("name_x")) & F.col("t").rlike(NUM_CANDIDATE) & letter
    band = band.withColumn("_number", F.col("_plain") | taught)
    # columns by what stands in them
    inside = (F.col("_center") >= F.col("left")) & (F.col("_center") < F.col("right"))
    right_of = band.where(inside & F.col("_number") & (F.col("_center") < F.col("name_x"))).groupBy(*key).agg(F.max("x1").alias("_num"))
    band = cut(band.join(right_of, key))
    after = inside & (F.col("x0") > F.col("_num"))
    area = band.groupBy(*key).agg(F.min(F.when(after & F.col("t").rlike(AREA), F.col("x0"))).alias("_area"))
    band = band.join(area, key)
    cats = band.where(after & F.col("t").rlike(CATEGORY) & (F.col("x0") >= F.coalesce("_area", "right"))).groupBy(*key).agg(F.min("x0").alias("_cat"))
    some = band.where(after & F.col("t").rlike(CATEGORY)).select(*key).distinct().withColumn("_some", F.lit(True))
    band = band.join(cats, key, "left").join(some, key, "left").withColumns({"_a": F.coalesce("_area", "right"), "_c": F.coalesce("_cat", "right")})
    end = F.least("_a", "_c") - 0.001
    band = band.where(end > F.col("_num") + 0.001)
    at = lambda lo, hi: (F.col("_center") >= lo - 0.002) & (F.col("_center") < hi)
    kind = F.when(at(F.col("left"), F.col("_num") + 0.001) & F.col("_number"), "number").when(at(F.col("_num") + 0.001, end), "name").when(F.col("_area").isNotNull() & at(F.col("_a") - 0.001, F.col("_c")), "area").when(F.coalesce("_some", F.lit(False)) & at(F.col("_c") - 0.001, F.col("right")), "category")
    # rows: words whose heights differ by less than a word's height
    height = F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))
    tall = band.groupBy(*key).agg(F.sort_array(F.collect_list(height)).alias("_h"))
    tall = tall.select(*key, F.coalesce(F.get("_h", F.floor(F.size("_h") / 2).cast("int")) * ROW_TOL, F.lit(ROW_DEFAULT)).alias("_tol"))
    order = Window.partitionBy(*key).orderBy("_line", "x0", "word")
    band = band.withColumn("_kind", kind).join(tall, key).withColumn("_line", F.bround(F.col("y0") / F.col("_tol")))
    new = F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(order)) > F.col("_tol"), F.lit(True)).cast("int")
    band = band.withColumn("_new", new).withColumns({"row": F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_place": F.row_number().over(order)})
    band = cut(band.select(*key, "row", "_place", "t", "_kind", "_cy", "level", "labeled", "title", "_number", "x0", "name_x"))
    every = [*key, "row"]
    numbers = band.where("_kind = 'number'").select(*every, F.col("_place").alias("_id"), F.col("t").alias("number"), F.col("_cy").alias("_ny"), "level", "labeled", "title")
    cells = band.where("_kind IN ('name', 'area', 'category')").select(*every, "_place", "t", "_kind", "_cy").join(numbers.select(*every, "_id", "_ny"), every)
    nearest = cells.groupBy(*every, "_place", "t", "_kind").agg(F.min(F.struct(F.abs(F.col("_cy") - F.col("_ny")).alias("d"), F.col("_ny").alias("y"), F.col("_id").alias("id"))).alias("_m"))
    of = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("_kind") == k, F.struct("_place", "t")))), lambda s: s.t)
    held = nearest.groupBy(*every, F.col("_m.id").alias("_id")).agg(of("name").alias("_names"), F.get(F.filter(of("area"), lambda x: x.rlike(AREA)), 0).alias("_area"), F.get(F.filter(of("category"), lambda x: x.rlike(CATEGORY)), 0).alias("category"))
    name = F.regexp_replace(F.regexp_replace(F.array_join("_names", " "), r"\s+", " "), r"^[ .,:;]+|[ .,:;]+$", "")
    out = numbers.join(held, [*every, "_id"], "left").withColumns({"name": F.coalesce(name, F.lit("")), "area": F.replace("_area", F.lit(","), F.lit(".")).cast("double")})
    good = out.where((F.char_length(F.regexp_replace("name", "[^A-Za-zА-Яа-яЁё]", "")) >= NAME_LETTERS) & (F.char_length("name") <= NAME_MOST))
    good = good.join(t.select(*key, "name_x"), key)
    first = F.row_number().over(Window.partitionBy(*page, "number", "level").orderBy("name_x", "head", "row", "_ny", "_id"))
    found = cut(good.withColumn("_first", first))
    counted = band.where("_number AND x0 < name_x").select(*every).distinct().join(found.select(*every).distinct().withColumn("_ok", F.lit(True)), every, "left")
    counts = counted.groupBy(*page).agg(F.count("*").alias("rows"), F.count("_ok").alias("parsed"))
    return found.where("_first = 1").select(*every, "number", "name", "area", "category", "labeled", "title"), counts

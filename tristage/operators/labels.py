"""Values beside labels, and rows of schedules, on pages of text (rows 090 to 099). Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.functions.language import convert
from tristage.functions.match import after, before, hits, only, snippet
from tristage.functions.text import flat

#: A number as printed, and units that may stand before or behind one.
NUMBER = r"(?:[0-9]{1,3}(?: [0-9]{3})+(?![0-9])(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)"
UNIT = r"(?:кв\.?\s?м\.?|м\s?²|м\s?2(?![.,][0-9])|м\s?³|м\s?3(?![.,][0-9])|куб\.?\s?м\.?|га|м/с|‰|%|шт\.?|ед\.?|эт\.?|мест|мм|м\.?|кВт|Гкал/ч)(?=[\s,.;:)]|$)"
#: A column: a number that is no number of the next row (one or two digits and a capital) and no part of a date.
_COLUMN = rf"(?![0-9]{{1,2}}\s+[А-ЯЁ])({NUMBER})(?![.,][0-9])\s*({UNIT})?"
_LEAD = rf"^\s*({UNIT})?[\s,.:;()\-–—]*(?:в\s?т\.?\s?ч\.?[:\s]*)?({UNIT})?[\s:;]*"
_ROW = rf"{_LEAD}((?:{_COLUMN}\s*)+)"
#: Characters between a label and its value; numbers in a row that are no columns any more.
GAP, LONG_ROW = 40, 5
#: Least and most positions of a schedule.
POSITIONS = (3, 400)
#: Captions of columns by role (one to compare with, the document's own, a share, any), how far before a row
#: its header stands, how near captions of a pair are, and how far a table's rows are.
_W = "[0-9A-Za-zА-Яа-яЁё_]"
_CAPTION = "(?iu)" + (
    r"(до\s+(?:реконстр|корректир|изменени)\w*|существующ\w*\s+(?:положени|состояни)\w*|положительн\w*\s+заключени\w*|предельн\w*\s+(?:параметр|значени|показател)\w*|допустим\w*\s+(?:по|значени)\w*|<ГПЗУ>|<было>|нормативн\w*|<норматив>|<по\s+норме>|<по\s+нормам>|<требуется>|<требуемо[ег]\w*|по\s+расч[её]ту|расч[её]тн\w*\s+(?:значени|показател)\w*|<СП\s?[0-9])"
    r"|(после\s+(?:реконстр|корректир|изменени)\w*|<по\s+проекту>|<проект>|проектн\w*\s+(?:значени|показател|положени|состояни)\w*|показател\w*\s+по\s+ПД>|<корректировка>|<стало>|<принято>|<принимаетс\w*|<фактическ\w*)"
    r"|((?:м\s?²|м2|кв\.?\s?м\.?|га)\s+%|%\s+от>)"
    r"|(<показател\w*|<значени[ея]>|<количество>|<кол-?во>|<величина>)"
).replace(r"\w", _W).replace("<", f"(?<!{_W})").replace(f"(?(?<!{_W})!", "(?<!").replace(">", f"(?!{_W})")
HEADER_BACK, HEADER_PAIR, TABLE_NEAR = 1200, 250, 3000
_VALUE_NEXT = rf"^[\s,.:;()*\-–—]*(?:в\s?т(?:ом)?\.?\s?ч(?:исле)?\.?[:\s]*)?(?:{UNIT})?\s*(?![0-9]{{1,2}}(?:\.[0-9]{{1,2}})?(?:\.\s?|\s)(?:[-–—]\s)?[А-ЯЁA-Z]){NUMBER}"


def number(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"[\s ]", ""), ",", ".").try_cast("double")


def columns_after(text: Column, end: Column) -> Column:
    """The numbers that stand in a row behind a label: an array of value, raw and unit (row 091). A unit that stands
    before the first number is that of the numbers without their own."""
    row = after(text, end, 200)
    near = row.rlike(rf"^.{{0,{GAP}}}?{NUMBER}") & row.rlike(_ROW)
    lead = F.concat(F.regexp_extract(row, _ROW, 1), F.regexp_extract(row, _ROW, 2))
    found = hits(F.regexp_extract(row, _ROW, 3), _COLUMN, ("n", "u"))
    each = F.transform(found, lambda h: F.struct(number(h.n).alias("value"), h.n.alias("raw"), F.when(h.u != "", h.u).otherwise(F.when(lead != "", lead)).alias("unit")))
    return F.when(near, each).otherwise(F.array().cast("array<struct<value:double,raw:string,unit:string>>"))


def header_roles(text: Column, start: Column) -> Column:
    """What the captions before a row say of its columns (row 093): side (first or last: where the document's own column
    is; null if they say nothing) and share (whether the last column is one).

    The last caption of the document's own or of what it is compared with decides, if one of the other role stands not
    far before it. Captions with a number behind them belong to rows.
    """
    lo = F.greatest(start - HEADER_BACK, F.lit(0))
    head = F.substring(text, lo + 1, start - lo)
    role = lambda h: F.when(h.o != "", "other").when(h.w != "", "own").when(h.s != "", "share").otherwise("generic")
    caps = F.transform(F.filter(hits(head, _CAPTION, ("o", "w", "s", "g")), lambda h: ~after(text, lo + h.end, 60).rlike(_VALUE_NEXT)), lambda h: F.struct(h.start.alias("p"), role(h).alias("r")))

    def sides(c: Column) -> Column:
        last = F.try_element_at(F.filter(c, lambda x: x.r.isin("own", "other")), F.lit(-1))
        near = lambda roles: F.exists(c, lambda x: (x.p < last.p) & (x.p >= last.p - HEADER_PAIR) & x.r.isin(*roles))
        side = F.when((last.r == "own") & near(["other"]), "last").when((last.r == "other") & near(["own", "generic"]), "first")
        return F.struct(side.alias("side"), (side.isNotNull() & F.exists(c, lambda x: (x.r == "share") & (x.p > last.p) & (x.p <= last.p + HEADER_PAIR))).alias("share"))

    return F.get(F.transform(F.array(caps), sides), 0)


def _decimals(raw: Column) -> Column:
    return F.char_length(F.regexp_extract(raw, r"[.,]([0-9]+)$", 1))


def rows_of_numbers(text: Column) -> Column:
    """Each number of a page with the row that begins there: an array of start, value and row (value, raw, unit)."""
    numbers = hits(text, rf"(?<![0-9A-Za-zА-Яа-яЁё_,.])(?={NUMBER})[0-9]")
    return F.transform(numbers, lambda h: F.struct(h.start.alias("start"), columns_after(text, h.start).alias("row")))


def share_sources(rows: Column, start: Column, values: Column) -> Column:
    """The columns of which the last one is a share in per cent (row 094), as indices from 0.

    Reckoned from the nearest row of as many columns that ends in 100, one above before one below; without one, from a
    number of the table of which another row is a share too, or from a total that two other rows agree on. rows:
    rows_of_numbers() of the page; values: the row at hand, which begins near start.
    """
    k, last = F.size(values), F.try_element_at(values, F.lit(-1))
    tol = lambda raw: F.pow(F.lit(10.0), -_decimals(raw))
    near = F.filter(rows, lambda r: (r.start >= start - TABLE_NEAR) & (r.start <= start + TABLE_NEAR))
    alike = F.filter(near, lambda r: F.size(r.row) == k)
    end = lambda r: F.try_element_at(r.row, F.lit(-1))
    full = F.transform(F.filter(alike, lambda r: end(r).value == 100), lambda r: F.struct((r.start >= start).alias("below"), F.abs(r.start - start).alias("far"), r.row.alias("row")))
    columns = F.sequence(F.lit(0), F.greatest(k - 2, F.lit(0)))
    at = lambda row, j: F.get(row, j).value
    total = F.array_min(full).row
    exact = F.filter(columns, lambda j: (at(total, j) > 0) & (F.abs(at(values, j) / at(total, j) * 100 - last.value) <= tol(last.raw)))
    mine = F.transform(values, lambda v: v.value)
    others = lambda low: F.filter(alike, lambda r: (end(r).value >= low) & (end(r).value < 100) & (_decimals(end(r).raw) > 0) & (F.transform(r.row, lambda v: v.value) != mine))
    totals = F.array_distinct(F.filter(F.transform(near, lambda r: F.get(r.row, 0).value), lambda v: v > 0))
    of = lambda v, t, p, raw: F.abs(v / t * 100 - p) <= tol(raw)
    held = lambda j: F.exists(totals, lambda t: (t > at(values, j)) & of(at(values, j), t, last.value, last.raw) & F.exists(others(1.0), lambda r: (at(r.row, j) > 0) & of(at(r.row, j), t, end(r).value, end(r).raw)))
    span = lambda v, p, raw: F.struct((v * 100 / (p + tol(raw) / 2)).alias("lo"), (v * 100 / F.greatest(p - tol(raw) / 2, F.lit(1e-9))).alias("hi"))

    def common(j: Column) -> Column:
        own = span(at(values, j), last.value, last.raw)
        same = F.filter(others(1e-12), lambda r: (at(r.row, j) > end(r).value) & (span(at(r.row, j), end(r).value, end(r).raw).lo <= own.hi) & (own.lo <= span(at(r.row, j), end(r).value, end(r).raw).hi))
        return (at(values, j) > last.value) & (F.size(F.array_distinct(F.transform(same, lambda r: F.transform(r.row, lambda v: v.value)))) >= 2)

    by_number, by_common = F.filter(columns, held), F.filter(columns, common)
    found = F.when(F.size(full) > 0, exact).when(_decimals(last.raw) == 0, F.array().cast("array<int>")).when(F.size(by_number) > 0, by_number).otherwise(by_common)
    return F.when((k >= 2) & (last.value >= 1) & (last.value < 100), found).otherwise(F.array().cast("array<int>"))


def pick_column(text: Column, rows: Column, start: Column, values: Column, rule: str = "last") -> Column:
    """index and choice of a row's column (row 092): single, share (the last is a share of it), header (captions say so) or
    rule (only its place speaks for it)."""
    k = F.size(values)
    pick = lambda i, how: F.struct(i.cast("int").alias("index"), F.lit(how).alias("choice"))

    def choose(x: Column) -> Column:
        one = F.size(F.array_distinct(F.transform(x.sources, lambda j: F.get(values, j).value))) == 1
        last = F.when((F.size(x.sources) > 0) | (x.head.share & (F.try_element_at(values, F.lit(-1)).value <= 100)), k - 2).otherwise(k - 1)
        side = F.when(x.head.side == "last", last).otherwise(F.lit(0))
        by_rule = last if rule == "last" else F.lit(0)
        return F.when(one, pick(F.get(x.sources, 0), "share")).when(x.head.side.isNotNull(), pick(side, "header")).otherwise(pick(by_rule, "rule"))

    facts = F.struct(share_sources(rows, start, values).alias("sources"), header_roles(text, start).alias("head"))
    return F.when(k < 2, pick(F.lit(0), "single")).otherwise(F.get(F.transform(F.array(facts), choose), 0))


def find_values(pages: DataFrame, label: str, exclude: str | None = None, rule: str = "last", unit: str | None = None, text: str = "text") -> DataFrame:
    """pages' other columns with value, raw, columns (how many), choice, label, pos and snippet of each row of a label
    (rows 090, 092).

    label: a pattern whose alternatives go from the longest to the shortest, so a label within another is not counted
    again. exclude: words in the label's row that make it a part of a total. The column is chosen by pick_column(); five
    numbers in a row without a header are no row of values. With unit, values are converted to it, and rows of
    another dimension or without a unit go.
    """
    keys = [c for c in pages.columns if c != text]
    page = pages.select(*keys, flat(F.coalesce(F.col(text), F.lit(""))).alias("_f")).withColumn("_h", F.explode(hits(F.col("_f"), f"(?iu){label}")))
    page = page.withColumn("_v", columns_after(F.col("_f"), F.col("_h.end")))
    if exclude:
        row = F.concat(F.regexp_extract(before(F.col("_f"), F.col("_h.start"), 60), r"([^.;:0-9]*)$", 1), F.col("_h.raw"), F.regexp_extract(after(F.col("_f"), F.col("_h.end"), 60), r"^([^.;:0-9]*)", 1))
        page = only(page, ~row.rlike(f"(?iu){exclude}"))
    n = F.size("_v")
    page = only(page, n > 0).withColumn("_rows", F.when(n > 1, rows_of_numbers(F.col("_f"))))
    page = page.withColumn("_p", pick_column(F.col("_f"), F.col("_rows"), F.col("_h.start"), F.col("_v"), rule))
    page = only(page, (n < LONG_ROW) | (F.col("_p.choice") == "header")).withColumn("_c", F.get("_v", F.col("_p.index")))
    value = F.col("_c.value") if unit is None else convert(F.col("_c.value"), F.col("_c.unit"), F.lit(unit))
    out = page.select(*keys, value.alias("value"), F.col("_c.raw").alias("raw"), n.alias("columns"), F.col("_p.choice").alias("choice"), F.col("_h.raw").alias("label"), F.col("_h.start").alias("pos"), snippet(F.col("_f"), F.col("_h.start"), F.col("_h.end")).alias("snippet"))
    return only(out, F.col("value").isNotNull())


def _body(text: Column, header: str) -> Column:
    """What stands behind the header; null without one."""
    f = flat(F.coalesce(text, F.lit("")))
    return F.when(f.rlike(f"(?iu){header}"), F.regexp_extract(f, f"(?iu){header}(.*)$", 1))


def schedule_rows(text: Column, header: str, most: int = 250) -> Column:
    """Rows of a schedule with areas: an array of name and value (row 095), up to the first name of over `most` characters."""
    rows = F.transform(hits(_body(text, header), rf"(.*?)(?:кв\.?\s?м\.?|м\s?²|м2)\s+({NUMBER})", ("name", "n")), lambda h: F.struct(F.trim(h["name"]).alias("name"), number(h.n).alias("value")))
    cut = F.array_position(F.transform(rows, lambda r: F.length(r["name"]) > most), True)
    kept = F.when(cut > 0, F.slice(rows, F.lit(1), (cut - 1).cast("int"))).otherwise(rows)
    return F.filter(kept, lambda r: r["name"] != "")


def schedule_sum(rows: Column, name: str, exclude: str | None = None) -> Column:
    """Sum of the rows whose name matches; null, not 0, if none does (row 096)."""
    def fits(r: Column) -> Column:
        ok = r["name"].rlike(f"(?iu){name}")
        return ok & ~r["name"].rlike(f"(?iu){exclude}") if exclude else ok

    picked = F.filter(rows, fits)
    return F.when(F.size(picked) > 0, F.round(F.aggregate(picked, F.lit(0.0), lambda acc, r: acc + r.value), 2))


def schedule_positions(text: Column, header: str) -> Column:
    """How many positions of a schedule follow each other from 1; null if they are fewer than three (row 097)."""
    found = hits(_body(text, header), r"(?<![0-9,.])([0-9]{1,3})(\.[0-9]{1,2})?(?![0-9,.])", ("n", "sub"))
    count = F.aggregate(found, F.lit(0), lambda acc, h: F.when((h.sub == "") & (h.n.cast("int") == acc + 1) & (acc < POSITIONS[1]), acc + 1).otherwise(acc))
    return F.when(count >= POSITIONS[0], count)


def item_with_height(text: Column, row: str) -> Column:
    """The first row of the pattern with a height (h = ... m) in the 200 characters from its start: height and the number
    behind it within 40 (row 098)."""
    f = flat(F.coalesce(text, F.lit("")))
    height = rf"(?iu)h\s*[=:]\s*({NUMBER})\s*м"
    windows = F.filter(F.transform(hits(f, f"(?iu){row}"), lambda h: after(f, h.start, 200)), lambda w: w.rlike(height))
    first = F.get(windows, 0)
    tail = F.regexp_extract(first, rf"{height}.{{0,40}}?(?<![0-9.,])({NUMBER})", 2)
    return F.when(first.isNotNull(), F.struct(number(F.regexp_extract(first, height, 1)).alias("height"), number(tail).alias("length")))

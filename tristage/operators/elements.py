"""Which element of a building a value on a page belongs to (rows 100 to 110, 186).

A page is read once: mentions of elements, ends of clauses and values are arrays of offsets, and each value looks for its
element in an order of precedence. In its clause, not too far before it; in the heading that "characteristics of the
concrete" goes on from; after it, in a table; then the only element that the page names, or that the file's path names.
All is in column functions over the arrays of one page, so pages pass through without a shuffle.

Not read here: subjects of long sentences, roof structures, acts of inspection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.functions.match import each, hits, only
from tristage.functions.text import flat

_W = "[0-9A-Za-zА-Яа-яЁё_]"


def _re(pattern: str, fold: bool = True) -> str:
    """In Java's form: letters of both alphabets as word characters."""
    return ("(?iu)" if fold else "") + pattern.replace(r"\w", _W).replace(r"\d", "[0-9]")


#: Fixed values from here on: names, patterns and limits that results depend on.
UNDER, ABOVE, MIXED = "подземной части", "надземной части", "по всей высоте"
CONCRETE = [7.5, 10, 12.5, 15, 20, 22.5, 25, 27.5, 30, 35, 40, 45, 50, 55, 60, 70, 80, 90, 100]
LEAST_CLASS = 20
ELEMENTS = [
    ("Стена в грунте", r"стен\w*\s+в\s+грунт(?:е|(?![а-яёa-z]))", False),
    ("Фундаментная плита", r"фундаментн\w*\s+плит\w*|фунд\.\s*плит\w*|плит\w*\s+фундамент\w*|фундаментн\w*\s+плиту", False),
    ("Распределительный ростверк", r"распределительн\w*\s+ростверк\w*", False),
    ("Ростверки", r"ростверк\w*", False),
    ("Лестницы", r"(?<!стены\s)(?<!стен\s)(?:лестничн\w+\s+(?:марш|площадк)\w*|лестниц[аыу]?(?!\w)|марш\w*\s+и\s+площадк\w*)", False),
    ("Плиты перекрытия", r"плит\w*\s+(?:перекрыти|покрыти)\w*|плит[аы]\s+(?=-?\d{1,2}\s*-?го(?!\w))|перекрыти\w*|покрыти\w+\s+(?:стилобата|паркинга)|горизонтальн\w+\s+конструкци\w*|переходн\w+\s+(?:плит|элемент)\w*", True),
    ("Вертикальные конструкции", r"вертикальн\w+\s+(?:несущ\w+\s+)?конструкци\w*|пилон\w*|колонн\w*|(?<!в\s)(?<!подпорн\w\s)(?<!подпорные\s)стен\w*|стены\s+подвала", True),
]
FOUNDATIONS = ["Фундаментная плита", "Распределительный ростверк", "Ростверки"]
_CRANE_WORDS = r"под\s+(?:установку\s+)?(?:отдельно\s+стоящ\w+\s+)?(?:башенн\w+\s+)?кран|башенн\w+\s+кран"
_OTHER_WORDS = r"подготовк\w*|стяжк\w*|отмостк\w*|бортов\w*|благоустр\w*|форшахт\w*|" + _CRANE_WORDS + r"|пустышк\w*|лотк\w*|лоток|обойм\w*|канал\w*|колодц\w*|смотров\w+\s+устройств\w*|{mix}тротуар\w*|дорожк\w*|площадк\w+\s+(?:для|под)|приямк\w*|подпорн\w+\s+стен\w*|ограждени\w+\s+территори\w*|обвязочн\w+\s+пояс\w*|сва[ийяе]\w*|БСС|БНС"
NOT_STRUCTURAL = _re(_OTHER_WORDS.replace("{mix}", r"(?<!\w)БСТ(?!\w)|"))
NOT_STRUCTURAL_BUILT = _re(_OTHER_WORDS.replace("{mix}", ""))
_CRANE_AFTER = _re(r"^\s+(?:" + _CRANE_WORDS + ")")
_EXCEPT = _re(r"(?:кроме|за\s+исключением|помимо)\s+$")
_PREPOSITION = _re(r"(?:^|[\s«(\"])(?:из|на|над|под|от|до|к|по)\s+(?:(?:ж/б|монолитн\w+|железобетонн\w+|сборн\w+)\s+){0,9}[«\"]?$")
_NEG_RANGE = _re(r"(?:(?<=\s)|^)-\s?\d{1,2}(?:-?го)?\s*(?:по|до)\s*(?:\+?\s?(\d{1,2})|\+?\s?(кровл\w*))")
_UNDER = _re(r"подземн\w*|нулево\w+\s+цикл\w*|подвал\w*|техподпол\w*|техническ\w+\s+подпол\w*|(?<![\w.,])-\s?\d\s*(?:-?го\s+)?(?:подземн\w+\s+)?эт\w*|отм\.?\s*-\s?\d|минус\s+\d|на\s+отм\w*\.?\s*-")
_ABOVE = _re(r"надземн\w*|типов\w+\s+этаж\w*|(?<![\w-])\+\s?\d{1,2}\s*(?:по|до)|(?:^|\s)(?:с|со)\s+\d{1,2}\s*(?:-?го)?\s*(?:по|до)\s+\d{1,2}|(?<![-−–—\d.,])(?<!\w)\d{1,2}\s*[-−–—]\s*\d{1,2}\s*(?:-?го\s+)?этаж\w*|(?<![-\d.,])(?<!\w)\d{1,2}\s*(?:-?го\s+)?этаж\w*|кровл\w*|чердак\w*|отм\w*\.?\s*\+\s?\d")
_BOUNDARY = _re(r"(?:(?<=[.;:])\s+(?=[А-ЯЁA-Z0-9·•\-–—«\"„])|\s[·•]\s|\s\d{1,2}\.\s(?=[А-ЯЁ])|\s-\s(?=[а-яё]))", fold=False)
_CONTINUES = _re(r"^[^0-9A-Za-zА-Яа-яЁё_]*(?:характеристик\w*\s+бетона|материал\w*|бетон\w*|класс\w*|марк\w*|-\s*бетона)")
_FRAGMENT = _re(r"^[\s\d.,;:хx×*/()-]*(?:мм|м|шт)?[\s.,;:)]*$")
_JOIN = _re(r"^[\s,]*(?:и|а\s+также)?[\s,]*$")
_TABLE_HEAD = _re(r"ведомост\w+\s+расхода\s+бетона|марка\s+конструкци\w*")
_RETAINING = _re(r"подпорн\w+\s+стен\w*")
_SECTION = _re(r"(?:^|\s)\d{1,2}(?:\.\d{1,2}){1,3}\.?\s+(?=[А-ЯЁ])", fold=False)
_LEVEL = r"([+\-−–])\s?(\d{1,3})[.,](\d{3})(?!\d)"
_SHEET_LEVEL = _re(r"(?<![а-яё])отм(?:етк\w*|\.)?\s*" + _LEVEL)
_SHEET_RANGE = _re(_LEVEL + r"\s*(?:\.{2,3}|…)\s*" + _LEVEL)
_CLASS = _re(r"(?<![\w/])[BВ]\s?(\d{1,3}(?:[,.]5)?)(?![\d])(?!\s?[xх×*]\s?\d)", fold=False)
_CONCRETE_BEFORE = _re(r"бетон\w*|класс\w*|(?<!\w)кл\.|марк\w*\s+конструкци")
_MARKS_AFTER = _re(r"^\s*[,;]?\s*(?:\(?\s*)?(?:марк\w*\s+)?[FW]\s?\d")
_CLASS_LIST = _re(r"класс\w*\s+(?:бетона\s+)?по\s+прочности")
_LIMIT = _re(r"(?:(?<![а-яёa-z])(?:не|he)\s+(?:ниже|выше|менее|более)|(?<![а-яёa-z])(?:ниже|выше|менее|более),?\s+чем|(?<![а-яёa-z])превыша\w*|[≥≤])(?:,?\s+чем)?(?:\s+(?:класс\w*|бетон\w*|по\s+прочности(?:\s+на\s+сжатие)?)){0,9}\s*[:–—-]?\s*$")
_PIT_WALL = _re(r"(?<!\w)СВГ(?!\w)|ограждени\w+\s+котлован\w*[^0-9A-Za-zА-Яа-яЁё_]+(?:СВГ|БСС|буросекущ\w*)")
_NETWORK = _re(r"(?<![А-ЯЁа-яё])КР[.\s_-]?НС(?![А-ЯЁа-яё])|наружн\w*\s+(?:инженерн\w*\s+)?сет(?:и|ей|ь)(?![а-яё])|(?<![А-ЯЁа-яё])НИС(?![А-ЯЁа-яё])")
_CRANE_FOUNDATION = _re(r"(?<![А-ЯЁа-яё])(?:фундамент\w*|ростверк\w*|плит\w*)\s+(?:[а-яё]+\s+)?(?:под\s+(?:установку\s+)?)?(?:отдельно\s+стоящ\w+\s+)?(?:башенн\w+\s+)?кран(?:а|ов|ы|ом|у|е)?(?![А-ЯЁа-яё-])")
_CRANE_OPENS = _re(r"(?:^|[.;:!?]\s+|(?:^|\s)(?:[а-яё]\.\s?\d{1,2}(?:\.\d{1,2}){0,9}\.?|\d{1,2}(?:\.\d{1,2}){1,9}\.?|\d{1,2}\.|[а-яё]'?\))\s+)$", fold=False)
_CRANE_HEADING = _re(r"^\s*(?:[–—-]\s|[А-ЯЁ][а-яё]|$)", fold=False)
_CRANE_END = _re(r"\s[а-яё]'?\)\s|\s[а-яё]\.\s?\d{1,2}\s+[А-ЯЁ]|(?:^|\s)\d{1,2}(?:\.\d{1,2}){0,3}\.\s+[А-ЯЁ]|(?:^|\s)\d{1,2}(?:\.\d{1,2}){1,3}\s+[А-ЯЁ]", fold=False)
NEAR, BACK, HOPS, WINDOW, RETAINING_BACK, RETAINING_AHEAD, CRANE_AHEAD, TITLE_LEN = 120, 400, 4, 360, 1500, 80, 1500, 1500
_PLATE = _re(r"(?:фундаментн\w*\s+плит\w*|плит\w*\s+фундамент\w*|фундамент\w*[^.;]{0,60}?плит\w*|(?<![а-яё])ростверк\w*[^.;]{0,90}?плит\w*)[^.;]{0,90}?(?:толщин\w*|(?<!\w)h\s*=|(?<!\w)t\s*=)\s*(?:[–—:-]\s*)?(\d{3,4})|толщин\w*\s+(?:монолитн\w+\s+)?(?:железобетонн\w+\s+)?фундаментн\w*\s+плит\w*[^.;]{0,60}?(\d{3,4})")
_SLAB_TITLE = _re(r"схем\w*\s+(?:расположени\w*\s+|армировани\w*\s+)?плит\w*\s+(?:перекрыти|покрыти)\w*")
_SHEET_MARK = _re(r"(?<!\w)[ht]\s*=\s*(\d{2,4})\s+" + _LEVEL)
_SHEET_OTHER = _re(r"стен\w*|пилон\w*|колонн\w*|балк\w*|ригел\w*|парапет\w*")
_THICKER = _re(r"уширени\w*|утолщени\w*|капител\w*|приям(?:ок|к)\w*|под\s+(?:колонн|пилон)\w*|лифт\w*|подготовк\w*")
_MORE_MM = _re(r"(\d{3,4})\s*(?:мм|mm)|(?:и|,|/)\s*(\d{3,4})(?=\s*(?:мм|mm|\s*\(|\s*$|[,.;]))")
_TAIL_STOP = _re(r"\.\s+[А-ЯЁ]|;|толщин|(?<!\w)[ht]\s*=")
_DISTRIBUTION = _re(r"распределительн\w*\s+$")
SLAB_RANGE, FOUNDATION_RANGE = (150, 500), (300, 3000)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value reckoned once."""
    return F.get(F.transform(F.array(value), f), 0)


def cut(text: Column, lo: Column, hi: Column) -> Column:
    """What stands from lo to hi; lo may be before the text."""
    lo = F.greatest(lo, F.lit(0))
    return F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0)))


def zone_of(text: Column) -> Column:
    """Which part of the building a text names (row 103): UNDER, ABOVE, MIXED (a range up to the roof) or null."""

    def zone(t: Column) -> Column:
        upto = F.regexp_extract(t, _NEG_RANGE, 1).try_cast("int")
        ranged = F.when((F.regexp_extract(t, _NEG_RANGE, 2) != "") | (upto > 2), MIXED).otherwise(UNDER)
        under, above = F.regexp_instr(t, F.lit(_UNDER)), F.regexp_instr(t, F.lit(_ABOVE))
        named = F.when((under > 0) & ((above == 0) | (under <= above)), UNDER).when(above > 0, ABOVE)
        return F.when(t.rlike(_NEG_RANGE), ranged).otherwise(named)

    return let(text, zone)


def mentions(text: Column) -> Column:
    """Elements that a text names, by place (row 102): start, end, name, zoned (whether part of the building matters).

    Where two kinds overlap, the one listed first holds. Foundations of tower cranes hold their place and go.
    """

    def kind(i: int, name: str, pattern: str, zoned: bool) -> Column:
        return F.transform(hits(text, _re(pattern)), lambda h: F.struct(F.lit(i).alias("kind"), h.start.alias("start"), h.end.alias("end"), F.lit(name).alias("name"), F.lit(zoned).alias("zoned")))

    kinds = [kind(i, *e) for i, e in enumerate(ELEMENTS)]
    none = F.array().cast("array<struct<kind:int,start:int,end:int,name:string,zoned:boolean>>")
    any_ = "|".join(f"(?:{p})" for _, p, _ in ELEMENTS)  # most texts of paths and leftovers name no element at all
    every = F.when(text.rlike(_re(any_)), F.array_sort(F.concat(*kinds))).otherwise(none)
    over = lambda acc, h: F.exists(acc, lambda a: (a.start < h.end) & (h.start < a.end))
    kept = F.aggregate(every, F.array().cast("array<struct<kind:int,start:int,end:int,name:string,zoned:boolean>>"), lambda acc, h: F.when(over(acc, h), acc).otherwise(F.concat(acc, F.array(h))))
    crane = lambda m: m["name"].isin(*FOUNDATIONS) & cut(text, m.end, m.end + 80).rlike(_CRANE_AFTER)
    placed = F.transform(F.filter(kept, lambda m: ~crane(m)), lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), m["name"].alias("name"), m.zoned.alias("zoned")))
    return F.array_sort(placed)


def classes(text: Column) -> Column:
    """Concrete classes in a context of concrete: start, end, n (row 100)."""
    found = F.transform(hits(text, _CLASS, ["n"]), lambda h: F.struct(h.start.alias("start"), h.end.alias("end"), F.replace(h.n, F.lit(","), F.lit(".")).try_cast("double").alias("n")))
    context = lambda h: cut(text, h.start - 45, h.start).rlike(_CONCRETE_BEFORE) | cut(text, h.end, h.end + 25).rlike(_MARKS_AFTER) | cut(text, h.start - 900, h.start).rlike(_CLASS_LIST)
    return F.filter(found, lambda h: h.n.isin(*map(float, CONCRETE)) & context(h))


def clause_start(bounds: Column, pos: Column) -> Column:
    """Where the clause or list item that holds pos begins (row 104); bounds: hits of ends of clauses."""
    ends = F.transform(F.filter(bounds, lambda b: (b.start >= pos - BACK) & (b.end <= pos)), lambda b: b.end)
    return F.coalesce(F.array_max(ends), F.lit(0))


def location(name: Column, zoned: Column, zone: Column) -> Column:
    """Name and part of the building; null if that matters and isn't known."""
    return F.when(~zoned, name).when(zone != MIXED, F.concat_ws(" ", name, zone))


def locations(name: Column, zoned: Column, zone: Column) -> Column:
    """As location(), both parts if none is named: what is said of all walls holds for either."""
    both = F.array(F.concat_ws(" ", name, F.lit(UNDER)), F.concat_ws(" ", name, F.lit(ABOVE)))
    return F.when(~zoned, F.array(name)).when(zone.isNotNull() & (zone != MIXED), F.array(F.concat_ws(" ", name, zone))).otherwise(both)


def sheet_zone(text: Column) -> Column:
    """Part of the building by the levels that a sheet names: null if none, or of both signs."""
    mark = lambda s, w, f: F.when((w.cast("int") > 0) | (f.cast("int") > 0), F.when(s == "+", "+").otherwise("-"))
    one = F.transform(hits(text, _SHEET_LEVEL, ["s", "w", "f"]), lambda h: mark(h.s, h.w, h.f))
    two = F.flatten(F.transform(hits(text, _SHEET_RANGE, ["s", "w", "f", "s2", "w2", "f2"]), lambda h: F.array(mark(h.s, h.w, h.f), mark(h.s2, h.w2, h.f2))))
    signs = F.array_distinct(F.array_compact(F.concat(one, two)))
    return F.when(F.size(signs) == 1, F.when(F.get(signs, 0) == "+", ABOVE).otherwise(UNDER))


def _foreign(text: Column, s: Column, e: Column, back: int) -> Column:
    """A mention that is an exception, follows a preposition or belongs to what bears no load."""
    return cut(text, s - 25, s).rlike(_EXCEPT) | cut(text, s - 40, s).rlike(_PREPOSITION) | cut(text, s - back, e + 10).rlike(NOT_STRUCTURAL)


def only_location(text: Column, named: Column) -> Column:
    """The one location that a page names, if there is just one (row 101)."""
    own = F.filter(named, lambda m: ~_foreign(text, m.start, m.end, 30))
    found = F.transform(own, lambda m: location(m["name"], m.zoned, zone_of(cut(text, m.start, m.end + 40))))
    names = F.array_distinct(F.array_compact(found))
    return F.when(F.size(names) == 1, F.get(names, 0))


def path_text(path: Column) -> Column:
    """The last two folders and the file's name without its extension."""
    parts = F.split(F.coalesce(path, F.lit("")), r"[\\/]+")
    file = F.regexp_replace(F.element_at(parts, -1), r"\.[0-9A-Za-zА-Яа-яЁё_]+$", "")
    n = F.size(parts)
    return F.concat_ws(" ", F.slice(parts, F.greatest(n - 2, F.lit(1)), F.least(n - 1, F.lit(2))), file)


def path_location(text: Column, named: Column, zone: Column) -> Column:
    """The one location that a path names (row 110); null if one of its elements lacks a part of the building."""
    own = F.filter(named, lambda m: ~cut(text, m.start - 30, m.end + 10).rlike(NOT_STRUCTURAL))
    found = F.transform(own, lambda m: location(m["name"], m.zoned, zone))
    names = F.array_distinct(found)
    return F.when(text.rlike(_PIT_WALL), "Стена в грунте").when((F.size(names) == 1) & ~F.exists(found, lambda x: x.isNull()), F.get(names, 0))


def network_volume(path: Column) -> Column:
    """Whether a file belongs to outdoor networks, which hold no element of the building."""
    return F.coalesce(path, F.lit("")).rlike(_NETWORK)


def read(pages: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """pages with what bind() needs: _flat, _named, _bounds, _walls, _classes, page and path locations. One narrow pass."""
    p = pages.withColumn("_flat", flat(F.coalesce(F.col(text), F.lit(""))))
    p = p.withColumns({"_named": mentions(F.col("_flat")), "_bounds": hits(F.col("_flat"), _BOUNDARY), "_walls": hits(F.col("_flat"), _RETAINING), "_classes": classes(F.col("_flat")), "_path": path_text(F.col(path))})
    p = p.withColumns({"_path_zone": zone_of(F.col("_path")), "_path_named": mentions(F.col("_path")), "_page_loc": only_location(F.col("_flat"), F.col("_named"))})
    return p.withColumn("_path_loc", path_location(F.col("_path"), F.col("_path_named"), F.col("_path_zone"))).drop("_path_named")


def _ahead(text: Column, named: Column, every: Column, pos: Column, window: int = 160) -> Column:
    """The element right after a value in a table (row 186): with its part of the building, before any other class."""
    inside = F.filter(every, lambda c: (c.start >= pos) & (c.end <= pos + window))
    end = F.coalesce(F.get(inside, 1).start, pos + window)
    own = F.filter(named, lambda m: (m.start >= pos) & (m.end <= end) & ~(cut(text, F.greatest(m.start - 30, pos), m.end + 10).rlike(NOT_STRUCTURAL) | cut(text, F.greatest(m.start - 25, pos), m.start).rlike(_EXCEPT) | cut(text, F.greatest(m.start - 40, pos), m.start).rlike(_PREPOSITION)))
    found = F.transform(own, lambda m: location(m["name"], m.zoned, zone_of(cut(text, m.start, F.least(m.end + 40, end)))))
    return F.get(F.array_compact(found), 0)


def bind(values: DataFrame) -> DataFrame:
    """locations and binding of each value at _pos on a page of read() (row 101); null locations if it has no element.

    CLAUSE: named in the value's clause or the heading that it continues; PAGE: after it in a table, or named without the
    part of the building that the page gives; PATH: by the file's path; SHEET: the only element of the sheet, good as
    evidence only. A value of several elements joined by "and" belongs to all. as_built: a page of as-built papers, where
    a mix is no row of a specification and levels of the sheet tell the part of the building. Of mentions as near, the
    last before the value counts.
    """
    t, pos, named, bounds = (F.col(c) for c in ("_flat", "_pos", "_named", "_bounds"))
    v = values.withColumn("_start", clause_start(bounds, pos))
    start = F.col("_start")
    other = lambda x: F.when(F.col("as_built"), x.rlike(NOT_STRUCTURAL_BUILT)).otherwise(x.rlike(NOT_STRUCTURAL))
    # a retaining wall named before, and since then only its parts
    stop = F.coalesce(F.get(F.filter(bounds, lambda b: (b.start >= pos) & (b.end <= pos + RETAINING_AHEAD)), 0).start, pos + RETAINING_AHEAD)
    v = v.withColumns({"_wall": F.try_element_at(F.filter("_walls", lambda w: (w.start >= pos - RETAINING_BACK) & (w.end <= pos)), F.lit(-1)).end, "_stop": stop})
    since = F.filter(named, lambda m: (m.start >= F.col("_wall")) & (m.end <= F.col("_stop")))
    bare = lambda m: (m["name"] == "Вертикальные конструкции") & cut(t, m.start, m.end).rlike("(?iu)^стен(?!ов)") & zone_of(cut(t, F.greatest(clause_start(bounds, m.start), m.start - 30, F.col("_wall")), F.least(m.end + 40, F.col("_stop")))).isNull()
    retaining = F.col("_wall").isNotNull() & ~cut(t, F.col("_wall"), F.col("_stop")).rlike(_SECTION) & F.forall(since, bare)
    drop = other(cut(t, F.greatest(start, pos - 90), pos)) | F.coalesce(retaining, F.lit(False))
    good = lambda lo, hi: F.filter(named, lambda m: (m.start >= lo) & (m.end <= hi) & ~(cut(t, m.start - 40, m.start).rlike(_EXCEPT) | cut(t, m.start - 40, m.start).rlike(_PREPOSITION) | cut(t, m.start, m.end).rlike(NOT_STRUCTURAL)))
    table = cut(t, pos - 80, pos).rlike(_TABLE_HEAD)
    v = v.withColumns({"_drop": drop, "_table": F.when(table, _ahead(t, named, F.col("_classes"), pos)), "_own": good(F.greatest(start, pos - NEAR), pos)})
    # back over "characteristics of the concrete" and leftovers of sizes
    zero = F.struct(start.alias("cur"), cut(t, start, pos).rlike(_CONTINUES).alias("link"), F.lit(False).alias("dead"), F.col("_own").alias("own"))

    def hop(s: Column, _: Column) -> Column:
        prev = clause_start(bounds, F.greatest(s.cur - 1, F.lit(0)))
        go = (F.size(s.own) == 0) & s.link & ~s.dead & (pos - s.cur < WINDOW) & (prev < s.cur)
        piece = cut(t, prev, s.cur)
        gone = other(piece)
        on = F.struct(prev.alias("cur"), (piece.rlike(_CONTINUES) | piece.rlike(_FRAGMENT)).alias("link"), gone.alias("dead"), F.when(gone, s.own).otherwise(good(prev, s.cur)).alias("own"))
        return F.when(go, on).otherwise(s)

    v = v.withColumn("_hop", F.aggregate(F.sequence(F.lit(1), F.lit(HOPS)), zero, hop))
    v = v.withColumns({"_own": F.col("_hop.own"), "_drop": F.col("_drop") | F.col("_hop.dead")}).drop("_hop")
    # the last element and those joined with it
    own = F.col("_own")
    last = F.struct(F.slice(own, F.greatest(F.size(own), F.lit(1)), 1).alias("group"), F.lit(True).alias("open"))
    rest = F.reverse(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))))
    step = lambda s, m: F.when(s.open & cut(t, m.end, F.get(s.group, 0).start).rlike(_JOIN), F.struct(F.concat(F.array(m), s.group).alias("group"), F.lit(True).alias("open"))).otherwise(F.struct(s.group.alias("group"), F.lit(False).alias("open")))
    v = v.withColumn("_group", F.aggregate(rest, last, step, lambda s: s.group))

    def zone(m: Column) -> Column:
        earlier = F.array_max(F.transform(F.filter(own, lambda x: x.end <= m.start), lambda x: x.end))
        lo = F.greatest(start, m.start - 60, F.coalesce(earlier, F.lit(0)))
        lo = F.greatest(lo, F.coalesce(F.array_max(F.transform(F.filter("_classes", lambda c: (c.start >= lo) & (c.end <= m.start)), lambda c: c.end)), F.lit(0)))
        heads = F.reverse(F.filter(named, lambda h: (h["name"] == m["name"]) & (h.start >= m.start - 250) & (h.end <= m.start)))
        head = F.get(F.array_compact(F.transform(heads, lambda h: zone_of(cut(t, h.start, h.end + 60)))), 0)
        return F.when(m.zoned, F.coalesce(zone_of(cut(t, lo, F.least(pos, m.end + 80))), head, F.col("_path_zone")))

    v = v.withColumn("_group", F.transform("_group", lambda m: F.struct(m["name"].alias("name"), m.zoned.alias("zoned"), zone(m).alias("zone"))))
    clause = F.array_distinct(F.array_compact(F.transform("_group", lambda m: location(m["name"], m.zoned, m.zone))))
    level = F.when(F.col("as_built"), sheet_zone(t))
    wide = F.array_distinct(F.flatten(F.transform("_group", lambda m: locations(m["name"], m.zoned, F.col("_level")))))
    begins = lambda loc: F.coalesce(F.exists(own, lambda m: loc.startswith(m["name"])), F.lit(False))
    v = v.withColumns({"_clause": clause, "_level": level}).withColumns({"_wide": wide, "_next": _ahead(t, named, F.col("_classes"), pos)})
    got = lambda loc, how: F.struct(loc.alias("locations"), F.lit(how).alias("binding"))
    one = lambda c: F.array(F.col(c))
    with_own = F.when(F.size("_clause") > 0, got(F.col("_clause"), "CLAUSE")).when(begins(F.col("_page_loc")), got(one("_page_loc"), "PAGE")).when(begins(F.col("_path_loc")), got(one("_path_loc"), "PATH")).otherwise(got(F.col("_wide"), "CLAUSE"))
    without = F.when(F.col("_next").isNotNull(), got(one("_next"), "PAGE")).when(F.col("_path_loc").isNotNull(), got(one("_path_loc"), "PATH")).when(F.col("_page_loc").isNotNull(), got(one("_page_loc"), "SHEET"))
    found = F.when(F.col("_drop"), None).when(F.col("_table").isNotNull(), got(one("_table"), "PAGE")).when(F.size(own) > 0, with_own).otherwise(without)
    return v.withColumn("_f", found).select(*values.columns, "_f.locations", "_f.binding")


def concrete_classes(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, location, binding, value, raw and start of every concrete class of an element (row 100).

    pages: keys, text, path, as_built. Limits ("not below B25"), classes below B20 and those beside what bears no load
    are no values of an element. Null texts give none.
    """
    rows = read(pages).withColumn("_c", each("_classes")).withColumns({"_pos": F.col("_c.start"), "_end": F.col("_c.end"), "value": F.col("_c.n")})
    t, pos, end, bounds = F.col("_flat"), F.col("_pos"), F.col("_end"), F.col("_bounds")
    other = lambda x: F.when(F.col("as_built"), x.rlike(NOT_STRUCTURAL_BUILT)).otherwise(x.rlike(NOT_STRUCTURAL))
    stop = F.coalesce(F.get(F.filter(bounds, lambda b: (b.start >= end) & (b.end <= end + 60)), 0).start, end + 60)
    near = other(cut(t, F.greatest(clause_start(bounds, pos), pos - 60), pos)) | other(cut(t, end, stop))
    rows = only(rows, (F.col("value") >= LEAST_CLASS) & ~near & ~cut(t, pos - 80, pos).rlike(_LIMIT))
    raw = F.concat(F.lit("B"), F.replace(F.regexp_replace(F.col("value").cast("string"), r"\.0$", ""), F.lit("."), F.lit(",")))
    return bind(rows).select(*keys, each("locations").alias("location"), "binding", "value", raw.alias("raw"), F.col("_pos").alias("start"))


def crane_volume(titles: Column) -> Column:
    """Whether one of a volume's title pages (an array of their texts) names the foundation of a tower crane (row 109)."""
    return F.exists(titles, lambda x: let(flat(F.coalesce(x, F.lit(""))), lambda f: (F.char_length(f) <= TITLE_LEN) & f.rlike(_CRANE_FOUNDATION)))


def without_crane_sections(text: Column) -> Column:
    """A flat text without its sections on the foundation of a tower crane (row 108): from their heading to the next item,
    another element of the building or CRANE_AHEAD characters."""
    heads = F.filter(hits(text, _CRANE_FOUNDATION), lambda h: cut(text, h.start - 16, h.start).rlike(_CRANE_OPENS) & cut(text, h.end, h.end + 40).rlike(_CRANE_HEADING))

    def end(h: Column) -> Column:
        tail = cut(text, h.end, h.end + CRANE_AHEAD)
        item = F.regexp_instr(tail, F.lit(_CRANE_END))
        stop = F.when(item > 0, h.end + item - 1).otherwise(F.least(F.char_length(text), h.end + CRANE_AHEAD))
        away = F.filter(mentions(text), lambda m: (m.start >= h.end) & (m.end <= stop) & ~m["name"].isin(*FOUNDATIONS))
        return F.coalesce(F.get(away, 0).start, stop)

    parts = F.transform(heads, lambda h: F.struct(h.start.alias("s"), end(h).alias("e")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, p: F.when(p.s < acc["at"], acc).otherwise(F.struct(p.e.alias("at"), F.array_append(acc.out, F.trim(cut(text, acc["at"], p.s))).alias("out")))
    left = F.aggregate(parts, zero, step, lambda acc: F.array_append(acc.out, F.trim(cut(text, acc["at"], F.char_length(text)))))
    return F.when(F.lower(text).contains("кран"), F.array_join(F.filter(left, lambda x: x != ""), " ")).otherwise(text)


def plate_thickness(text: Column) -> Column:
    """Thicknesses of foundation plates on a flat page, in millimetres: an array of arrays, one for each statement
    (row 105). Decimals of levels, steps of bars, second sizes and local thickenings are none."""
    low, high = FOUNDATION_RANGE
    found = F.filter(hits(text, _PLATE, ["a", "b"]), lambda h: ~cut(text, h.start - 20, h.start + 20).rlike(NOT_STRUCTURAL) & ~h.raw.rlike(_THICKER) & ~cut(text, h.start - 30, h.start).rlike(_DISTRIBUTION))

    def values(h: Column) -> Column:
        number = F.when(h.a != "", h.a).otherwise(h.b)
        at = h.end - F.char_length(number)
        first = F.when(~cut(text, at - 2, at).rlike("[0-9][.,]$"), number.cast("int"))
        tail = cut(text, h.end, h.end + 120)
        stop = F.regexp_instr(tail, F.lit(_TAIL_STOP))
        tail = F.when(stop > 0, F.substring(tail, F.lit(1), stop - 1)).otherwise(tail)
        nxt = F.array_min(F.transform(F.filter(mentions(text), lambda m: m.start >= h.end), lambda m: m.start))
        tail = F.when(nxt.isNotNull(), F.substring(tail, F.lit(1), nxt - h.end)).otherwise(tail)

        def more(x: Column) -> Column:
            hit = lambda m: F.when(m.a != "", m.a).otherwise(m.b)
            number_at = lambda m: F.when(m.a != "", m.start).otherwise(m.end - F.char_length(m.b))
            every = hits(x, _MORE_MM, ["a", "b"])
            local = F.array_min(F.transform(F.filter(every, lambda m: cut(x, m.start - 30, m.start).rlike(_THICKER)), lambda m: m.start))
            fine = lambda m: (local.isNull() | (m.start < local)) & ~cut(x, F.lit(0), number_at(m)).rlike(r"[0-9][.,]$|[0-9]{2,4}\s*[хx×*]\s*$|(?iu)шаг[а-яё]*\s+(?:[^\s0-9]+\s+){0,2}(?:[0-9]{2,4}\s*[хx×*]\s*)?$")
            return F.transform(F.filter(every, fine), lambda m: hit(m).cast("int"))

        every = F.concat(F.array(first), let(tail, more))
        return F.array_sort(F.array_distinct(F.filter(every, lambda n: n.between(low, high))))

    return F.filter(F.transform(found, values), lambda a: F.size(a) > 0)


def slab_sheet_marks(text: Column) -> Column:
    """Thicknesses marked with a level on a sheet of slabs (row 107): distinct value and zone, by place."""
    marks = hits(text, _SHEET_MARK, ["n", "s", "w", "f"])
    low, high = SLAB_RANGE
    ok = lambda h: h.n.cast("int").between(low, high) & ((h.w.cast("int") > 0) | (h.f.cast("int") > 0)) & ~cut(text, h.start - 30, h.start).rlike(_SHEET_OTHER)
    rows = F.transform(F.filter(marks, ok), lambda h: F.struct(h.n.cast("int").alias("value"), F.when(h.s == "+", ABOVE).otherwise(UNDER).alias("zone")))
    return F.when(text.rlike(_SLAB_TITLE), F.array_distinct(rows)).otherwise(F.array().cast("array<struct<value:int,zone:string>>"))

"""Reinforcement, fire protection, coatings and finishes on pages, and what a later stage weakens (rows 113, 115, 116, 134,
135, 232, 295, 306). Column functions over a flat text: arrays of what a page states, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.functions.match import each, hits, only
from tristage.operators.elements import _BOUNDARY, _re, clause_start, cut, let, mentions

#: Fixed values from here on: patterns, groups and limits that results depend on.
_CLASS = _re(r"(?<![\w-])[АA]\s?-?\s?(240|400|500)\s?([СCс])?(?![\d\w])", fold=False)
_WORKING = _re(r"рабоч\w*|основн\w*|продольн\w*|вертикальн\w+\s+стержн\w*")
_CONSTRUCTIVE = _re(r"конструктивн\w*|хомут\w*|шпильк\w*|сет(?:ка|ки|ок|чат\w*)|распределительн\w*|монтажн\w*|поперечн\w*")
_EXTRA, _EXTRA_NAME = _re(r"форшахт\w*"), "Форшахта"
NEAR, BACK, CLAUSE_BACK, CLAUSE_ON = 90, 600, 400, 120
_SENTENCE = r"(?<=[.;])\s+(?=[А-ЯЁA-Z0-9-])"
_FIRE = _re(r"огнезащит\w*")
_STEEL = _re(r"стальн|металл|профлист|профилированн\w+\s+лист|колонн|балк|ригел|ферм|прогон|связ[еи]|несущ\w+\s+конструкц")
_FIRE_FOREIGN = _re(r"(?<!\w)пен[аоыу](?!\w)|пенн|кабел|проходк|воздуховод|муфт|герметик|вкладыш|паст[аыу](?!\w)|трубопровод|клапан|древесин|деревянн|антисептир|(?<!\w)акт\w*\s+на(?!\w)|двер|экран")
_NORM = _re(r"(?<!\w)ГОСТ(?!\w)|(?<!\w)СТО(?!\w)|ВН[ПИ]Б|(?<!\w)СП\s?\d|«\s*(?:Проектирование|Средства)", fold=False)
_PROJECT = _re(r"отдельн\w*\s+(?:разработанн\w+\s+)?проект\w*|специализированн\w+\s+организаци\w*")
_LIMIT = _re(r"(?<![A-Za-zА-Яа-я])(REI|R)\s?(\d{2,3})(?!\d)", fold=False)
_PARTS = [("колонны", r"колонн"), ("балки", r"балк"), ("ригели", r"ригел"), ("связи", r"связ[еиь]"), ("фермы", r"ферм"), ("прогоны", r"прогон"), ("стойки", r"стоек|стойк"), ("профлист", r"профлист|профилированн\w+\s+лист"), ("лестницы", r"лестниц|марш"), ("несущие конструкции", r"несущ\w+")]
_SUBJECT = _re(r"металлоконструкц|стальн\w+\s+(?:конструкц|элемент)|металлическ\w+\s+конструкц")
_COAT_FOREIGN = _re(r"трубопровод|воздуховод|труб(?!\w)|арматур\w+\s+(?:запорн|трубопровод)")
_COAT = _re(r"грунт\w*|эмал\w*|окраш\w*|окраск\w*|лакокрасочн\w*|мкм")
_WELD, _PAINT = _re(r"сварн\w+\s+(?:соединени|шв)"), _re(r"грунт|эмал")
_MATERIAL = _re(r"(?<![А-ЯЁа-яёA-Za-z])(ГФ|ПФ|ХВ|ЭП|АК|МЛ|УР|ФЛ|ХС|КО|ЭФ|ВЛ|ХП)\s?[-–]?\s?(\d{2,4})(?!\d)")
_LAYERS = _re(r"(?<![\d,.])(\d|одн\w+|дв\w+|тр[её]\w+|четыр\w+)\s+(?:сло[йяеёю]\w*|раз[а]?(?!\w))")
_ROLE, _MICRONS = _re(r"грунт\w*|эмал\w*"), _re(r"(?<![\d,.])(\d{2,3})\s*мкм")
_COUNTS = {"одн": 1, "дв": 2, "тр": 3, "четыр": 4}
ENAMEL = "эмаль"
GROUPS = [("вестибюли и лестничные клетки", r"вестибюл|лестничн\w*\s+клет|лифтов\w*\s+холл|тамбур"), ("общие коридоры и холлы", r"коридор|холл|фойе")]
SURFACES = [("стены и потолки", r"стен|потол"), ("полы", r"пол(?:ов|ы|а)?(?!\w)|покрыти\w+\s+пол")]
_KM = r"(?<![-/.\w])КМ\s?([0-5])(?![\d.\w-])"
_TABLE, _FOUR = _re(r"Вестибюл\w*,?\s+лестничн\w+\s+клетк\w*"), _re(r"КМ\s?([0-5])\s+КМ\s?([0-5])\s+КМ\s?([0-5])\s+КМ\s?([0-5])(?![\d])", fold=False)
_FOR = _re(r"(?:класс\s+)?КМ\s?([0-5])\s*[–—-]\s*для\s+([^;]{5,200})")
_ESCAPE, _HEAD = _re(r"эвакуац|вестибюл|коридор|лестничн|холл"), _re(r"пожарн\w+\s+опасност")
_GENERAL = _re(r"[–—-]\s*([а-яё][а-яё .,()\-]{3,80}?)\s*[–—-]\s*" + _KM)
_MARK = _re(r"(?<![\w-])((?:Пт|Ст|П|С)-\d+(?:\.\d+)?)(?![\w.])", fold=False)
_MARK_CLASS = _re(r"[Кк]ласс\w*\s+пожарной\s+опасности\s+(?:материал\w*\s+)?(?:не\s+(?:более|выше|ниже|хуже)\s+)?" + _KM, fold=False)
ESCAPE_BACK, HEAD_BACK, ROW_ON = 300, 300, 400


def sentences(text: Column) -> Column:
    return F.split(text, _SENTENCE)


def _last_end(text: Column, pattern: str) -> Column:
    return F.coalesce(F.try_element_at(hits(text, pattern), F.lit(-1)).end, F.lit(-1))


def purpose(before: Column) -> Column:
    """What reinforcement is for, by the last word before it: working, constructive or null; working wins no tie."""
    return let(before, lambda b: let(F.struct(_last_end(b, _WORKING).alias("w"), _last_end(b, _CONSTRUCTIVE).alias("c")), lambda e: F.when((e.w < 0) & (e.c < 0), None).when(e.w > e.c, "working").otherwise("constructive")))


def rebar_classes(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, location, binding, purpose, value, raw and start of classes of reinforcement (row 113).

    pages: keys, flat (text in one line), path, as_built. The element is named in the clause, by the path, or last before
    in the same description; without an element, or outside as-built papers without a purpose, a class is none.
    """
    t = F.col("flat")
    rows = pages.withColumns({"_m": mentions(t), "_b": hits(t, _BOUNDARY), "_x": hits(t, _EXTRA), "_c": hits(t, _CLASS, ("n", "s"))}).withColumn("_h", each("_c"))
    pos = F.col("_h.start")
    rows = rows.withColumn("_lo", F.greatest(clause_start(F.col("_b"), pos), pos - CLAUSE_BACK))
    inside = lambda a, lo, hi: F.filter(a, lambda m: (m.start >= lo) & (m.end <= hi))
    hi = pos + CLAUSE_ON
    plain = F.get(F.filter(inside(F.col("_m"), F.col("_lo"), hi), lambda m: ~m.zoned), 0)["name"]
    clause = F.when(F.size(inside(F.col("_x"), F.col("_lo"), hi)) > 0, _EXTRA_NAME).otherwise(plain)
    path = F.when(F.coalesce("path", F.lit("")).rlike(_EXTRA), _EXTRA_NAME)
    kind = lambda m, n: F.struct(m.start.alias("s"), m.end.alias("e"), n.alias("n"))
    behind = F.array_max(F.concat(F.transform(inside(F.col("_m"), pos - BACK, pos), lambda m: kind(m, m["name"])), F.transform(inside(F.col("_x"), pos - BACK, pos), lambda m: kind(m, F.lit(_EXTRA_NAME))))).n
    rows = rows.withColumns({"_clause": clause, "_path": path, "_behind": behind, "purpose": purpose(cut(t, pos - NEAR, pos))})
    where = F.coalesce("_clause", "_path", "_behind")
    how = F.when(F.col("_clause").isNotNull(), "CLAUSE").when(F.col("_path").isNotNull(), "PATH").otherwise("PAGE")
    out = only(rows, where.isNotNull() & (F.col("purpose").isNotNull() | F.col("as_built")))
    return out.select(*keys, where.alias("location"), how.alias("binding"), F.coalesce("purpose", F.lit("unknown")).alias("purpose"), F.col("_h.n").cast("int").alias("value"), F.concat(F.lit("А"), "_h.n", F.when(F.col("_h.s") != "", "С").otherwise("")).alias("raw"), pos.alias("start"))


def fire_statements(text: Column) -> Column:
    """Statements on the fire protection of steel (row 115): an array of kind (limit, project, mention), element, value."""
    none = F.lit(None).cast("string")
    row = lambda k, e=none, v=F.lit(None).cast("int"): F.struct(F.lit(k).alias("kind"), e.alias("element"), v.alias("value"))
    empty = F.array().cast("array<struct<kind:string,element:string,value:int>>")

    def element(s: Column, h: Column) -> Column:
        after = F.regexp_extract(cut(s, h.end, h.end + 40), _re(r"^\s*[–—-]?\s*для\s+(\w+)"), 1)
        named = F.coalesce(*(F.when(after.rlike(_re("^(?:" + p + ")")), n) for n, p in _PARTS))
        before = cut(s, h.start - 80, h.start)
        last = F.array_max(F.array(*(F.struct(F.coalesce(F.try_element_at(hits(before, _re(p)), F.lit(-1)).start, F.lit(-1)).alias("at"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, p) in enumerate(_PARTS))))
        return F.coalesce(F.when(after != "", named), F.when(last["at"] >= 0, last.n))

    def one(s: Column) -> Column:
        limits = F.filter(F.transform(hits(s, _LIMIT, ("k", "n")), lambda h: row("limit", element(s, h), h.n.cast("int"))), lambda r: r.element.isNotNull())
        steel = F.when(~s.rlike(_STEEL), empty).otherwise(let(limits, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(row("mention")))))
        asked = s.rlike(_FIRE) & ~s.rlike(_FIRE_FOREIGN) & ~s.rlike(_NORM)
        return F.when(asked, F.concat(F.when(s.rlike(_PROJECT), F.array(row("project"))).otherwise(empty), steel)).otherwise(empty)

    return F.flatten(F.transform(sentences(text), one))


def _count(word: Column) -> Column:
    w = F.lower(word)
    return F.coalesce(F.when(w.rlike("^[0-9]+$"), w.try_cast("int")), *(F.when(w.startswith(k), n) for k, n in _COUNTS.items()))


def coating_systems(text: Column) -> Column:
    """Coatings of steel against corrosion (row 116): an array of primer and enamel (sorted marks), primer_layers,
    enamel_layers and microns; null for what isn't named."""
    marks = lambda s: F.transform(hits(s, _MATERIAL, ("k", "n")), lambda h: F.struct(h.start.alias("start"), F.concat(F.upper(h.k), F.lit("-"), h.n).alias("m")))

    def role(s: Column, roles: Column, m: Column, i: Column) -> Column:
        nxt = F.coalesce(F.get(roles, i + 1).start, F.char_length(s))
        own = cut(s, m.end, F.least(nxt, m.end + 60))
        mark = F.get(marks(F.substring(own, 1, 40)), 0).m
        is_primer = F.lower(m.raw).startswith("грунт")
        before = F.slice(F.reverse(hits(cut(s, m.start - 25, m.start), _LAYERS, ("n",))), 1, 1)
        counts = F.array_compact(F.transform(F.concat(before, hits(own, _LAYERS, ("n",))), lambda h: _count(h.n)))
        return F.struct(is_primer.alias("p"), F.coalesce(mark, F.when(~is_primer, ENAMEL)).alias("m"), F.get(F.filter(counts, lambda c: c > 0), 0).alias("c"))

    def one(s: Column) -> Column:
        asked = s.rlike(_SUBJECT) & ~s.rlike(_COAT_FOREIGN) & s.rlike(_COAT) & ~(s.rlike(_WELD) & ~s.rlike(_PAINT))
        roles = let(hits(s, _ROLE), lambda r: F.transform(r, lambda m, i: role(s, r, m, i)))

        def system(r: Column) -> Column:
            primer = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.filter(r, lambda x: x.p), lambda x: x.m))))
            more = F.filter(F.transform(marks(s), lambda h: h.m), lambda m: m.startswith("ПФ") & ~F.array_contains(primer, m))
            enamel = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.transform(F.filter(r, lambda x: ~x.p), lambda x: x.m)), more)))
            enamel = F.when(F.size(enamel) > 1, F.array_remove(enamel, ENAMEL)).otherwise(enamel)
            layers = lambda p: F.array_max(F.transform(F.filter(r, lambda x: x.p == p), lambda x: x.c))
            microns = F.array_max(F.transform(hits(s, _MICRONS, ("n",)), lambda h: h.n.cast("int")))
            return F.struct(primer.alias("primer"), enamel.alias("enamel"), layers(F.lit(True)).alias("primer_layers"), layers(F.lit(False)).alias("enamel_layers"), microns.alias("microns"))

        return F.when(asked, let(roles, system))

    named = lambda x: x.isNotNull() & ((F.size(x.primer) > 0) | (F.size(x.enamel) > 0) | x.microns.isNotNull())
    return F.filter(F.transform(sentences(text), one), named)


def weakenings(pd: Column, rd: Column) -> Column:
    """Why a coating of the later stage is weaker (row 295): MICRONS, PRIMER_LAYERS, ENAMEL_LAYERS, NO_ENAMEL. Only what both
    stages name counts, each at its strongest; enamel is gone if the later stage describes a primer and none."""
    top = lambda s, c: F.array_max(F.transform(s, lambda x: x[c]))
    less = [F.when(top(rd, c) < top(pd, c), w) for c, w in (("microns", "MICRONS"), ("primer_layers", "PRIMER_LAYERS"), ("enamel_layers", "ENAMEL_LAYERS"))]
    any_ = lambda s, c: F.exists(s, lambda x: F.size(x[c]) > 0)
    gone = F.when(any_(pd, "enamel") & ~any_(rd, "enamel") & any_(rd, "primer"), "NO_ENAMEL")
    return F.when((F.size(pd) > 0) & (F.size(rd) > 0), F.array_compact(F.array(*less, gone))).otherwise(F.array().cast("array<string>"))


def _name(kinds: list[tuple[str, str]], text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike(_re(p)), n) for n, p in kinds))


_NEED = "array<struct<group:string,surface:string,value:int,form:string>>"


def finish_requirements(text: Column) -> Column:
    """What the design asks of finishes on escape routes (row 134): an array of group, surface, value (class) and form: a
    table's row of four classes behind its heading, or clauses."""
    row = lambda g, s, v, f: F.struct(g.alias("group"), s.alias("surface"), v.cast("int").alias("value"), F.lit(f).alias("form"))
    cells = [(0, 0), (1, 0), (0, 1), (1, 1)]

    def table(h: Column) -> Column:
        four = F.get(hits(cut(text, h.end, h.end + ROW_ON), _FOUR, ("a", "b", "c", "d")), 0)
        every = F.array(*(row(F.lit(GROUPS[g][0]), F.lit(SURFACES[s][0]), four[c], "table") for c, (g, s) in zip("abcd", cells, strict=True)))
        return F.when(four.isNotNull(), every).otherwise(F.array().cast(_NEED))

    def clause(h: Column) -> Column:
        ok = cut(text, h.start - ESCAPE_BACK, h.end).rlike(_ESCAPE)
        return F.when(ok, row(_name(GROUPS, h.w), _name(SURFACES, h.w), h.n, "clause"))

    clauses = F.filter(F.transform(hits(text, _FOR, ("n", "w")), clause), lambda r: r.isNotNull() & r.group.isNotNull() & r.surface.isNotNull())
    return F.concat(F.flatten(F.transform(hits(text, _TABLE), table)), clauses)


def finish_classes(text: Column) -> Column:
    """Classes that the working stage names (row 135): an array of form (general, mark), group, mark and value."""
    none = F.lit(None).cast("string")
    general = F.transform(F.filter(hits(text, _GENERAL, ("room", "n")), lambda h: cut(text, h.start - HEAD_BACK, h.start).rlike(_HEAD)), lambda h: F.struct(F.lit("general").alias("form"), _name(GROUPS, h.room).alias("group"), none.alias("mark"), h.n.cast("int").alias("value")))
    last = lambda h: F.try_element_at(hits(cut(text, h.start - ROW_ON, h.start), _MARK, ("m",)), F.lit(-1)).m
    marked = F.transform(hits(text, _MARK_CLASS, ("n",)), lambda h: F.struct(F.lit("mark").alias("form"), none.alias("group"), last(h).alias("mark"), h.n.cast("int").alias("value")))
    return F.concat(general, F.filter(marked, lambda r: r.mark.isNotNull()))


def strictest(requirements: DataFrame, by: list[str]) -> DataFrame:
    """by, group, surface and the strictest class that is asked (row 232)."""
    return requirements.groupBy(*by, "group", "surface").agg(F.min("value").alias("need"))


def worse(stated: DataFrame, needs: DataFrame, by: list[str]) -> DataFrame:
    """Classes of the working stage that are worse than asked of walls and ceilings (row 306): stated with need, against and
    state.

    General ones meet the need of their group. A mark, which no text ties to a room, is WORSE if it is worse than the
    mildest need, and BETWEEN if only than the strictest. stated: by, form, group, mark, value; needs from strictest().
    """
    walls = needs.where(F.col("surface") == SURFACES[0][0])
    own = walls.select(*by, "group", F.col("need").alias("_own"))
    both = walls.groupBy(*by).agg(F.max(F.struct("need", "group")).alias("_mild"), F.min("need").alias("_strict"))
    rows = stated.join(own, [*by, "group"], "left").join(both, by)
    general = (F.col("form") == "general") & (F.col("value") > F.col("_own"))
    mild = (F.col("form") == "mark") & (F.col("value") > F.col("_mild.need"))
    between = (F.col("form") == "mark") & ~mild & (F.col("value") > F.col("_strict"))
    state = F.when(general | mild, "WORSE").when(between, "BETWEEN")
    out = rows.withColumn("state", state).where("state IS NOT NULL")
    return out.select(*stated.columns, "state", F.when(general, F.col("_own")).when(mild, F.col("_mild.need")).otherwise(F.col("_strict")).alias("need"), F.when(general, F.col("group")).when(mild, F.col("_mild.group")).alias("against"))

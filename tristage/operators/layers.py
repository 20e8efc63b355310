"""Stacks of layers, pavements and roofs, of two stages (rows 130, 189, 298).

A page's lines become layers one after another: a line of a kind begins a layer, others go on with it, the first thickness
is the layer's. Stages meet by the number of a type, its purpose, or the share of kinds that they have in common.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tristage.functions.match import hits, only
from tristage.operators.elements import let

_W = "[0-9A-Za-zА-Яа-яЁё_]"


def _re(pattern: str) -> str:
    return "(?iu)" + pattern.replace(r"\w", _W).replace(r"\d", "[0-9]").replace(r"\b", f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))")


#: Fixed values from here on: kinds by the words of a line, the first listed wins among equals.
KINDS = [
    ("vapor", "пароизоляция", r"пароизоляц"),
    ("separation", "разделительный слой", r"разделительн\w*\s+сло|\bп[эе]\s*-?\s*пл[её]нк|полиэтиленов\w*\s+пл[её]нк"),
    ("slope", "уклонообразующий слой", r"керамзитобетон|уклонообразующ|керамзитов\w*\s+гравий"),
    ("waterproofing", "гидроизоляционный ковёр", r"кровельн\w*\s+(?:гидроизоляционн\w*\s+)?ковр|гидроизоляционн\w*\s+ков[её]?р|гидроизоляционн\w*\s+мембран|пвх[- ]мембран|техноэласт\s+(?:пламя|эпп|экп|эмп)|^\s*-?\s*(?:верхний|нижний)\s+слой\b.*(?:пламя|эпп|экп)"),
    ("drainage", "дренажный слой", r"дренажн"),
    ("primer", "праймер", r"праймер"),
    ("screed", "стяжка", r"стяжк|цементно-песчан\w*\s+(?:р-р|раствор|смес)"),
    ("insulation", "утеплитель", r"пенополистирол|\bxps\b|мин[еи]раловатн|утеплител|базальтов\w*\s+плит|пеностекл"),
    ("paving", "плитка", r"плитк|брусчатк"),
    ("rubber", "резиновое покрытие", r"резинов\w*\s+крошк|мастерфайбер"),
    ("asphalt", "асфальтобетон", r"асфальтобетон"),
    ("concrete", "бетон основания", r"цементобетон|укатываем\w*\s+бетон|бетонн\w*\s+плит\w*\s+из|монолитн\w*\s+бетонн\w*\s+плит"),
    ("stone", "щебень", r"щеб[её]н|гравийно|щебеночн"),
    ("sand", "песок", r"\bпес(?:ок|ка|чан\w*\s+(?:основани|подготовк|подсыпк))"),
    ("geotextile", "геотекстиль", r"геотекстил|геосетк"),
    ("soil", "почвенный слой", r"почвенн\w*\s+субстрат|растительн\w*\s+грунт"),
    ("base", "несущее основание", r"плит\w*\s+покрыти|ж/б\s+плит|железобетонн\w*\s*плит"),
    ("gap", "воздушный зазор", r"воздушн\w*\s+зазор"),
    ("masonry", "кладка", r"блок\w*\s+(?:из\s+ячеист|газобетон|стенов)|газобетонн\w*\s+блок|кладк\w*|кирпич"),
    ("wall", "несущая стена", r"стена\s+монолитн|монолитн\w*\s+(?:ж/б|железобетонн\w*)\s+стен"),
]
ROOF_KINDS = ["vapor", "separation", "slope", "waterproofing", "drainage", "primer", "screed", "insulation", "paving", "base", "geotextile", "concrete"]
NOT_LAYER = _re(r"уровень\s+грунтов|уплотн[её]нн?\w*\s+грунт|плодородн\w*\s+грунт|естественн\w*\s+грунт|газон\s+сеян|цветущ\w*\s+многолетник|^\s*грунт\s*$")
_CURB = _re(r"обмазать\s+битумом|камень\s+бортов|бортов\w*\s+камн|Условные\s+обозначения|Экспликаци|Цементобетон[^\n]*\n[^\n]*\n\s*Обмазать")
_THICK = [_re(p) for p in (r"(?:^|\s)[-–]\s*(\d+(?:[,.]\d+)?)\s*(см|мм)\b", r"толщ(?:\.|иной)?\s*\(?(\d+(?:[,.]\d+)?)\)?\s*(мм|см)", r"(?<![\d.,/])(\d+(?:[,.]\d+)?)\s*(мм|см)\s*[;.]?\s*$")]
_PAVEMENT = _re(r"ТИП\s*(\d+(?:\.\d+)?)\s*\(((?:Конструкци|Покрыт)[^)]*)\)")
_ROOF = _re(r"Кровля\s*[-–]\s*тип\s*([IVX]+|\d+)\s*(?:\(([^)]*)\))?")
_ROOF_END = _re(r"Сопротивление\s+теплопередач|Кровля\s*[-–]\s*тип|Формат\s+А\d")
_PURPOSE = _re(r"^(?:конструкци\w*|покрыти\w*)\s+")
LEAST_ROOF, ALIKE, HELD = 3, 0.6, 0.5

LAYERS = "array<struct<kind:string,mm:double,text:string>>"


def kind_of(line: Column) -> Column:
    """The kind of a line: of the first words that name one, without what stands in brackets; null for none."""

    def first(core: Column) -> Column:
        # most lines name no kind: one pattern tells; where it matches, the kinds are asked who begins there
        at = F.regexp_instr(core, F.lit(_re("|".join(f"(?:{p})" for _, _, p in KINDS))))
        named = lambda a: F.coalesce(*(F.when(F.regexp_instr(core, F.lit(_re(p))) == a, F.lit(k)) for k, _, p in KINDS))
        return F.when(core.rlike(NOT_LAYER), None).otherwise(let(at, lambda a: F.when(a > 0, named(a))))

    return let(F.regexp_replace(line, r"\([^)]*\)?", " "), first)


def thickness(line: Column) -> Column:
    """Millimetres of a layer, by the form that stands first; null for none."""
    forms = []
    for i, p in enumerate(_THICK):
        mm = F.replace(F.regexp_extract(line, p, 1), F.lit(","), F.lit(".")).try_cast("double") * F.when(F.lower(F.regexp_extract(line, p, 2)) == "см", 10).otherwise(1)
        at = F.regexp_instr(line, F.lit(p))
        forms.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(i).alias("i"), F.round(mm, 1).alias("mm"))))
    return F.array_min(F.array_compact(F.array(*forms))).mm


def layers(lines: Column) -> Column:
    """Lines as layers: an array of kind, mm and text, from above. A line with several layers between slashes is several;
    the next line of a waterproofing without a thickness goes on with it."""
    parts = F.transform(lines, lambda x: F.filter(F.split(x, r"(?<=[мс]м)\s*/\s*"), lambda y: F.trim(y) != ""))
    each = F.flatten(F.zip_with(lines, parts, lambda x, p: F.when((F.size(p) > 1) & F.forall(p, lambda y: kind_of(y).isNotNull()), p).otherwise(F.array(x))))
    read = F.filter(F.transform(each, lambda x: F.struct(F.trim(F.regexp_replace(x, r"[\r\t]", " ")).alias("text"), kind_of(x).alias("kind"), thickness(x).alias("mm"))), lambda s: s.text != "")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        goes_on = F.coalesce((s.kind == "waterproofing") & (last.kind == s.kind) & last.mm.isNull() & s.mm.isNull(), F.lit(False))
        grown = F.struct(last.kind.alias("kind"), F.coalesce(last.mm, s.mm).alias("mm"), F.concat_ws(" ", last.text, s.text).alias("text"))
        new = F.struct(s.kind.alias("kind"), s.mm.alias("mm"), s.text.alias("text"))
        return F.when(s.kind.isNotNull() & ~goes_on, F.concat(acc, F.array(new))).when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(acc)

    return F.aggregate(read, F.array().cast(LAYERS), step)


def _purpose(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), _PURPOSE, "")


def _blocks(pages: DataFrame, keys: list[str], head: str, stop: str) -> DataFrame:
    """What stands behind each heading up to the next one, or to where it stops: keys, key, purpose, start, body."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pages.select(*keys, text.alias("_t"), hits(text, head, ["key", "purpose"]).alias("_h"))
    rows = rows.select("*", F.posexplode(F.when(F.size("_h") > 0, F.col("_h"))).alias("_i", "_x"))
    end = F.coalesce(F.get("_h", F.col("_i") + 1).start, F.char_length("_t"))
    body = F.substring("_t", F.col("_x.end") + 1, end - F.col("_x.end"))
    at = F.regexp_instr(body, F.lit(stop))
    body = F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body)
    return rows.select(*keys, F.upper("_x.key").alias("key"), _purpose(F.col("_x.purpose")).alias("purpose"), F.col("_x.start").alias("start"), body.alias("body"))


def stacks(pages: DataFrame, keys: list[str], profile: str) -> DataFrame:
    """keys, key, purpose, start and layers of every type on pages of text (row 130). profile: pavement or roof.

    A roof's layers are the numbered items of its list; it needs LEAST_ROOF kinds of a roof. Null texts give none.
    """
    if profile == "pavement":
        rows = _blocks(pages, keys, _PAVEMENT, _CURB).withColumn("layers", layers(F.split("body", "\n")))
        return only(rows, F.size("layers") > 0).drop("body")
    rows = _blocks(pages, keys, _ROOF, _ROOF_END)
    items = F.slice(F.split("body", r"(?m)^\s*[0-9]+\.\s+"), 2, 1000)
    each = F.flatten(F.transform(items, lambda x: layers(F.split(x, r"\n\s*-\s+|\n"))))
    rows = rows.withColumn("layers", F.filter(each, lambda s: s.kind.isin(*ROOF_KINDS)))
    return only(rows, F.size(F.array_distinct(F.transform("layers", lambda s: s.kind))) >= LEAST_ROOF).drop("body")


def kinds(stack: Column) -> Column:
    return F.array_distinct(F.transform(stack, lambda s: s.kind))


def similarity(a: Column, b: Column) -> Column:
    """The share of kinds that two stacks have in common."""
    every = F.size(F.array_union(kinds(a), kinds(b)))
    return F.when(every > 0, F.size(F.array_intersect(kinds(a), kinds(b))) / every).otherwise(0.0)


def differences(pd: Column, rd: Column, thinner: bool = True, complete: bool = True, ignore: Sequence[str] = (), added: bool = True) -> Column:
    """What changed between two stacks: an array of change (REMOVED, ADDED, THINNER), kind, was and became (row 298).

    Layers of a kind are compared one by one if both stages have as many with a thickness, else by their sums. complete:
    the second stage was read whole, so a missing layer is removed. Empty: the same layers, none thinner.
    """
    keep = lambda s: F.filter(s, lambda x: ~x.kind.isin(*ignore)) if ignore else s
    a, b = keep(pd), keep(rd)
    none = F.lit(None).cast("double")
    kind = "array<struct<change:string,kind:string,was:double,became:double>>"
    row = lambda c, k, x=none, y=none: F.struct(F.lit(c).alias("change"), k.alias("kind"), x.alias("was"), y.alias("became"))
    of = lambda s, k: F.transform(F.filter(s, lambda x: (x.kind == k) & x.mm.isNotNull()), lambda x: x.mm)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)

    def less(k: Column) -> Column:
        x, y = of(a, k), of(b, k)
        one = F.filter(F.zip_with(x, y, lambda p, q: row("THINNER", k, p, q)), lambda r: r.became < r.was)
        both = F.when(total(y) < total(x), F.array(row("THINNER", k, total(x), total(y)))).otherwise(F.array().cast(kind))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.array().cast(kind)).when(F.size(x) == F.size(y), one).otherwise(both)

    parts = []
    if complete:
        parts.append(F.transform(F.array_except(kinds(a), kinds(b)), lambda k: row("REMOVED", k)))
    if added:
        parts.append(F.transform(F.array_except(kinds(b), kinds(a)), lambda k: row("ADDED", k)))
    if thinner:
        parts.append(F.flatten(F.transform(F.array_intersect(kinds(a), kinds(b)), less)))
    return F.concat(*parts) if parts else F.array().cast(kind)


def pair(pd: DataFrame, rd: DataFrame, by: list[str], profile: str) -> DataFrame:
    """Each stack of the second stage with its mate in the first (row 189): by, rd, pd (their numbers), key, how, and both
    stacks. pd, rd: by, n (order), key (null: none), purpose, layers.

    By key, the first one that has it; a pavement else by purpose; a roof whose mate is unlike it (under HELD) or missing
    by the largest share of common kinds, ALIKE at least, the later of equals. Stacks meet by key, purpose or kind only.
    """
    first = lambda k: pd.where(F.col(k).isNotNull() & (F.col(k) != "")).groupBy(*by, k).agg(F.min("n").alias(f"_{k}"))
    rows = rd.join(first("key"), [*by, "key"], "left")
    side = pd.select(*by, F.col("n").alias("pd"), F.col("key").alias("_pk"), F.col("layers").alias("pd_layers"))
    if profile == "pavement":
        rows = rows.join(first("purpose"), [*by, "purpose"], "left")
        rows = rows.withColumns({"pd": F.coalesce("_key", "_purpose"), "how": F.when(F.col("_key").isNotNull(), "KEY").otherwise("PURPOSE")})
    elif profile == "roof":
        # of the stacks only their kinds meet: how many they share and have gives the similarity
        each = lambda df, n: df.select(*by, F.col("n").alias(n), kinds(F.col("layers")).alias("_k")).select(*by, n, F.size("_k").alias(f"_{n}"), F.explode("_k").alias("_kind"))
        met = each(rd, "n").join(each(pd, "pd"), [*by, "_kind"]).groupBy(*by, "n", "pd").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.first("_pd").alias("_pd"))
        scored = met.select(*by, "n", "pd", (F.col("_c") / (F.col("_n") + F.col("_pd") - F.col("_c"))).alias("s"))
        keyed = rows.select(*by, "n", "_key").join(scored, [*by, "n"])
        like = keyed.groupBy(*by, "n").agg(F.max(F.when(F.col("s") >= ALIKE, F.struct("s", "pd"))).alias("_b"), F.max(F.when(F.col("pd") == F.col("_key"), F.col("s"))).alias("_s"))
        rows = rows.join(like.select(*by, "n", F.col("_b.pd").alias("_best"), "_s"), [*by, "n"], "left")
        held = F.col("_key").isNotNull() & (F.coalesce("_s", F.lit(0.0)) >= HELD)
        rows = rows.withColumns({"pd": F.when(held, F.col("_key")).otherwise(F.col("_best")), "how": F.when(held, "KEY").otherwise("KINDS")})
    else:
        rows = rows.withColumns({"pd": F.col("_key"), "how": F.lit("KEY")})
    out = rows.where("pd IS NOT NULL").select(*by, F.col("n").alias("rd"), "pd", F.col("key").alias("_rk"), "how", F.col("layers").alias("rd_layers"))
    return out.join(side, [*by, "pd"]).select(*by, "rd", "pd", F.coalesce("_rk", "_pk", F.lit("—")).alias("key"), "how", "pd_layers", "rd_layers")


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """With n, the place of a stack among those of its group."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

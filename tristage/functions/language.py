"""Words, units, references and broken encodings in Russian project texts (rows 042 to 077), all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tristage.functions.match import hits

#: Endings that a stem loses, and the least length of a stem.
ENDINGS = """
ированных ированный ованными ающими ающего ования ованный ается
ыми ими ого его ему ому ах ях ой ей ою ею ую юю ая яя ое ее ые ие ый ий ых их
ом ем ов ев ам ям у ю а я ы и е о й ь
""".split()
MIN_STEM = 3
#: Unit, dimension, size in the dimension's base unit.
UNITS = {
    "мм": ("length", 0.001), "см": ("length", 0.01), "дм": ("length", 0.1), "м": ("length", 1.0), "км": ("length", 1000.0),
    "м²": ("area", 1.0), "га": ("area", 10000.0), "м³": ("volume", 1.0), "л": ("volume", 0.001), "%": ("share", 1.0), "‰": ("share", 0.1),
    "шт": ("count", 1.0), "ед": ("count", 1.0), "мест": ("count", 1.0), "эт": ("count", 1.0), "чел": ("people", 1.0),
    "кВт": ("power", 1.0), "МВт": ("power", 1000.0), "Вт": ("power", 0.001), "Гкал/ч": ("heat", 1.0), "м³/ч": ("flow", 1.0),
    "м³/сут": ("flow_day", 1.0), "л/с": ("flow_sec", 1.0), "м/с": ("speed", 1.0), "т": ("mass", 1.0), "кг": ("mass", 0.001),
    "Ом": ("resistance", 1.0), "дБ": ("sound", 1.0), "лк": ("light", 1.0),
}
#: How a unit is written, in lower case, beside its own name and with a final full stop.
SPELLINGS = {
    "мм": "миллиметр миллиметров", "см": "сантиметр", "м": "метр метра метров п.м пм пог.м погм", "м²": "м2 кв.м квм м.кв",
    "м³": "м3 куб.м кубм м.куб", "га": "гектар", "%": "процент процентов", "шт": "штук", "ед": "единиц", "мест": "место м/м",
    "эт": "этаж", "чел": "человек", "Гкал/ч": "гкал/час", "м³/ч": "м3/ч м3/час", "м³/сут": "м3/сут м3/сутки", "л/с": "л/сек",
    "т": "тонн", "дБ": "дба",
}
#: Bounds between which a threshold in a unit is plausible.
PLAUSIBLE = {"мм": (10.0, 100000.0), "см": (1.0, 10000.0), "м": (0.05, 100.0), "км": (0.01, 1000.0), "м²": (0.1, 1000000.0), "га": (0.001, 10000.0), "м³": (0.01, 1000000.0), "%": (0.01, 100.0)}
#: Latin letters that look like Cyrillic ones, upper and lower case.
LATIN, CYRILLIC = "ABCEHKMOPTXYacehopxy", "АВСЕНКМОРТХУасенорху"
#: What Cyrillic in its own code page turns into when it is read as Latin-1.
BROKEN = "".join(map(chr, range(0xC0, 0x100))) + "¨¸"
MENDED = "".join(map(chr, range(0x410, 0x450))) + "Ёё"
#: Suspect words that prove a broken page.
MIN_WORDS = 2
_SUSPECT = "[¨¸À-ÿ]{2,}"


def fold(text: Column) -> Column:
    """Lower case, one letter for two that are mixed up, one dash (row 050)."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё‐‑–—", "е----")


def stem(word: Column) -> Column:
    """The word without its longest ending that leaves MIN_STEM letters (row 051)."""
    longest = sorted(ENDINGS, key=len, reverse=True)
    return F.regexp_replace(fold(word), rf"^(.{{{MIN_STEM},}}?)(?:{'|'.join(longest)})$", "$1")


def stems(text: Column) -> Column:
    """Distinct stems of a text's words (row 052)."""
    return F.array_distinct(F.transform(F.regexp_extract_all(fold(text), F.lit("[0-9a-zа-я]+"), F.lit(0)), stem))


def variant_matches(variant: Column, page: Column) -> Column:
    """All stems of three letters or more of a term's variant stand among the page's; false if it has none (row 053)."""
    wanted = F.filter(stems(variant), lambda s: F.length(s) >= 3)
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, page)) == 0)


def term_matches(variants: Column, page: Column) -> Column:
    """Any variant of a term matches (row 054)."""
    return F.exists(variants, lambda v: variant_matches(v, page))


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def canon(token: Column) -> Column:
    """A unit's own name from how it is written; null if unknown (row 042)."""
    known = {u.lower(): u for u in UNITS} | {s: u for u, some in SPELLINGS.items() for s in some.split()}
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(token), "ё", "е"), r"\s+", ""), r"\.+$", "")
    return F.try_element_at(_map(known), key)


def dimension(unit: Column) -> Column:
    """Dimension of a unit's own name (row 043)."""
    return F.try_element_at(_map({u: d for u, (d, _) in UNITS.items()}), unit)


def convert(value: Column, found: Column, wanted: Column) -> Column:
    """value in the wanted unit, to six places; null for an unknown unit or between dimensions (rows 044, 045)."""
    size = lambda u: F.try_element_at(_map({u: s for u, (_, s) in UNITS.items()}), u)
    a, b = canon(found), canon(wanted)
    return F.when(a == b, value).when(dimension(a) == dimension(b), F.round(value * size(a) / size(b), 6))


def implausible(threshold: Column, unit: Column) -> Column:
    """A threshold outside of what its unit makes plausible; false for units without bounds (row 046)."""
    low, high = (F.try_element_at(_map({u: b[i] for u, b in PLAUSIBLE.items()}), canon(unit)) for i in (0, 1))
    return F.coalesce((F.abs(threshold) < low) | (F.abs(threshold) > high), F.lit(False))


def mend(text: Column) -> Column:
    """The text with words of a broken encoding mended if there are MIN_WORDS of them, and how many (rows 047, 048)."""
    gaps = F.split(text, _SUSPECT, -1)
    words = F.transform(F.regexp_extract_all(text, F.lit(_SUSPECT), F.lit(0)), lambda w: F.translate(w, BROKEN, MENDED))
    whole = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(words, i), F.lit("")))), "")
    enough = F.size(words) >= MIN_WORDS
    return F.struct(F.when(enough, whole).otherwise(text).alias("text"), F.when(enough, F.size(words)).otherwise(0).alias("n"))


def code(text: Column) -> Column:
    """A document code for comparison: upper case, look-alike letters as Cyrillic, no separators (row 057)."""
    return F.regexp_replace(F.translate(F.upper(F.coalesce(text, F.lit(""))), LATIN, CYRILLIC), r"[\s.,/\\-]+", "")


def page_lines(text: Column) -> Column:
    """Lines without outer and double white space, empty ones left out (row 060)."""
    tidy = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(tidy, lambda x: x != "")


def norm_kind(kind: Column) -> Column:
    """The kind of a norm reference in its own spelling."""
    key = F.upper(F.regexp_replace(kind, r"\s+", ""))
    return F.when(key == "ГОСТР", "ГОСТ Р").when(key == "СНИП", "СНиП").when(key == "САНПИН", "СанПиН").when(key == "СТОНОСТРОЙ", "СТО НОСТРОЙ").when(key == "ТРТС", "ТР ТС").otherwise(key)


def split_year(number: Column, pivot: int = 30) -> tuple[Column, Column]:
    """Number and edition year of a reference: a trailing year of four or two digits (row 074)."""
    pattern = r"^(.*?)[.\-/]((?:19|20)[0-9]{2}|[0-9]{2})$"
    year = F.regexp_extract(number, pattern, 2)
    n = year.try_cast("int")
    head = F.when(year == "", number).otherwise(F.regexp_extract(number, pattern, 1))
    return head, F.when(n >= 100, n).when(n < pivot, 2000 + n).otherwise(1900 + n)


def one_digit_apart(a: Column, b: Column) -> Column:
    """One digit too many in exactly one part of the number, not the first (row 314)."""
    left, right = (F.filter(F.split(x, r"[.\-/]"), lambda s: s != "") for x in (a, b))
    inserted = lambda x, y: (F.length(y) - F.length(x) == 1) & F.exists(F.sequence(F.lit(1), F.length(y)), lambda i: F.concat(F.substring(y, F.lit(1), i - 1), F.substring(y, i + 1, F.length(y))) == x)
    apart = F.filter(F.zip_with(left, right, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: ~p.x.eqNullSafe(p.y))
    one = F.get(apart, 0)
    odd = F.when(F.length(one.x) < F.length(one.y), inserted(one.x, one.y)).otherwise(inserted(one.y, one.x))
    return F.coalesce((F.size(left) == F.size(right)) & (F.size(apart) == 1) & (F.get(left, 0) == F.get(right, 0)) & odd, F.lit(False))


def compare_references(kind_a: Column, number_a: Column, year_a: Column, kind_b: Column, number_b: Column, year_b: Column) -> Column:
    """EXACT, TYPO, OTHER_EDITION, NO_EDITION or OTHER_DOCUMENT (row 313)."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    typo = digits(number_a) != digits(number_b)
    same = (kind_a == kind_b) & (~typo | one_digit_apart(number_a, number_b))
    return F.when(~same, "OTHER_DOCUMENT").when(year_a.isNull() | year_b.isNull(), "NO_EDITION").when(year_a != year_b, "OTHER_EDITION").when(typo, "TYPO").otherwise("EXACT")


def features(text: Column, named: dict[str, str]) -> Column:
    """Names whose pattern occurs in the text (row 099)."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in named.items())), lambda x: x.isNotNull())


def zones(text: Column, pattern: str, least: int = 3) -> Column:
    """Distinct numbers of zones on a page, if it names `least` or more (row 142)."""
    found = F.array_sort(F.array_distinct(F.transform(hits(text, pattern, ("n",)), lambda h: h.n)))
    return F.when(F.size(found) >= least, found)


def room_number(number: Column) -> Column:
    """A room's number without leading zeros of its integer part (row 065)."""
    return F.regexp_replace(F.trim(number), "^0+([0-9])", "$1")

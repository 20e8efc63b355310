"""Document codes read from sheets: mended by the registry's code, and by what most sheets of a run say (rows 075, 325)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.functions.match import hits

#: Groups of signs that readings take for each other; most signs that a mend may change; weight of a code
#: that other sheets confirm; most edits between a code and that of its run.
CONFUSABLE = ["0OО○o", "1IlІ|", "3ЗЗз", "4Ч", "5S", "6б", "8В", "9g", "AА", "BВ", "CС", "EЕ", "HН", "KК", "MМ", "OО", "PР", "TТ", "XХ", "YУ", "aа", "cс", "eе", "oо", "pр", "xх", "yу", "ГF", "ДA", "ИN", "ЛJ", "ПN", "ЦU", "ЧY"]
MOST, KNOWN, EDITS = 2, 3, 2
TOKEN = "[0-9A-Za-zА-Яа-яЁё]+"
_TEXT_LAYER = "TEXT_LAYER"


def _same() -> dict[str, str]:
    out: dict[str, set[str]] = {}
    for group in CONFUSABLE:
        for c in group.lower():
            out.setdefault(c, set()).update(group.lower())
    return {c: "".join(sorted(s)) for c, s in out.items()}


_SAME = _same()


def confusable(a: Column, b: Column) -> Column:
    """Whether a reading may take sign b for a; both in lower case."""
    known = F.create_map(*(F.lit(x) for pair in _SAME.items() for x in pair))
    return (a == b) | (F.coalesce(F.instr(F.try_element_at(known, a), b), F.lit(0)) > 0)


def _signs(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def mend(read: Column, known: Column) -> Column:
    """A part of a code mended by that of the registry: text and cost, or null if it is another part (row 075).

    Signs that look alike are exchanged; one lost sign is put back, also beside signs that look alike.
    """
    a, b = F.lower(read), F.lower(known)
    x, y = _signs(a), _signs(b)
    pairs = F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    alike = lambda z: F.forall(z, lambda s: confusable(s.p, s.q))
    upper = lambda c: (F.upper(c) == c) & ((F.lower(c) != c) | c.rlike("[0-9]"))
    fixed = F.array_join(F.zip_with(_signs(read), _signs(known), lambda p, q: F.when(upper(p), F.upper(q)).otherwise(q)), "")
    cost = F.size(F.filter(pairs, lambda s: s.p != s.q))
    n = F.char_length(known)
    lost = F.exists(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(b, F.lit(1), i - 1), F.substring(b, i + 1, n)) == a)
    tail = F.zip_with(x, F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    head = F.zip_with(x, F.slice(y, 1, F.greatest(F.size(y) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    got = lambda t, c: F.struct(t.alias("text"), c.alias("cost"))
    short = (n - F.char_length(read) == 1) & (lost | alike(head) | alike(tail))
    return F.when(a == b, got(read, F.lit(0))).when((F.char_length(read) == n) & alike(pairs), got(fixed, cost)).when(short, got(known, F.lit(1)))


def align(read: Column, known: Column) -> Column:
    """code and changed (pairs of parts) of a reading mended by the registry's code (row 075).

    Parts stand side by side; what the reading has behind the last of the registry's stays, if that last part is equal.
    Separators stay as read. If a part is another one, or more than MOST signs differ, the reading stays as it is.
    """
    r, k = F.coalesce(read, F.lit("")), F.coalesce(known, F.lit(""))
    parts = hits(r, TOKEN)
    a, b = F.transform(parts, lambda h: h.raw), F.regexp_extract_all(k, F.lit(f"({TOKEN})"), F.lit(1))
    n = F.size(b)
    fits = (n > 0) & (F.size(a) >= n) & ((F.size(a) == n) | (F.lower(F.get(a, n - 1)) == F.lower(F.get(b, n - 1))))
    fixes = F.zip_with(F.slice(a, 1, n), b, lambda p, q: F.struct(p.alias("was"), mend(p, q).alias("m")))
    fine = F.forall(fixes, lambda f: f.m.isNotNull())
    spent = F.aggregate(F.filter(fixes, lambda f: f.m.isNotNull()), F.lit(0), lambda acc, f: acc + f.m.cost)
    changed = F.transform(F.filter(fixes, lambda f: f.m.cost > 0), lambda f: F.struct(f.was.alias("was"), f.m.text.alias("became")))
    ok = fits & fine & (spent > 0) & (spent <= MOST)
    gap = lambda i: F.when(i == 0, F.substring(r, F.lit(1), F.get(parts, 0).start)).otherwise(F.substring(r, F.get(parts, i - 1).end + 1, F.get(parts, i).start - F.get(parts, i - 1).end))
    word = lambda p, i: F.when(i < n, F.get(fixes, i).m.text).otherwise(p.raw)
    body = F.array_join(F.transform(parts, lambda p, i: F.concat(gap(i), word(p, i))), "")
    rest = F.substring(r, F.try_element_at(parts, F.lit(-1)).end + 1, F.char_length(r))
    return F.struct(F.when(ok, F.concat(body, rest)).otherwise(read).alias("code"), F.when(ok, changed).otherwise(F.array().cast("array<struct<was:string,became:string>>")).alias("changed"))


def harmonize(rows: DataFrame, run: list[str], place: str, known: DataFrame) -> DataFrame:
    """rows with codes as most sheets of their run have them, code_read (as read, if changed) and code_state (row 325).

    rows: run, place, code, code_source. A code that known (code) has counts KNOWN times; of equals that of the first
    sheet wins. A missing code is taken from the run (FROM_RUN), one at most EDITS edits away is changed (HARMONIZED);
    codes of the text layer stay, and so do those further away.
    """
    marked = rows.join(known.select("code").distinct().withColumn("_known", F.lit(True)), "code", "left")
    votes = marked.where("code IS NOT NULL").groupBy(*run, "code").agg(F.sum(F.when(F.col("_known"), KNOWN).otherwise(1)).alias("_n"), F.min(place).alias("_at"))
    best = votes.groupBy(*run).agg(F.max(F.struct("_n", (-F.col("_at")).alias("a"), "code")).alias("_b")).select(*run, F.col("_b.code").alias("_best"))
    out = marked.drop("_known").join(best, run, "left")
    layer = F.coalesce(F.col("code_source") == _TEXT_LAYER, F.lit(False))
    state = F.when(layer | F.col("_best").isNull() | F.coalesce(F.col("code") == F.col("_best"), F.lit(False)), None).when(F.col("code").isNull(), "FROM_RUN").when(F.levenshtein("code", "_best") <= EDITS, "HARMONIZED")
    out = out.withColumn("code_state", state).withColumn("code_read", F.when(F.col("code_state") == "HARMONIZED", F.col("code")))
    return out.withColumns({"code": F.when(F.col("code_state").isNotNull(), F.col("_best")).otherwise(F.col("code")), "code_source": F.when(F.col("code_state") == "FROM_RUN", "SEQUENCE").otherwise(F.col("code_source"))}).drop("_best")

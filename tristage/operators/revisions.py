"""Which edition of a document counts: a partial order of marks in names and folders (rows 315 to 317)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a member of a chain is compared by; all but archive may be null.
MARKS = ["archive", "year", "issue_corr", "correction", "correction_sub", "gip", "change", "version", "date"]


def issue_order(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
    """1, -1 or null by issue folders: an archive is before the rest, then years, then corrections of one year."""
    by = lambda c: F.when(a[c] > b[c], 1).when(a[c] < b[c], -1)
    corr = F.when(a["year"].eqNullSafe(b["year"]), by("issue_corr"))
    return F.when(a["archive"] & ~b["archive"], -1).when(~a["archive"] & b["archive"], 1).otherwise(F.coalesce(by("year"), corr))


def compare(a: Column, b: Column) -> Column:
    """1 if a is later than b, -1 if earlier, 0 if the same, null if they cannot be compared (row 315).

    Issue folders decide first; then corrections and numbers of changes, which must not disagree, and then versions;
    dates decide where these are alike, and make editions incomparable where they disagree. a, b: structs of MARKS.
    """
    return _judged(*_signs(_leveled(a), _leveled(b)))


def _leveled(m: Column | dict[str, Column]) -> dict[str, Column]:
    """What one edition brings to a comparison."""
    zero = lambda c: F.coalesce(m[c], F.lit(0))
    issue = {c: m[c] for c in ("archive", "year", "issue_corr", "date")}
    return issue | {"level": F.struct(zero("correction"), zero("correction_sub"), zero("gip")), "change": zero("change"), "version": zero("version")}


def _signs(a: dict[str, Column], b: dict[str, Column]) -> list[Column]:
    """How a stands to b by issue folders, level, change, version and date."""
    sign = lambda c: F.when(a[c] > b[c], 1).when(a[c] < b[c], -1)
    return [issue_order(a, b), *(sign(c).otherwise(0) for c in ("level", "change", "version")), sign("date")]


def _judged(issue: Column, c: Column, ch: Column, version: Column, dated: Column) -> Column:
    marks = F.when(c != 0, c).when(ch != 0, ch).otherwise(version)
    out = F.when(dated.isNull(), marks).when(marks == 0, dated).when(marks == dated, marks)
    return F.coalesce(issue, F.when((c != 0) & (ch != 0) & (c != ch), None).otherwise(out))


def resolve(members: DataFrame, chain: list[str], file: str) -> DataFrame:
    """Members with status and rank (row 317): chain, file, status, place.

    Members of a chain meet in pairs. If exactly one has nothing later and can be compared with all others, it is
    CURRENT and the rest are SUPERSEDED, placed by how many are later; else those that an issue folder puts before
    another are SUPERSEDED and the rest need CLARIFICATION_REQUIRED. A lone member is CURRENT. members: chain, file and
    the columns of MARKS; chains are short.
    """
    own = _leveled({c: F.col(c) for c in MARKS})
    names = {k: f"_m_{k}" for k in own}
    rows = members.select(*chain, file, *(v.alias(names[k]) for k, v in own.items()))
    a, b = rows.alias("a"), rows.alias("b")
    on = F.col(f"a.{file}") != F.col(f"b.{file}")
    for k in chain:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    side = lambda p: {k: F.col(f"{p}.{c}") for k, c in names.items()}
    # in steps of their own, as each sign counts several times in what follows
    signs = ["_i", "_c", "_h", "_v", "_d"]
    met = a.join(b, on).select(*(F.col(f"a.{k}").alias(k) for k in chain), F.col(f"a.{file}").alias(file), *(x.alias(n) for n, x in zip(signs, _signs(side("a"), side("b")), strict=True)))
    met = met.select(*chain, file, "_i", _judged(*map(F.col, signs)).alias("_o"))
    each = met.groupBy(*chain, file).agg(F.count_if(F.col("_o") == -1).alias("later"), F.count_if(F.col("_o").isNull() | (F.col("_o") == 0)).alias("open"), F.max(F.coalesce(F.col("_i") == -1, F.lit(False))).alias("older"))
    one = members.select(*chain, file).join(each, [*chain, file], "left").fillna({"later": 0, "open": 0, "older": False})
    tops = one.groupBy(*chain).agg(F.count_if(F.col("later") == 0).alias("_tops"), F.max(F.when(F.col("later") == 0, F.col("open"))).alias("_blocked"))
    clear = (F.col("_tops") == 1) & (F.col("_blocked") == 0)
    status = F.when(clear, F.when(F.col("later") == 0, "CURRENT").otherwise("SUPERSEDED")).when(F.col("older"), "SUPERSEDED").otherwise("CLARIFICATION_REQUIRED")
    return one.join(tops, chain).select(*chain, file, status.alias("status"), F.when(clear, F.col("later")).alias("place"))

#: What stands left of a mark is no letter; marks of corrections, changes, versions, copies, approval.
_LEFT = "(?<![А-Яа-яЁёA-Za-z])"
_APPROVALS = {"E_SIGNATURE": "ЭЦП", "STATE_EXPERTISE": "(?<![А-Яа-яЁё])МГЭ(?![А-Яа-яЁё])", "BUILDING_PERMIT_PACKAGE": "(?<![А-Яа-яЁё])РнС(?![а-яё])", "ISSUED_FOR_CONSTRUCTION": r"(?iu)в\s+производство"}


def name_marks(name: Column) -> Column:
    """Marks of an edition in a file name (row 067): correction, gip, by_comments, change, version, date, copy, approval.

    The extension goes first. A date is given as YYYY-MM-DD, from forms with the year first or last; one that no
    calendar of 2015 to 2030 has is none. Marks that a name lacks are null, or false.
    """
    stem = F.regexp_replace(name, r"(?i)(?:\.(?:pdf|docx|xml|xlsx|doc)){1,20}$", "")
    n = lambda p, g=1: F.regexp_extract(stem, p, g).try_cast("int")
    iso, dmy, packed = r"(?<![0-9])(20[0-9]{2})([-_.])([0-9]{1,2})\2([0-9]{1,2})(?![0-9])", r"(?<![0-9.])([0-9]{1,2})\.([0-9]{1,2})\.((?:20)?[0-9]{2})(?![0-9.])", r"(?<![0-9])([0-9]{2})([0-9]{2})(20[0-9]{2})(?![0-9])"
    year = lambda y: F.when(y < 100, 2000 + y).otherwise(y)
    made = lambda y, m, d: F.when(y.between(2015, 2030) & m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d))
    date = F.coalesce(made(n(iso, 1), n(iso, 3), n(iso, 4)), made(year(n(dmy, 3)), n(dmy, 2), n(dmy, 1)), made(n(packed, 3), n(packed, 2), n(packed, 1)))
    has = lambda p: stem.rlike(p)
    approval = F.coalesce(*(F.when(has(p), F.lit(k)) for k, p in _APPROVALS.items()))
    return F.struct(
        n(rf"(?iu){_LEFT}корр?\.?\s*([0-9]{{1,2}})(?![0-9])").alias("correction"),
        has(rf"(?iu){_LEFT}корр?\.?\s*ГИП").alias("gip"),
        has(r"(?iu)изм\.?\s*по\s*замечани").alias("by_comments"),
        n(rf"(?iu){_LEFT}изм(?:енение)?\.?\s*№?\s*([0-9]{{1,2}})(?![0-9])").alias("change"),
        F.coalesce(n(rf"{_LEFT}(?:[Вв]ер(?:сия)?|в)\.?\s*([0-9]{{1,2}})(?![0-9.])"), n(r"(?i)(?<![A-Za-zА-Яа-яЁё0-9])(?:ver(?:sion)?|v|rev(?:ision)?)\.?\s*([0-9]{1,2})(?![0-9.])")).alias("version"),
        date.alias("date"),
        n(r"\(([0-9]{1,2})\)").alias("copy"),
        approval.alias("approval"),
    )

"""Working sheets for design sheets by nested evidence, and whether a room keeps its systems (rows 179 to 181).

Sheets: by, sheet, discipline, floors, roots (of systems), rooms (arrays of strings), diagram (boolean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.functions.match import hits

_L = "[А-ЯA-Z]"
_W = "[0-9A-Za-zА-Яа-яЁё_]"
#: Rooms that tell a sheet's floor, the share of the floor that then has it alone, floors that titles name.
LEAST_ROOMS, MOSTLY, TOP_FLOOR, FIRST = 5, 0.7, 25, "1"
_FLOOR = r"(?iu)(?:([0-9]+)[- ]*(?:й|ти|го)?\s*этаж|этаж[а-я]*\s*([0-9]+))"
_RANGE = r"(?iu)с\s*([0-9]+)\s*по\s*([0-9]+)\s*этаж"
_LEVELS = {"0": r"(?iu)подвал|подземн|на отм\.?\s*-[0-9]|-1\s*этаж", "1": r"(?iu)отм\.?\s*0[.,]000", "2": r"(?iu)отм\.?\s*\+?3[.,][0-9]", "3": r"(?iu)отм\.?\s*\+?6[.,][0-9]", "ROOF": "(?iu)кровл|чердак"}


def system_root(mark: Column) -> Column:
    """What systems of one kind share: letters and the first number of a mark."""
    m = F.trim(mark)
    root = F.coalesce(*(F.nullif(F.regexp_extract(m, p, 1), F.lit("")) for p in (rf"^({_L}{{1,3}}[0-9]+)", rf"^({_L}{{1,3}})")), m)
    return F.upper(F.coalesce(root, F.lit("")))


def room_floor(room: Column) -> Column:
    """The floor that a room's number tells; null if it tells none."""
    r = F.trim(room)
    one = F.regexp_extract(r, r"^([1-4])[0-9]{2}(?:\.[0-9]+){0,9}[а-яА-Яa-zA-Z]?$", 1)
    two = F.regexp_extract(r, r"^([1-4])[-.][0-9]+", 1)
    found = F.when(r.startswith("0") & (F.char_length(r) >= 2), "0").when(one != "", one).when(two != "", two)
    return F.when(F.char_length(r) <= 6, found)


def floors(title: Column, rooms: Column) -> Column:
    """The floors of a sheet, sorted: those that its title names and those of its rooms. Of LEAST_ROOMS rooms or more the
    floor of most counts alone if it has MOSTLY of them, else all with two rooms; fewer rooms give theirs."""
    t = F.coalesce(title, F.lit(""))
    named = F.filter(F.transform(hits(t, _FLOOR, ("a", "b")), lambda h: F.when(h.a != "", h.a).otherwise(h.b)), lambda f: F.coalesce(f.try_cast("int") <= TOP_FLOOR, F.lit(False)))
    lo, hi = F.regexp_extract(t, _RANGE, 1).try_cast("int"), F.regexp_extract(t, _RANGE, 2).try_cast("int")
    ranged = F.when((hi >= lo) & (hi - lo < 200), F.transform(F.sequence(lo, hi), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    levels = F.array_compact(F.array(*(F.when(t.rlike(p), f) for f, p in _LEVELS.items())))
    own = F.array_compact(F.transform(F.coalesce(rooms, F.array().cast("array<string>")), room_floor))
    n = F.size(own)
    counts = F.transform(F.array_distinct(own), lambda f: F.struct(F.size(F.filter(own, lambda x: x == f)).alias("n"), f.alias("f")))
    top = F.array_max(F.transform(counts, lambda c: c.n))
    first = F.get(F.filter(F.array_sort(counts), lambda c: c.n == top), 0).f
    by_rooms = F.when(n == 0, F.array().cast("array<string>")).when(n < LEAST_ROOMS, F.array_distinct(own)).when(top / n >= MOSTLY, F.array(first)).otherwise(F.transform(F.filter(counts, lambda c: c.n >= 2), lambda c: c.f))
    return F.array_sort(F.array_distinct(F.concat(named, ranged, levels, by_rooms)))


def match(pd: DataFrame, rd: DataFrame, by: list[str]) -> DataFrame:
    """by, sheet, status, floor and rd: working sheets for each floor of a design sheet (row 179).

    Candidates share the discipline; if any of them shares a system, only those that do; then the floor, or they name
    none. A sheet without floors is one of the first. status MATCHED; RD_MISSING: no sheet of the discipline;
    NO_CANDIDATES: none of its floors (floor and rd are null). Sheets meet by system or floor within a discipline only.
    """
    on = [*by, "discipline"]
    some = rd.select(*on).distinct().withColumn("_some", F.lit(True))
    left = pd.select(*on, "sheet", F.when(F.size("floors") > 0, F.col("floors")).otherwise(F.array(F.lit(FIRST))).alias("floors"), "roots")
    alike = left.select(*on, "sheet", F.explode("roots").alias("_r")).join(rd.select(*on, F.col("sheet").alias("rd"), F.explode("roots").alias("_r")), [*on, "_r"]).select(*on, "sheet", "rd").distinct()
    narrowed = alike.select(*on, "sheet").distinct().withColumn("_narrow", F.lit(True))
    wanted = left.join(some, on, "left").join(narrowed, [*on, "sheet"], "left").select(*on, "sheet", "_some", "_narrow", F.explode("floors").alias("floor"))
    placed = rd.select(*on, F.col("sheet").alias("rd"), "floors")
    floored = placed.select(*on, "rd", F.explode("floors").alias("floor"))
    open_ = placed.where(F.size("floors") == 0).drop("floors")
    met = wanted.join(floored, [*on, "floor"]).unionByName(wanted.join(open_, on).select(*wanted.columns, "rd"))
    kept = met.join(alike.withColumn("_alike", F.lit(True)), [*on, "sheet", "rd"], "left").where("_narrow IS NULL OR _alike").select(*by, "sheet", "floor", "rd")
    found = kept.select(*by, "sheet").distinct()
    none = left.join(some, on, "left").join(found, [*by, "sheet"], "left_anti").select(*by, "sheet", F.when(F.col("_some"), "NO_CANDIDATES").otherwise("RD_MISSING").alias("status"), F.lit(None).cast("string").alias("floor"), F.lit(None).cast(dict(rd.dtypes)["sheet"]).alias("rd"))
    return kept.select(*by, "sheet", F.lit("MATCHED").alias("status"), "floor", "rd").unionByName(none)


def room_sheet(rooms: DataFrame, matched: DataFrame, pd: DataFrame, rd: DataFrame, by: list[str]) -> DataFrame:
    """by, sheet, room, rd and how: the working sheet that a room of a design sheet is checked on (row 180).

    CONTAINS: a sheet with the room, plans before diagrams, then a common system, the room's floor, more rooms; FLOOR:
    plans of the room's floor, then any sheet of it, by common system and rooms; ANY: the first of the matched. Equal
    ones in order of the sheet. rooms: by, sheet, room; matched: by, sheet, rd from match(). Without any sheet: null.
    """
    pairs = rooms.join(matched.where("rd IS NOT NULL").select(*by, "sheet", "rd").distinct(), [*by, "sheet"], "left")
    side = rd.select(*by, F.col("sheet").alias("rd"), F.col("rooms").alias("_rooms"), F.col("floors").alias("_floors"), F.col("roots").alias("_roots"), "diagram")
    all_ = pairs.join(pd.select(*by, "sheet", F.col("roots").alias("_own")), [*by, "sheet"]).join(side, [*by, "rd"], "left")
    floor = room_floor(F.col("room"))
    has, common = F.array_contains("_rooms", F.col("room")), F.arrays_overlap("_roots", "_own")
    on_floor = F.coalesce(F.array_contains("_floors", floor), F.lit(False))
    no = lambda c: (~F.coalesce(c, F.lit(False))).cast("int")
    size = -F.size("_rooms")
    tier = F.when(has, 0).when(on_floor & ~F.col("diagram"), 1).when(on_floor, 2).otherwise(3)
    inside = F.struct(no(~F.col("diagram")).alias("a"), no(common).alias("b"), no(on_floor).alias("c"), size.alias("d"))
    near = F.struct(no(common).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), size.alias("d"))
    zero = F.struct(*(F.lit(0).alias(c) for c in "abcd"))
    order = F.when(tier == 0, inside).when(tier < 3, near).otherwise(zero)
    best = all_.groupBy(*by, "sheet", "room").agg(F.min(F.when(F.col("rd").isNotNull(), F.struct(tier.alias("t"), order.alias("o"), F.col("rd").alias("rd")))).alias("_b"))
    how = F.when(F.col("_b.t") == 0, "CONTAINS").when(F.col("_b.t") < 3, "FLOOR").when(F.col("_b.t") == 3, "ANY")
    return best.select(*by, "sheet", "room", F.col("_b.rd").alias("rd"), how.alias("how"))


def verify(rooms: DataFrame, picked: DataFrame, rd_rooms: DataFrame, by: list[str]) -> DataFrame:
    """by, sheet, room, status, reason and missing: whether the working sheet keeps a room's systems (row 181).

    rooms: by, sheet, room, marks; picked from room_sheet(); rd_rooms: by, rd, room, rd_marks. A mark is kept if the room
    has it or another of its kind. A room without marks is fine.
    """
    on = [*by, "sheet", "room"]
    all_ = rooms.join(picked.select(*on, "rd"), on, "left").join(rd_rooms.select(*by, "rd", "room", "rd_marks", F.lit(True).alias("_held")), [*by, "rd", "room"], "left")
    none = F.array().cast("array<string>")
    marks, others = F.coalesce("marks", none), F.coalesce("rd_marks", none)
    kinds = F.transform(others, system_root)
    lost = F.filter(marks, lambda m: ~F.array_contains(kinds, system_root(m)) & ~F.array_contains(others, m))
    status = F.when(F.col("rd").isNull(), "COMPARISON_NOT_POSSIBLE").when((F.size(marks) == 0) | (F.col("_held") & (F.size(lost) == 0)), "OK").otherwise("VIOLATION")
    reason = F.when(F.col("rd").isNull(), "RD_SHEET_NOT_FOUND").when(status == "OK", None).when(F.col("_held").isNull(), "ROOM_MISSING_ON_RD_PLAN").otherwise("SYSTEM_NOT_ON_RD_PLAN")
    missing = F.when(status == "VIOLATION", F.when(F.col("_held"), lost).otherwise(marks)).otherwise(none)
    return all_.select(*on, status.alias("status"), reason.alias("reason"), missing.alias("missing"))

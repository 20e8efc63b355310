"""Typed comparison of the design value (pd) with the working value (rd): one CASE library (rows 256 to 260)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION, OK, IMPOSSIBLE = "VIOLATION_PRESENT", "NO_VIOLATION", "COMPARISON_IMPOSSIBLE"
EPS = 1e-9
#: Types of comparison; each is a condition under which the working stage violates the design.
TYPES = ("min_absolute", "min_trigger", "max_trigger", "presence", "decrease_or_text_change", "set_decrease", "set_change", "class_downgrade", "any_change", "relative", "decrease", "increase")
#: Results of a comparison.
EQUAL, EQUAL_DECIMALS, EQUAL_ALL, HARMLESS = "EQUAL_PD_RD", "EQUAL_AFTER_DECIMAL_NORMALIZATION", "EQUAL_ALL_AVAILABLE_STAGES", "NON_TRIGGERING_DIFFERENCE_NO_DECREASE"
REDUCED, MISMATCH, DECREASE, DOWNGRADE, MISSING = "DIMENSION_REDUCED", "VALUE_MISMATCH", "VALUE_DECREASE", "CLASS_DOWNGRADE", "MISSING_DESIGN_ELEMENT"


def outcome(label: str, result: str | None = None) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(result).cast("string").alias("result"))


def decimals(raw: Column) -> Column:
    """Digits after the decimal mark of a number as printed."""
    return F.char_length(F.regexp_extract(raw, r"[.,]([0-9]+)\s*$", 1))


def equal(pd: Column, rd: Column, pd_raw: Column | None = None, rd_raw: Column | None = None) -> Column:
    """Equal within half of the last digit of the less precise print; whole numbers without one."""
    digits = F.lit(0) if pd_raw is None or rd_raw is None else F.least(decimals(pd_raw), decimals(rd_raw))
    return F.abs(pd - rd) <= F.lit(0.5) * F.pow(F.lit(10.0), -digits)


def judge(kind: str, pd: Column, rd: Column, pd_all: Column, rd_all: Column, *, pd_raw: Column | None = None, rd_raw: Column | None = None, pd_row: Column | None = None, rd_row: Column | None = None, known: Column | None = None, threshold: float = 0.0, tolerance: float = 0.0, scale: list | None = None) -> Column:
    """Label and result of one comparison. pd and rd: chosen values; pd_all and rd_all: arrays of all values of a
    stage; raw: as printed; row: normalized text of the row; known: numbers that the design names elsewhere.

    scale: classes from the strongest to the weakest. Null where neither side has a value.
    """
    low, high = F.array_min, F.array_max
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    ok = lambda result: outcome(OK, result)
    bad = lambda result: outcome(VIOLATION, result)
    unknown = outcome(IMPOSSIBLE)
    held = lambda v, every: v.isNotNull() | some(every)
    has_pd, has_rd = held(pd, pd_all), held(rd, rd_all)
    if kind == "min_absolute":
        return F.when(has_pd | has_rd, F.when(rd.isNull(), unknown).when(rd < threshold, bad(REDUCED)).otherwise(ok(HARMLESS)))
    if kind in ("min_trigger", "max_trigger"):
        if kind == "min_trigger":
            over = (low(rd_all) < threshold - EPS) | F.coalesce(low(rd_all) < low(pd_all) - EPS, F.lit(False))
        else:
            over = (high(rd_all) > threshold + EPS) | F.coalesce(high(rd_all) > high(pd_all) + EPS, F.lit(False))
        result = REDUCED if kind == "min_trigger" else MISMATCH
        return F.when(has_pd | has_rd, F.when(~some(rd_all), unknown).when(over, bad(result)).otherwise(ok(HARMLESS)))
    if kind == "presence":
        return F.when(has_pd | has_rd, F.when(~some(pd_all), unknown).when(~some(rd_all), bad(MISSING)).otherwise(ok(EQUAL)))
    if kind == "set_decrease":
        least = low(pd_all) - F.when(low(pd_all) > 0, low(pd_all) * tolerance).otherwise(0.0) - EPS
        same = F.sort_array(pd_all) == F.sort_array(rd_all)
        out = F.when(same, ok(EQUAL)).when(high(rd_all) < least, bad(DECREASE)).when(low(rd_all) < least, unknown).otherwise(ok(HARMLESS))
        return F.when(has_pd | has_rd, F.when(~some(pd_all) | ~some(rd_all), unknown).otherwise(out))
    if kind == "set_change":
        whole = lambda a: F.sort_array(F.array_distinct(F.transform(a, lambda x: F.bround(x, 0))))
        extra = F.array_except(whole(rd_all), whole(pd_all) if known is None else F.concat(whole(pd_all), whole(known)))
        out = F.when(F.size(extra) > 0, bad(MISMATCH)).when(whole(rd_all) == whole(pd_all), ok(EQUAL)).otherwise(ok(HARMLESS))
        return F.when(has_pd | has_rd, F.when(~some(pd_all) | ~some(rd_all), unknown).otherwise(out))
    both = pd.isNotNull() & rd.isNotNull()
    if kind == "class_downgrade":
        ordinal = lambda v: F.array_position(F.array(*map(F.lit, scale or [])), v)
        out = F.when((ordinal(rd) == 0) | (ordinal(pd) == 0), unknown).when(ordinal(rd) > ordinal(pd), bad(DOWNGRADE)).when(ordinal(rd) == ordinal(pd), ok(EQUAL)).otherwise(ok(HARMLESS))
    elif kind == "decrease_or_text_change":
        out = F.when(rd < pd, bad(REDUCED)).when(~pd_row.eqNullSafe(rd_row), bad(MISMATCH)).otherwise(ok(EQUAL))
    else:
        printed = F.lit(True) if pd_raw is None or rd_raw is None else pd_raw == rd_raw
        change = {
            "any_change": bad(MISMATCH),
            "relative": F.when((pd == 0) | (F.try_divide(F.abs(rd - pd), F.abs(pd)) > threshold), bad(MISMATCH)).otherwise(ok(HARMLESS)),
            "decrease": F.when(rd < pd, bad(DECREASE)).otherwise(ok(HARMLESS)),
            "increase": F.when(rd > pd, bad(MISMATCH)).otherwise(ok(HARMLESS)),
        }[kind]
        out = F.when(equal(pd, rd, pd_raw, rd_raw), F.when(printed, ok(EQUAL)).otherwise(ok(EQUAL_DECIMALS))).otherwise(change)
    return F.when(has_pd | has_rd, F.when(both, out).otherwise(unknown))


def decide(kind: str, pd: Column, rd: Column, pd_all: Column, rd_all: Column, **options) -> Column:
    """The label alone."""
    return judge(kind, pd, rd, pd_all, rd_all, **options).getField("label")


def decide_set(pd: Column, rd: Column, binding: Column, listed: Column, named: Column, result: str = DECREASE) -> Column:
    """Label and result for sets of one element (row 257). binding: the strongest that names the working values; listed:
    values that are only enumerated; named: design values at any binding (empty unless slabs are compared)."""
    lower = F.filter(rd, lambda x: x < F.array_min(pd))
    excused = F.forall(lower, lambda x: F.array_contains(F.concat(listed, named), x))
    harmless = F.arrays_overlap(pd, rd) | F.forall(lower, lambda x: F.array_contains(named, x))
    below = F.when(excused, F.when(harmless, outcome(OK, HARMLESS)).otherwise(outcome(IMPOSSIBLE))).when(binding != "CLAUSE", outcome(IMPOSSIBLE)).otherwise(outcome(VIOLATION, result))
    fresh = F.exists(F.array_except(rd, pd), lambda x: x < F.array_max(pd))
    out = F.when(F.sort_array(pd) == F.sort_array(rd), outcome(OK, EQUAL)).when(F.size(lower) > 0, below).when(fresh, outcome(IMPOSSIBLE)).otherwise(outcome(OK, HARMLESS))
    return F.when(pd.isNotNull() | rd.isNotNull(), F.when(pd.isNull() | rd.isNull(), outcome(IMPOSSIBLE)).otherwise(out))


def id_review(first: Column, built: Column, has_pd: Column, has_rd: Column) -> Column:
    """The decision once the as-built stage is compared too (row 259). first: label and result of design against
    working; built: of the as-built values against working, or design if that is missing; null without as-built values."""
    equals = lambda r: r.isin(EQUAL, EQUAL_DECIMALS, EQUAL_ALL)
    one = has_pd != has_rd
    all_equal = F.when(equals(first.result) & equals(built.result), F.lit(EQUAL_ALL)).otherwise(first.result)
    alone = F.when(equals(built.result), F.lit(EQUAL_ALL)).otherwise(built.result)
    fine = F.struct(F.lit(OK).alias("label"), F.when(first.label == OK, all_equal).otherwise(alone).alias("result"))
    said = F.when(built.label == VIOLATION, built).when((built.label == OK) & ((first.label == OK) | (first.label == IMPOSSIBLE) & one), fine).otherwise(first)
    return F.when(built.isNull() | ~(has_pd | has_rd), first).otherwise(said)


def keyed(pd: DataFrame, rd: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Full outer join of both stages by key (row 260): status of each key."""
    a, b = pd.select(*keys, F.col(value).alias("pd"), F.lit(True).alias("_a")), rd.select(*keys, F.col(value).alias("rd"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "REMOVED").when(F.col("_a").isNull(), "ADDED").when(F.col("pd").eqNullSafe(F.col("rd")), "SAME").otherwise("CHANGED")
    return a.join(b, keys, "full").withColumn("status", status).drop("_a", "_b")


def reduced(pd: Column, rd: Column, tolerance: float = 0.0) -> Column:
    """A working value that the design does not have and that is below its largest (rows 281 to 283, 285)."""
    return F.exists(F.array_except(rd, pd), lambda x: x < F.array_max(pd) - tolerance)


def percent_lower(pd: Column, rd: Column, half_up: bool = False) -> Column:
    """Whole percent by which rd lies below pd, half to even (row 289) or half up (row 290); null if pd is 0."""
    share = F.try_divide((pd - rd) * 100, pd)
    return F.round(share, 0) if half_up else F.bround(share, 0)

"""What counts as a change for one key with a set of design values (pd) and one of working values (rd), both arrays.

Each function is a condition over two columns (rows 278 to 312); the caller joins both stages by key. Limits are fixed
values of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.operators.compare import EQUAL, HARMLESS, IMPOSSIBLE, OK, VIOLATION, outcome

EPS = 1e-9


def sides(cands: DataFrame, by: list[str], stage: str = "stage", value: str = "value", stages: tuple[str, ...] = ("PD", "RD")) -> DataFrame:
    """One row for each key with the sorted set of values of each stage; an absent stage is an empty set."""
    return cands.groupBy(*by).agg(*(F.sort_array(F.collect_set(F.when(F.col(stage) == s, F.col(value)))).alias(s.lower()) for s in stages))


def both(pd: Column, rd: Column) -> Column:
    return (F.size(pd) > 0) & (F.size(rd) > 0)


def replaced(pd: Column, rd: Column) -> Column:
    """The sets differ (row 278)."""
    return both(pd, rd) & (F.sort_array(pd) != F.sort_array(rd))


def added(pd: Column, rd: Column) -> Column:
    """Something that the design does not name (rows 299, 302)."""
    return both(pd, rd) & (F.size(F.array_except(rd, pd)) > 0)


def exchanged(pd: Column, rd: Column) -> Column:
    """Something went and something else came (row 303)."""
    return (F.size(F.array_except(rd, pd)) > 0) & (F.size(F.array_except(pd, rd)) > 0)


def larger(pd: Column, rd: Column) -> Column:
    """The largest value grew (rows 299, 300, 301)."""
    return both(pd, rd) & (F.array_max(rd) > F.array_max(pd) + EPS)


def smaller(pd: Column, rd: Column) -> Column:
    """The smallest value shrank (row 300)."""
    return both(pd, rd) & (F.array_min(rd) < F.array_min(pd) - EPS)


def below_largest(pd: Column, rd: Column) -> Column:
    """The smallest working value lies below the largest of the design (row 294)."""
    return both(pd, rd) & (F.array_min(rd) < F.array_max(pd))


def share(pd: Column, rd: Column) -> Column:
    """By which share the largest value changed; null if the design has none or 0."""
    return F.try_divide(F.array_max(rd) - F.array_max(pd), F.array_max(pd))


def off_by(pd: Column, rd: Column, tolerance: float = 0.02) -> Column:
    """The largest value moved by more than the tolerance (row 292)."""
    return both(pd, rd) & F.coalesce(F.abs(share(pd, rd)) > tolerance, F.lit(False))


def exceeds(pos: Column, ppr: Column, threshold: float = 0.1) -> Column:
    """A later plan exceeds the earlier by more than the threshold (row 297)."""
    return F.coalesce(F.try_divide(ppr - pos, pos) > threshold, F.lit(False))


def outside(pd: Column, rd: Column, limit: Column) -> Column:
    """Values outside the range of the design, or above the least of its limits if they are such (row 293)."""
    top = F.when(limit, F.array_min(pd)).otherwise(F.array_max(pd))
    return both(pd, rd) & ((F.array_max(rd) > top + EPS) | ~limit & (F.array_min(rd) < F.array_min(pd) - EPS))


def worse_percent(pd: Column, rd: Column, tolerance: int = 2) -> Column:
    """Whole percent by which the largest working value exceeds that of the design, half up, above the tolerance (row 290)."""
    return both(pd, rd) & F.coalesce(F.floor(share(pd, rd) * 100 + 0.5 + EPS) > tolerance, F.lit(False))


def fewer_percent(pd: Column, rd: Column, tolerance: int = 5) -> Column:
    """A sum that fell by more than the tolerance in whole percent, half to even, or that is missing (row 289)."""
    fell = F.coalesce(F.bround(F.try_divide((pd - rd) * 100, pd), 0) > tolerance, F.lit(False))
    return F.when(pd.isNull(), F.lit("ADDED")).when(rd.isNull(), F.lit("MISSING")).when(fell, F.lit("FEWER")).otherwise(F.lit("SAME"))


def not_within(pd: Column, rd: Column) -> Column:
    """The working values are no subset of those of the design (row 305): OTHER if they share nothing, else ADDED."""
    new = both(pd, rd) & (F.size(F.array_except(rd, pd)) > 0)
    return F.when(new & ~F.arrays_overlap(pd, rd), F.lit("OTHER")).when(new, F.lit("ADDED"))


def unnumbered(pd: Column, rd: Column) -> Column:
    """Names of one system with a number in one stage and without in the other (row 284)."""
    bare = lambda a: F.exists(a, lambda x: ~x.contains("-"))
    return both(pd, rd) & ~F.arrays_overlap(pd, rd) & (bare(pd) != bare(rd))


def duty(pd: Column, rd: Column) -> Column:
    """What fell below the largest of the design: arrays of structs flow, pressure (row 285)."""
    most = lambda a, f: F.array_max(F.transform(a, lambda x: x[f]))
    new = F.filter(rd, lambda x: ~F.array_contains(pd, x))
    less = lambda f: F.exists(new, lambda x: x[f] < most(pd, f))
    return F.filter(F.array(F.when(less("flow"), F.lit("FLOW")), F.when(less("pressure"), F.lit("PRESSURE"))), lambda x: x.isNotNull())


def jets(pd: Column, rd: Column) -> Column:
    """Label and result of sets of cases with jets and flow (row 307): a case below another one in either."""
    low = F.filter(rd, lambda r: ~F.array_contains(pd, r) & F.exists(pd, lambda p: (r.jets < p.jets) | (r.flow < p.flow)))
    out = F.when(F.sort_array(pd) == F.sort_array(rd), outcome(OK, EQUAL)).when((F.size(low) > 0) & (F.size(pd) == 1), outcome(VIOLATION, "VALUE_DECREASE")).when(F.size(low) > 0, outcome(IMPOSSIBLE)).otherwise(outcome(OK, HARMLESS))
    return F.when((F.size(pd) > 0) | (F.size(rd) > 0), F.when(both(pd, rd), out).otherwise(outcome(IMPOSSIBLE)))


def light(pd: Column, rd: Column, led: str) -> Column:
    """Label and result of sets of light sources (row 308): others than LED come beside it."""
    other = F.size(F.array_except(rd, F.concat(pd, F.array(F.lit(led))))) > 0
    out = F.when(F.array_contains(pd, led) & other, outcome(VIOLATION, "CONFIGURATION_MISMATCH")).when(F.sort_array(pd) == F.sort_array(rd), outcome(OK, EQUAL)).otherwise(outcome(OK, HARMLESS))
    return F.when((F.size(pd) > 0) | (F.size(rd) > 0), F.when(both(pd, rd), out).otherwise(outcome(IMPOSSIBLE)))


def meter(in_pd: Column, in_rd: Column) -> Column:
    """Label and result for one resource (row 309): absence from a text proves nothing."""
    return F.when(in_pd & in_rd, outcome(OK, EQUAL)).when(in_rd, outcome(OK, HARMLESS)).when(in_pd, outcome(IMPOSSIBLE))


def lost_fire_cable(pd: Column, rd: Column) -> Column:
    """Fire-resistant lines of the design in a group whose working window has cables, but none of that kind (row 280):
    arrays of structs mark, cores, section, fire."""
    fire = lambda a: F.exists(a, lambda x: x.fire)
    return (F.size(rd) > 0) & fire(pd) & ~fire(rd)


def family(mark: Column) -> Column:
    """A cable's mark without its fire class."""
    return F.regexp_replace(mark, r"(?i)-?(?:FR)?(?:LS|HF|LTX)$", "")


def thinner_cable(pd: Column, rd: Column) -> Column:
    """Lost cables of which the same family and number of cores has smaller sections only (row 279)."""
    lost = F.filter(pd, lambda p: ~F.array_contains(rd, p))
    same = lambda p: F.transform(F.filter(rd, lambda r: (r.cores == p.cores) & (r.family == p.family)), lambda r: r.section)
    return F.filter(lost, lambda p: F.array_max(same(p)) < p.section)


def cable(size: Column) -> tuple[Column, Column]:
    """Cores and section of a size such as 4(1x70)+1x35 or 3x2,5 (row 118)."""
    text = F.regexp_replace(F.regexp_replace(size, r"\s", ""), "[х×]", "x")
    many, one = r"^([0-9]{1,2})\(([0-9])x([0-9]{1,3}(?:[,.][0-9])?)\)", r"^([0-9]{1,2})x([0-9]{1,3}(?:[,.][0-9])?)"
    number = lambda p, i: F.regexp_replace(F.regexp_extract(text, p, i), ",", ".")
    first = text.rlike(many)
    cores = F.when(first, number(many, 1).try_cast("int") * number(many, 2).try_cast("int")).otherwise(number(one, 1).try_cast("int"))
    return cores, F.when(first, number(many, 3).try_cast("double")).otherwise(number(one, 2).try_cast("double"))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes x0, y0, x1, y1; 0 if they have no area (row 318)."""
    side = lambda i: F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0.0))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    inside = side(0) * side(1)
    return F.coalesce(F.try_divide(inside, area(a) + area(b) - inside), F.lit(0.0))

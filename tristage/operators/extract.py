"""Candidates from page text by a table of rules (rows 082 to 168).

A rule is a pattern with named groups, the context that it needs or that vetoes it, and SQL over the match x that gives
key and value. All rules of a run go over a page in one narrow pass; each match is a row. The archetypes: A, a pattern
gives rows; B, with a veto or a requirement in bounded context; C, spans from one anchor to the next (`spans`); D, the
nearest keyword before a match decides (`nearest_before`); F, named alternatives, one rule each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tristage.functions.match import hits
from tristage.functions.text import flat


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    groups: tuple[str, ...] = ()
    #: SQL over the match: x.raw and x.<group>. A null value drops the match.
    key: str = "''"
    value: str = "x.raw"
    #: Whether the pattern is read on lower-case text.
    fold: bool = True
    #: Regular expressions over the `window` characters before a match (with the match, if inside) and `after` it.
    veto: str = ""
    inside: bool = True
    veto_after: str = ""
    need: str = ""
    window: int = 60
    after: int = 60


def _literal(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def _context(rule: Rule, read: str) -> str:
    left = f"substring({read}, greatest(x.start - {rule.window}, 0) + 1, least(x.start, {rule.window}))"
    right = f"substring({read}, x.end + 1, {rule.after})"
    tests = ["true"]
    if rule.veto:
        tests.append(f"NOT rlike(concat({left}, {'x.raw' if rule.inside else repr('')}), {_literal(rule.veto)})")
    if rule.veto_after:
        tests.append(f"NOT rlike({right}, {_literal(rule.veto_after)})")
    if rule.need:
        tests.append(f"rlike(concat({left}, ' ', {right}), {_literal(rule.need)})")
    return " AND ".join(tests)


def _cut(read: str, left: int = 30, right: int = 70) -> str:
    """SQL of the match with what stands around it."""
    return f"trim(substring({read}, greatest(x.start - {left}, 0) + 1, x.end + {right} - greatest(x.start - {left}, 0)))"


def extract(pages: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """pages' other columns with kind, key, value, raw, start and snippet of every candidate. Null texts give none."""
    keys = [c for c in pages.columns if c != text]
    read = pages.select(*keys, flat(F.coalesce(F.col(text), F.lit(""))).alias("_flat")).withColumn("_low", F.lower("_flat"))
    found = read.select("*", *(hits(F.col("_low" if r.fold else "_flat"), r.pattern, r.groups).alias(f"_h{i}") for i, r in enumerate(rules)))
    rows = []
    for i, r in enumerate(rules):
        where = _context(r, "_low" if r.fold else "_flat")
        row = f"named_struct('kind', '{r.kind}', 'key', cast({r.key} AS string), 'value', cast({r.value} AS string), 'raw', trim(x.raw), 'start', x.start, 'snippet', {_cut('_flat')})"
        rows.append(F.expr(f"filter(transform(filter(_h{i}, x -> {where}), x -> {row}), y -> y.value IS NOT NULL)"))
    return found.select(*keys, F.explode(F.concat(*rows)).alias("c")).select(*keys, "c.*")


def spans(text: Column, anchor: str, most: int) -> Column:
    """Archetype C: anchor and what follows it up to the next anchor, the last one at most `most` characters."""
    found = hits(text, anchor)
    upto = lambda x, i: F.coalesce(F.get(found, i + 1).start, F.least(x.end + most, F.char_length(text)))
    return F.transform(found, lambda x, i: F.struct(x.raw.alias("anchor"), F.substring(text, x.end + 1, upto(x, i) - x.end).alias("span")))


def nearest_before(keywords: Column, start: Column, window: int) -> Column:
    """Archetype D: of an array of hits the last one that ends within `window` characters before start."""
    return F.try_element_at(F.filter(keywords, lambda k: (k.end <= start) & (k.start >= start - window)), F.lit(-1))

"""Weakened coatings and finishes by hand, and long texts."""

import pytest
from pyspark.sql import functions as F

from tristage.operators import elements, extract, layers, materials
from tristage.operators.rules import RULES

COAT = "array<struct<primer:array<string>,enamel:array<string>,primer_layers:int,enamel_layers:int,microns:int>>"


def test_weakenings(spark):
    full, thin = (["ГФ-021"], ["ПФ-115"], 2, 2, 120), (["ГФ-021"], [], 1, None, 80)
    rows = [(1, [full], [full]), (2, [full], [thin]), (3, [thin, full], [(["ГФ-021"], ["ПФ-115"], None, 1, None)]), (4, [full], []), (5, [thin], [full]), (6, [full], [([], [], None, None, 120)])]
    df = spark.createDataFrame(rows, f"i int, pd {COAT}, rd {COAT}")
    got = {r.i: r.w for r in df.select("i", materials.weakenings(F.col("pd"), F.col("rd")).alias("w")).collect()}
    assert got == {1: [], 2: ["MICRONS", "PRIMER_LAYERS", "NO_ENAMEL"], 3: ["ENAMEL_LAYERS"], 4: [], 5: [], 6: []}


def test_worse(spark):
    g, s = [x for x, _ in materials.GROUPS], [x for x, _ in materials.SURFACES]
    req = spark.createDataFrame([(1, g[0], s[0], 0), (1, g[0], s[0], 2), (1, g[1], s[0], 1), (1, g[1], s[1], 5)], "o int, group string, surface string, value int")
    stated = spark.createDataFrame([(1, "general", g[0], None, 1), (1, "general", g[0], None, 0), (1, "general", None, None, 5), (1, "mark", None, "П-1", 2), (1, "mark", None, "П-2", 1), (1, "mark", None, "П-3", 0), (2, "mark", None, "П-1", 5)], "o int, form string, group string, mark string, value int")
    out = materials.worse(stated, materials.strictest(req, ["o"]), ["o"])
    assert sorted((r.form, r.mark or "", r.state, r.need, r.against or "") for r in out.collect()) == [("general", "", "WORSE", 0, g[0]), ("mark", "П-1", "WORSE", 1, g[1]), ("mark", "П-2", "BETWEEN", 0, "")]


LONG = ["ДУ1," * 25_000, "1." * 50_000, "В25 " * 25_000, "стен " * 20_000, "не ниже " * 10_000, "грунт " * 15_000, "ГОСТ 1.1" + ".1" * 40_000]


@pytest.mark.parametrize("text", LONG)
def test_rules_read_long_texts(spark, text):
    """A text of a hundred thousand characters ends no job: no pattern recurses once a repeat."""
    df = spark.createDataFrame([(1, text)], "k int, text string")
    every = [r for rules in RULES.values() for r in rules]
    columns = F.array(*(F.rlike(F.lower("text") if r.fold else F.col("text"), F.lit(r.pattern)) for r in every))
    assert len(df.select(columns.alias("c")).first().c) == len(every)
    flags = [elements.NOT_STRUCTURAL, elements._UNDER, elements._ABOVE, elements._BOUNDARY, elements._CLASS, elements._LIMIT, elements._PREPOSITION, elements._CRANE_FOUNDATION, elements._PLATE, *(elements._re(p) for _, p, _ in elements.ELEMENTS), *(layers._re(p) for _, _, p in layers.KINDS), materials._LAYERS, materials._GENERAL, materials._FOR]
    assert len(df.select(F.array(*(F.rlike("text", F.lit(p)) for p in flags)).alias("c")).first().c) == len(flags)


def test_a_list_of_systems(spark):
    """The last systems of a list of any length have the duty that stands behind it."""
    df = spark.createDataFrame([(1, "ДУ1," * 1000 + "ДУ2 (L=9000 м3/ч, Pc=90 Па)")], "k int, text string")
    assert extract.extract(df, RULES["smoke_fans"]).count() == 1

"""Layers and codes against plain versions."""

import random

from pyspark.sql import functions as F

from tristage.operators import codes, layers


def plain(pd, rd):
    of = lambda s, k: [m for kind, m in s if kind == k and m is not None]
    a, b = {k for k, _ in pd}, {k for k, _ in rd}
    out = {("REMOVED", k, None, None) for k in a - b} | {("ADDED", k, None, None) for k in b - a}
    for k in a & b:
        x, y = of(pd, k), of(rd, k)
        if x and y and len(x) == len(y):
            out |= {("THINNER", k, p, q) for p, q in zip(x, y, strict=True) if q < p}
        elif x and y and sum(y) < sum(x):
            out.add(("THINNER", k, sum(x), sum(y)))
    return out


def test_differences(spark):
    r = random.Random(1)
    stack = lambda: [(r.choice("abcd"), r.choice([None, 10.0, 20.0, 30.0, 45.0])) for _ in range(r.randint(0, 6))]
    cases = [(i, stack(), stack()) for i in range(300)]
    full = lambda s: [(k, m, "") for k, m in s]
    df = spark.createDataFrame([(i, full(a), full(b)) for i, a, b in cases], f"i int, pd {layers.LAYERS}, rd {layers.LAYERS}")
    got = {r.i: {tuple(x) for x in r.d} for r in df.select("i", layers.differences(F.col("pd"), F.col("rd")).alias("d")).collect()}
    assert got == {i: plain(a, b) for i, a, b in cases}
    some = df.select("i", layers.differences(F.col("pd"), F.col("rd"), thinner=False, complete=False, ignore=["a"]).alias("d"))
    assert {r.i: {tuple(x) for x in r.d} for r in some.collect()} == {i: {x for x in plain(a, b) if x[0] == "ADDED" and x[1] != "a"} for i, a, b in cases}
    assert df.select(layers.differences(F.col("pd"), F.col("rd"), False, False, (), False).alias("d")).where("size(d) > 0").count() == 0


def test_pairs(spark):
    kind = f"o int, n int, key string, purpose string, layers {layers.LAYERS}"
    rows = lambda x: spark.createDataFrame([(1, n, k, p, [(s, None, "") for s in kinds]) for n, k, p, kinds in x], kind)
    pd = rows([(1, "1", "тротуар", "ab"), (2, "2", "проезд", "cd"), (3, "2", "газон", "ef")])
    rd = rows([(1, "2", "иное", "cd"), (2, "2.1", "газон", "ef"), (3, "9", "нет", "xy"), (4, None, "", "abx")])
    run = lambda profile: sorted((r.rd, r.pd, r.how, r.key) for r in layers.pair(pd, rd, ["o"], profile).collect())
    assert run("pavement") == [(1, 2, "KEY", "2"), (2, 3, "PURPOSE", "2.1")]
    assert run("roof") == [(1, 2, "KEY", "2"), (2, 3, "KINDS", "2.1"), (4, 1, "KINDS", "1")]
    assert run("wall") == [(1, 2, "KEY", "2")]


def test_mended_codes(spark):
    """A code whose signs were spoilt at up to two places comes back; null and empty readings stay."""
    r, cases = random.Random(2), []
    for i in range(200):
        known = "-".join("".join(r.choice("АБКЖ0123456789") for _ in range(r.randint(2, 5))) for _ in range(3))
        read = known
        for _ in range(r.choice([1, 1, 2])):
            at = r.choice([j for j, c in enumerate(known) if c in "013"] or [None])
            if at is not None:
                read = read[:at] + {"0": "О", "1": "I", "3": "З"}[known[at]] + read[at + 1 :]
        cases.append((i, read, known))
    df = spark.createDataFrame([*cases, (900, None, "КЖ1"), (901, "КЖ1", None)], "i int, read string, known string")
    got = {r.i: (r.c.code, len(r.c.changed)) for r in df.select("i", codes.align(F.col("read"), F.col("known")).alias("c")).collect()}
    assert all(got[i][0] == known and (got[i][1] > 0) == (read != known) for i, read, known in cases)
    assert got[900] == (None, 0) and got[901] == ("КЖ1", 0)


def test_codes_of_a_run(spark):
    rows = [(1, 1, "КЖ1", "OCR"), (1, 2, "КЖ1", "OCR"), (1, 3, None, None), (1, 4, "КЖ7", "OCR"), (1, 5, "другой", "OCR"), (1, 6, "КЖ2", "TEXT_LAYER"), (2, 1, None, None), (3, 1, "А", "OCR"), (3, 2, "Б", "OCR"), (4, 1, "А1", "OCR"), (4, 2, "А2", "OCR")]
    df = spark.createDataFrame(rows, "run int, p int, code string, code_source string")
    out = {(r.run, r.p): (r.code, r.code_state) for r in codes.harmonize(df, ["run"], "p", spark.createDataFrame([("А2",)], "code string")).collect()}
    assert [out[1, p] for p in range(1, 7)] == [("КЖ1", None), ("КЖ1", None), ("КЖ1", "FROM_RUN"), ("КЖ1", "HARMONIZED"), ("другой", None), ("КЖ2", None)]
    assert out[2, 1] == (None, None) and out[3, 2] == ("А", "HARMONIZED") and out[4, 1] == ("А2", "HARMONIZED")

"""Cases that the driver tables do not hold."""

import random

from pyspark.sql import functions as F

from tristage.functions import language, match, normalize, text
from tristage.operators import alignment, changes, compare, extract, incremental, joins, ordered, resolve, review, voting
from tristage.sources import registry
from tristage.streaming import upserts


def test_vote_counts_a_page_once(spark):
    rows = [("c", "PD", 1.0, 1, 1)] * 5 + [("c", "PD", 2.0, 1, 2), ("c", "PD", 2.0, 2, 1)]
    df = spark.createDataFrame(rows, "code string, stage string, value double, file_id int, page int")
    out = voting.weighted_vote(df, ["code", "stage"], ["file_id", "page"]).first()
    assert (out.value, out.weight, out.pages, out.alternatives) == (2.0, 4, 2, 1)


def test_decide_sides(spark):
    df = spark.createDataFrame([(None, None, [], []), (1.0, None, [1.0], []), (10.0, 5.0, [10.0], [5.0]), (10.0, 10.2, [10.0], [10.2])], "pd double, rd double, a array<double>, b array<double>")
    got = lambda kind, **o: [r[0] for r in df.select(compare.decide(kind, F.col("pd"), F.col("rd"), F.col("a"), F.col("b"), **o)).collect()]
    assert got("decrease") == [None, compare.IMPOSSIBLE, compare.VIOLATION, compare.OK]
    assert got("presence") == [None, compare.VIOLATION, compare.OK, compare.OK]
    assert got("relative", threshold=0.6) == [None, compare.IMPOSSIBLE, compare.OK, compare.OK]


def test_decimals_decide_what_is_equal(spark):
    rows = [("1,25", "1,60"), ("2854,2", "2854,20"), ("10", "10.4"), ("159,95", "159.95"), ("3", "4")]
    df = spark.createDataFrame([(a, b, float(a.replace(",", ".")), float(b.replace(",", "."))) for a, b in rows], "a string, b string, pd double, rd double")
    every = lambda c: F.array(c)
    j = compare.judge("any_change", F.col("pd"), F.col("rd"), every("pd"), every("rd"), pd_raw=F.col("a"), rd_raw=F.col("b"))
    assert [tuple(r[0]) for r in df.select(j).collect()] == [(compare.VIOLATION, "VALUE_MISMATCH"), (compare.OK, "EQUAL_AFTER_DECIMAL_NORMALIZATION"), (compare.OK, "EQUAL_AFTER_DECIMAL_NORMALIZATION"), (compare.OK, "EQUAL_AFTER_DECIMAL_NORMALIZATION"), (compare.VIOLATION, "VALUE_MISMATCH")]


def test_keys_with_null_values(spark):
    a = spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "k int, value double")
    b = spark.createDataFrame([(1, None), (2, None), (4, 1.0)], "k int, value double")
    assert {r.k: r.status for r in compare.keyed(a, b, ["k"]).collect()} == {1: "SAME", 2: "CHANGED", 3: "REMOVED", 4: "ADDED"}


def test_odd_values_do_not_crash(spark):
    df = spark.createDataFrame([("abc", 0.0, [0.0, 0.0])], "t string, z double, v array<double>")
    one = df.select(normalize.number(F.col("t")), normalize.location(F.lit("ось 00012345678901234567890-0")), compare.percent_lower(F.col("z"), F.lit(1.0)), text.cosine(F.col("v"), F.col("v")), changes.exceeds(F.col("z"), F.lit(1.0)), text.numbers(F.lit("29 200,00 и 5"))).first()
    assert tuple(one) == (None, "12345678901234567890.0", None, None, False, [29200.0, 5.0])


def test_hits_have_offsets(spark):
    df = spark.createDataFrame([("é12 b3",), ("",), (None,)], "t string")
    got = [[(h.start, h.end, h.raw, h.n) for h in r[0]] for r in df.select(match.hits(F.col("t"), "[a-zé]([0-9]+)", ["n"])).collect()]
    assert got == [[(0, 3, "é12", "12"), (4, 6, "b3", "3")], [], []]


def test_spans_and_nearest(spark):
    df = spark.createDataFrame([("x1 aa x2 bbbbbb",)], "t string")
    assert [tuple(s) for s in df.select(extract.spans(F.col("t"), "x[0-9]", 4)).first()[0]] == [("x1", " aa "), ("x2", " bbb")]
    near = extract.nearest_before(match.hits(F.col("t"), "x[0-9]"), F.lit(9), 5)
    assert df.select(near.raw).first()[0] == "x2"


def test_sheet_gaps_are_inferred_between_anchors(spark):
    rows = [("f", 11, 11), ("f", 12, None), ("f", 13, 13), ("g", 1, 1), ("g", 2, None), ("g", 3, 5), ("h", 1, None), ("h", 2, 4)]
    df = spark.createDataFrame(rows, "f string, page int, sheet int")
    got = {(r.f, r.page): r.sheet for r in ordered.fill(df, ["f"], "page", "sheet", F.lit(True)).collect()}
    assert got[("f", 12)] == 12 and got[("g", 2)] is None and got[("h", 1)] is None
    assert [(r.f, r["first"], r["last"]) for r in ordered.runs(df, ["f"], "page", "sheet").collect()] == [("f", 11, 13)]


def test_words(spark):
    df = spark.createDataFrame([("Тёплые полы", "Áåòîí êëàññà", "ГОСТ")], "a string, b string, c string")
    r = df.select(language.stems(F.col("a")), language.mend(F.col("b")).text, language.one_digit_apart(F.lit("70.13330"), F.lit("70.1330")), language.one_digit_apart(F.lit("1.13130"), F.lit("10.13130")), language.convert(F.lit(6100.0), F.lit("мм"), F.lit("м"))).first()
    assert tuple(r) == (["тепл", "пол"], "Бетон класса", True, False, 6.1)


def test_merge_keeps_decisions(spark):
    old = spark.createDataFrame([(1, "V", "1", "2", "CONFIRMED_VIOLATION", "RUN", {"promoted_at": "x", "other": "y"}), (2, "V", "1", "2", "SPLIT", "INSPECTOR_SPLIT", {}), (3, "V", "1", "2", "PENDING", "RUN", {})], "k int, label string, pd string, rd string, verification string, origin string, marks map<string,string>")
    new = spark.createDataFrame([(1, "N", "1", "1", False), (4, "V", "3", "1", True)], "k int, label string, pd string, rd string, candidate boolean")
    got = {r.k: (r.label, r.rd, r.verification, r.marks) for r in review.merge(old, new, ["k"]).collect()}
    assert got == {1: ("N", "1", "PENDING", {"promoted_at": "x", "reopened": "CONFIRMED_VIOLATION"}), 2: ("V", "2", "SPLIT", {}), 4: ("V", "1", "PENDING", {})}


def test_maximal_is_a_partial_order(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 1, 1), ("b", 2, 2)], "chain string, x int, y int")
    out = {r.chain: (r.maximal, r.status) for r in resolve.maximal(df, ["chain"], ["x", "y"]).collect()}
    assert out == {"a": (2, "CLARIFICATION_REQUIRED"), "b": (1, "RESOLVED")}


def test_runs_and_gaps(spark):
    df = spark.createDataFrame([("f", p, s) for p, s in ((1, 11), (2, 12), (9, 19), (10, 20), (11, 5))], "f string, page int, sheet int")
    out = sorted((r["first"], r["last"]) for r in ordered.runs(df, ["f"], "page", "sheet").collect())
    assert out == [(1, 2), (9, 10)]


def test_plan_modes(spark):
    now = spark.createDataFrame([(1, "a", "PD"), (2, "b", "RD")], "id int, d string, s string")
    empty = now.where("false")
    mode = lambda before: incremental.plan(now, before, "id", "d", "s").first().mode
    assert mode(empty) == "FULL"
    assert mode(now.where("id = 1")) == "PARTIAL"
    assert mode(now.withColumn("s", F.lit("ID"))) == "FULL"


def test_lookup_and_registry(spark, tmp_path):
    for n, t in (("a.txt", "x"), ("b.txt", "x"), ("c.md", "y")):
        (tmp_path / n).write_text(t)
    files = registry.mark_duplicates(registry.scan(spark, f"file://{tmp_path}"), "sha256", "path").collect()
    assert sum(r.duplicate_of is not None for r in files) == 1 and {r.extension for r in files} == {"txt", "md"}
    left = spark.createDataFrame([(1, 1), (1, 9), (7, 1)], "k int, line int")
    index = spark.createDataFrame([(1, 1, "x"), (1, 2, "w")], "k int, line int, f string")
    got = {(r.k, r.line): (r.f, r.found_by) for r in joins.lookup(left, index, ["k", "line"], "f", ["f"]).collect()}
    assert got == {(1, 1): ("x", "EXACT"), (1, 9): ("w", "FALLBACK"), (7, 1): (None, "NONE")}


def test_stream_upsert(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, x string").write.parquet(str(src))
    got = []
    q = upserts.upsert(spark.readStream.schema("k int, v int, x string").parquet(str(src)), ["k"], ["v"], str(tmp_path / "cp"), lambda df, n: got.extend((r.k, r.x) for r in df.collect()))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [(1, "b"), (2, "c")]


def test_alignment_is_the_heaviest_chain():
    """Against the table over all prefixes."""
    r = random.Random(1)
    for _ in range(500):
        n, m = r.randint(1, 7), r.randint(1, 7)
        pairs = [(i, j, round(r.random(), 2)) for i in range(n) for j in range(m) if r.random() < 0.4]
        held, best = {(i, j): s for i, j, s in pairs}, [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + held.get((i - 1, j - 1), -9))
        got = alignment.chain(pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))
        assert abs(sum(held[x] for x in got) - best[n][m]) < 1e-9

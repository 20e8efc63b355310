"""Chains of editions against going through the pairs one by one."""

import random

from tristage.operators import chains

MARKS = ["КЖ1", "КЖ", "КЖ2", "АР", "АР1", "ТОМ5.1", "ОВ2.1", "ОВ"]
KINDS = "g int, family long, marks array<string>, parts array<string>"


def may(a, b):
    if not a or not b or a == b or a.startswith("ТОМ") or b.startswith("ТОМ"):
        return True
    letters = lambda m: "".join(c for c in m if c.isalpha())
    digit = lambda m: any(c.isdigit() for c in m)
    return letters(a) == letters(b) and not (digit(a) and digit(b))


def one_by_one(fams, edges):
    root = {f: f for f, _, _ in fams}
    marks, parts = {f: set(m) for f, m, _ in fams}, {f: set(p) for f, _, p in fams}
    for a, b in sorted(edges):
        x, y = root[a], root[b]
        if x == y or not all(may(p, q) for p in marks[x] for q in marks[y]) or (parts[x] and parts[y] and parts[x] != parts[y]):
            continue
        marks[x] |= marks[y]
        parts[x] |= parts[y]
        root = {f: x if r == y else r for f, r in root.items()}
    return root


def test_guarded_merge_equals_a_sequential_run(spark):
    r, fams, edges, want = random.Random(7), [], [], {}
    for g in range(200):
        n = r.randint(2, 9)
        own = [(f, [r.choice(MARKS)] if r.random() < 0.9 else [], [r.choice(["К1", "К2"])] if r.random() < 0.3 else []) for f in range(n)]
        met = {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5}
        fams += [(g, *f) for f in own]
        edges += [(g, *e) for e in met] + [(g, b, a) for a, b in list(met)[:1]]
        want |= {(g, f): root for f, root in one_by_one(own, met).items()}
    got = chains.guarded_merge(spark.createDataFrame(fams, KINDS), spark.createDataFrame(edges, "g int, a long, b long"), ["g"])
    assert {(x.g, x.family): x.root for x in got.collect()} == want


def test_odd_edges(spark):
    fams = spark.createDataFrame([(1, 1, ["АР"], []), (1, 2, ["АР"], [])], KINDS)
    run = lambda e: sorted((x.family, x.root) for x in chains.guarded_merge(fams, spark.createDataFrame(e, "g int, a long, b long"), ["g"]).collect())
    assert run([]) == [(1, 1), (2, 2)] == run([(1, 1, 1), (1, 1, 9), (2, 1, 2)])
    assert run([(1, 2, 1), (1, 1, 2)]) == [(1, 1), (2, 1)]


DOC = "o int, file_id string, place long, group string, part string, section_part string, mark string, title string, single boolean, archive boolean, year int, issue_corr int, correction int, correction_sub int, gip int, change int, version int, date string"


def doc(place, mark, title="", single=False, archive=False, year=None, correction=None, change=None, part=None, o=1):
    return (o, f"L{place}", place, "PD", part, None, mark, title, single, archive, year, None, correction, None, None, change, None, None)


def test_build(spark):
    docs = [
        doc(1, "ПЗУ"), doc(2, "ПЗУ", correction=1), doc(3, "ПЗУ", correction=3),  # one family, in order
        doc(4, "ПЗ", change=2), doc(5, "ПЗ", correction=3),  # one that can't be ordered
        doc(6, None, title="акт", single=True), doc(7, None, title="акт", single=True),  # no editions
        doc(8, "ПБ", year=2022), doc(9, "ПБ1", year=2025),  # apart by issue folders, marks agree
        doc(10, "КЖ1"), doc(11, "КЖ2"), doc(12, None, title="книга"), doc(13, None, title="книга"),
        doc(14, "ОВ"), doc(15, "ОВ1"),  # alike in content
    ]
    terms = [(1, f"L{d}", 20, f"c{i}", 5) for d in (10, 11, 14, 15) for i in range(3)]
    out = chains.build(spark.createDataFrame(docs, DOC), spark.createDataFrame(terms, "o int, volume string, pages int, term string, n long"), ["o"])
    rows = {r.file_id: r for r in out.collect()}
    assert len(rows) == 15
    assert [(rows[f].status, rows[f].predecessor, rows[f].successor) for f in ("L1", "L2", "L3")] == [("SUPERSEDED", None, "L2"), ("SUPERSEDED", "L1", "L3"), ("CURRENT", "L2", None)]
    assert {rows["L4"].status, rows["L5"].status} == {"CLARIFICATION_REQUIRED"} and rows["L5"].predecessor is None
    assert rows["L6"].chain != rows["L7"].chain and rows["L6"].status == "CURRENT"
    assert (rows["L8"].status, rows["L9"].status, rows["L9"].predecessor) == ("SUPERSEDED", "CURRENT", "L8")
    assert rows["L10"].chain != rows["L11"].chain  # two numbers never agree, whatever their content
    assert rows["L12"].chain == rows["L13"].chain and rows["L14"].chain == rows["L15"].chain


def test_chain_index(spark):
    docs = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "gone"), ("x", "y"), ("y", "x"), ("z", "y")]
    rows = [(1, *d) for d in docs] + [(2, str(i), str(i - 1) if i else None) for i in range(40)]
    got = {(r.o, r.file_id): r["rank"] for r in chains.chain_index(spark.createDataFrame(rows, "o int, file_id string, predecessor string"), ["o"]).collect()}
    assert [got[1, f] for f in "abcdexyz"] == [0, 1, 2, 3, 0, None, None, None]
    assert [got[2, str(i)] for i in range(40)] == list(range(40))
    empty = spark.createDataFrame([], "o int, file_id string, predecessor string")
    assert chains.chain_index(empty, ["o"]).collect() == []

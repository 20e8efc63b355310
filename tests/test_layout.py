"""Words of two editions by place: made-up pages whose changes are known."""

import random

from tristage.operators import graph, layout

WORD = "p int, word int, t string, x0 double, y0 double, x1 double, y1 double, width double, height double"
W, H = 1190.0, 842.0


def word(p, i, t, x, y, w=W, h=H):
    return (p, i, t, x - 10.0, y - 4.0, x + 10.0, y + 4.0, w, h)


def grid(p, n=60, dx=0.0, dy=0.0, k=1.0):
    """n words of their own far from any field of the sheet."""
    return [word(p, i, f"слово{i}", (200 + 60 * (i % 10) + dx) * k, (150 + 60 * (i // 10) + dy) * k, W * k, H * k) for i in range(n)]


def run(spark, old, new):
    frames = [layout.service_zone(spark.createDataFrame(x, WORD), ["p"]) for x in (old, new)]
    return layout.place(*frames, ["p"])


def test_layouts(spark):
    old, new = [], []
    old += grid(1)
    new += [w for w in grid(1) if w[1] != 7] + [word(1, 90, "новое", 500.0, 600.0)]
    old += grid(2)  # shifted as a whole, and half of it by another amount
    new += [word(2, w[1], w[2], w[3] + 10 + (50 if w[1] % 10 < 5 else -80), w[4] + 4 + (20 if w[1] % 10 < 5 else 45)) for w in grid(2)]
    old += grid(3)  # no peak
    new += [word(3, i, f"иное{i}", 200.0 + 60 * (i % 10), 150.0 + 60 * (i // 10)) for i in range(60)]
    old += grid(4)  # another format
    new += grid(4, k=1.4)
    old += [*grid(5), word(5, 90, "1250", 400.0, 620.0), word(5, 91, "два", 700.0, 620.0), word(5, 92, "12.03.24", 1100.0, 830.0)]
    new += [*grid(5), word(5, 90, "1300", 410.0, 620.0), word(5, 91, "два", 760.0, 640.0), word(5, 92, "14.05.26", 1100.0, 830.0)]
    old += grid(6)  # no words on the other side
    out = run(spark, old, new)
    pages = {r.p: r for r in out.pages.collect()}
    assert {p: r.layout for p, r in pages.items()} == {1: "SAME_PLACE", 2: "SHIFTED", 3: "RELAID", 4: "RESIZED", 5: "SAME_PLACE"}
    assert (pages[1].matched, pages[1].content_removed, pages[1].content_added) == (59, 1, 1)
    assert pages[2].matched == 60 and sorted((o.dx, o.dy, o.n) for o in pages[2].offsets) == [(-80.0, 45.0, 30), (50.0, 20.0, 30)]
    assert pages[3].matched == 0 and pages[3].content_added == 60
    assert pages[4].matched == 60 and pages[4].content_removed == 0
    states = {(r.p, r.side, r.word): r.state for r in out.words.collect()}
    assert states[1, "OLD", 7] == "REMOVED" and states[1, "NEW", 90] == "ADDED" and states[5, "OLD", 91] == "MOVED" == states[5, "NEW", 91]
    assert states[5, "OLD", 92] == "SERVICE" and (6, "OLD", 1) not in states
    assert sorted((r.p, r.was, r.became, r.kind) for r in out.pairs.collect()) == [(5, "12.03.24", "14.05.26", "DATE"), (5, "1250", "1300", "NUMBER")]
    zones = {(r.p, r.side): (r.zone, r.n, r.x0) for r in out.zones.collect()}
    assert zones[1, "OLD"] == (1, 1, round((200 + 60 * 7 - 10) / W, 4)) and not any(p == 3 for p, _ in zones)


def test_empty_side(spark):
    none = spark.createDataFrame([], WORD)
    out = layout.place(layout.service_zone(none, ["p"]), layout.service_zone(none, ["p"]), ["p"])
    assert all(df.count() == 0 for df in (out.pages, out.words, out.pairs, out.zones))


def test_service_zone(spark):
    rows = [
        word(1, 0, "В", 400.0, 300.0), word(1, 1, "производство", 450.0, 300.0), word(1, 2, "работ", 500.0, 300.0), word(1, 3, "Иванов", 450.0, 400.0), word(1, 4, "далеко", 100.0, 500.0),
        word(2, 0, "В", 400.0, 300.0), word(2, 1, "производство", 450.0, 300.0), word(2, 2, "работ", 500.0, 300.0), word(2, 3, "после", 560.0, 300.0), word(2, 4, "низ", 1000.0, 740.0),
        word(3, 0, "ГИП", 1000.0, 800.0), word(3, 1, "низ", 1000.0, 740.0), word(3, 2, " ", 600.0, 400.0), word(3, 3, "-", 600.0, 400.0), word(3, 4, "край", 30.0, 400.0), word(3, 5, "угол", 1100.0, 20.0),
    ]
    got = {(r.p, r.word): (r.t, r.service) for r in layout.service_zone(spark.createDataFrame(rows, WORD), ["p"]).collect()}
    assert [got[1, i][1] for i in range(5)] == [True, True, True, True, False]
    assert [got[2, i][1] for i in range(5)] == [False] * 5
    assert got[3, 1] == ("низ", True) and (3, 2) not in got and got[3, 3] == ("–", False) and got[3, 4][1] and got[3, 5][1]


def test_repeated_words_are_service(spark):
    rows = [(1, *word(p, i, "архив", 600.0, 400.0 + d)) for p, i, d in ((1, 0, 0.0), (2, 0, 1.0), (3, 0, 0.5))] + [(1, *word(p, 1, f"своё{p}", 300.0, 300.0)) for p in (1, 2, 3)]
    df = spark.createDataFrame(rows, "f int, " + WORD)
    often = layout.repeated(df, ["f"], "p")
    got = {(r.p, r.word): r.service for r in layout.service_zone(df, ["f", "p"], often, ["f"]).collect()}
    assert all(got[p, 0] and not got[p, 1] for p in (1, 2, 3))


def naive_zones(boxes, gap):
    boxes = [list(b) for b in boxes]
    while True:
        hit = next(((a, b) for a in range(len(boxes)) for b in range(a) if boxes[a][0] - gap <= boxes[b][2] and boxes[b][0] - gap <= boxes[a][2] and boxes[a][1] - gap <= boxes[b][3] and boxes[b][1] - gap <= boxes[a][3]), None)
        if not hit:
            return sorted(map(tuple, boxes))
        p, q = boxes.pop(hit[0]), boxes.pop(hit[1])
        boxes.append([min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])])


def test_zones_are_the_closure(spark):
    r, rows, want = random.Random(3), [], {}
    for p in range(30):
        boxes = []
        for _ in range(r.randint(1, 25)):
            x, y = r.randint(0, 600), r.randint(0, 400)
            boxes.append((float(x), float(y), float(x + r.randint(5, 120)), float(y + r.randint(4, 20))))
        rows += [(p, i, *b) for i, b in enumerate(boxes)]
        want[p] = naive_zones(boxes, 12.0)
    df = spark.createDataFrame(rows, "p int, box int, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for z in layout.zones(df, ["p"], 12.0).collect():
        got.setdefault(z.p, []).append((z.x0, z.y0, z.x1, z.y1))
    assert {p: sorted(z) for p, z in got.items()} == want


def test_greedy_takes_the_first_free(spark):
    r, rows, want = random.Random(5), [], set()
    for g in range(40):
        pairs = {(r.randint(0, 6), r.randint(0, 6)): round(r.random(), 1) for _ in range(14)}
        left, right = set(), set()
        for d, a, b in sorted((d, a, b) for (a, b), d in pairs.items()):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.add((g, a, b))
        rows += [(g, a, b, d) for (a, b), d in pairs.items()]
    df = spark.createDataFrame(rows, "g int, a int, b int, d double")
    assert {tuple(x) for x in graph.greedy(df, ["g"], [df.d, df.a, df.b], "a", "b").collect()} == want

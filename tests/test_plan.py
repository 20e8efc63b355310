"""Rooms on plans made by hand, and every reason of a registration."""

from tristage.operators import plan

KIND = "p int, word int, t string, x0 double, y0 double, x1 double, y1 double, conf double, width_mm double, height_mm double"
W, H = 420.0, 297.0


def word(i, t, x, y, p=1, conf=None, w=W, h=H):
    """A word of 2.5 mm height whose centre is at (x, y) millimetres."""
    return (p, i, t, x / W - 0.004, (y - 1.25) / H, x / W + 0.004, (y + 1.25) / H, conf, w, h)


def test_plan_rooms(spark):
    rows = [
        word(0, "поз.", 100, 90), word(1, "169", 105, 90),  # one position, a line above the number
        word(2, "140", 100, 100), word(3, "Физического", 108, 100), word(4, "эксперимента", 102, 105), word(5, "B2.9/П1", 104, 95),
        word(6, "142,", 100, 110), word(7, "Лаборантская", 110, 110), word(8, "82.10", 104, 113), word(9, "В27", 98, 113),
        word(10, "300", 300, 100), word(11, "мм", 305, 100),  # a number without a name
        word(12, "140", 300, 200), word(13, "План", 306, 200), word(14, "К1", 303, 203),  # the same room again
        word(15, "В9", 100, 104, conf=5.0), word(16, "В8", 200, 250),  # read badly; far from any number
        word(20, "012", 100, 100, p=2, w=None, h=None), word(21, "Венткамера", 100, 103, p=2, w=None, h=None), word(22, "поз.7", 101, 98, p=2, w=None, h=None),
    ]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = {(r.p, r.number): (r["name"], r.marks, r.positions, round(r.box.x0 * W)) for r in plan.plan_rooms(df, ["p"]).collect()}
    assert got == {
        (1, "140"): ("Физического эксперимента", ["В2.9", "К1", "П1"], ["поз.169"], 98),
        (1, "142"): ("Лаборантская", ["В2.10", "В2.7"], [], 98),
        (2, "012"): ("Венткамера", [], ["поз.7"], 98),
    }
    assert (1, "300") in {(r.p, r.number) for r in plan.plan_rooms(df, ["p"], least=0).collect()}
    assert plan.plan_rooms(df.where("false"), ["p"]).collect() == []


def test_registration(spark):
    kind = "o int, page int, sheet int, status string, layout string, removed int, added int, numbers int"
    rows = [
        (1, 1, 1, "CHANGED", "SAME_PLACE", 5, 6, 1), (1, 2, 2, "CHANGED", "SAME_PLACE", 5, 6, 1), (1, 3, 3, "CHANGED", "SAME_PLACE", 0, 0, 0), (1, 4, None, "CHANGED", "SAME_PLACE", 9, 9, 0), (1, 5, 5, "CHANGED", "RELAID", 9, 9, 0),
        (1, 6, 6, "CHANGED", "SAME_PLACE", 2, 2, 0), (1, 7, 7, "CHANGED", "SHIFTED", 20, 2, 0), (1, 8, 8, "ADDED", None, 30, 0, 0), (1, 9, 9, "CHANGED", "SAME_PLACE", 30, 0, 0), (1, 10, 10, "SAME", None, 0, 0, 0), (1, 11, 11, "CHANGED", "SAME_PLACE", 1, 0, 0),
        (2, 1, 1, "CHANGED", "SAME_PLACE", 30, 0, 0), (3, 1, 1, "CHANGED", "SAME_PLACE", 30, 0, 0),
    ]
    numbers = lambda x, k: spark.createDataFrame(x, f"o int, {k} int, number int")
    out = plan.registration(spark.createDataFrame(rows, kind), spark.createDataFrame([(1, 2), (2, 3)], "o int, number int"), numbers([(1, 1, 3), (1, 9, 2), (2, 1, 3), (3, 7, 4)], "page"), numbers([(1, 2, 3), (1, 7, 2)], "sheet"), spark.createDataFrame([(1, p) for p in (7, 8, 9)], "o int, page int"), ["o"])
    got = {(r.o, r.page): (r.state, r.why, r.found) for r in out.collect()}
    assert got == {
        (1, 1): ("REGISTERED", "MARKED", [3]), (1, 2): ("REGISTERED", "MARKED", [3]), (1, 3): ("NOT_NEEDED", "SAME_CONTENT", []), (1, 4): ("UNKNOWN", "NO_SHEET_NUMBER", []), (1, 5): ("UNKNOWN", "NOT_COMPARED", []),
        (1, 6): ("UNKNOWN", "SMALL_CHANGE", []), (1, 7): ("UNREGISTERED", "NO_MARK", []), (1, 8): ("UNKNOWN", "NEW_SHEET", []), (1, 9): ("UNREGISTERED", "NO_MARK", []), (1, 11): ("UNKNOWN", "NOT_COMPARED", []),
        (2, 1): ("UNKNOWN", "NO_NEW_MARKS", []), (3, 1): ("UNKNOWN", "NO_LIST", []),
    }

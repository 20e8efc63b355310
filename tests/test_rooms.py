"""Room tables from word boxes: pages made by hand."""

from tristage.operators import rooms

KIND = "p int, word int, t string, x0 double, y0 double, x1 double, y1 double"
HEAD = [("Номер", 0.0), ("помещения", 0.02), ("Наименование", 0.10), ("Площадь,", 0.30), ("м2", 0.33), ("Кат.", 0.36)]


class Page:
    def __init__(self, p):
        self.p, self.words = p, []

    def put(self, t, x, y, h=0.008):
        self.words.append((self.p, len(self.words), t, x, y, x + 0.018, y + h))

    def head(self, x, y, words=HEAD):
        for t, dx in words:
            self.put(t, x + dx, y)

    def row(self, x, y, number, name, area=None, cat=None):
        self.put(number, x + 0.005, y)
        for i, t in enumerate(name.split()):
            self.put(t, x + 0.06 + 0.04 * i, y)
        if area:
            self.put(area, x + 0.30, y)
        if cat:
            self.put(cat, x + 0.37, y)


def found(spark, *pages):
    df = spark.createDataFrame([w for p in pages for w in p.words], KIND).repartition(3)
    out, counts = rooms.rooms(df, ["p"])
    got = {}
    for r in out.collect():
        got.setdefault(r.p, set()).add((r.number, r.name, r.area, r.category))
    return got, {r.p: (r.rows, r.parsed) for r in counts.collect()}


def test_tables(spark):
    a = Page(1)  # two tables side by side, an empty cell, a wrapped name, prose below the table
    a.put("Экспликация", 0.05, 0.03)
    a.head(0.03, 0.06)
    a.head(0.53, 0.06)
    for i, (n, name, area, cat) in enumerate([("101", "Тамбур входной", "12,5", None), ("102", "Лаборантская", None, None), ("103", "Венткамера", "99.7", "В2"), ("104", "м2", "5,0", None)]):
        a.row(0.03, 0.09 + 0.02 * i, n, name, area, cat)
    for i, n in enumerate(["201", "202", "203"]):
        a.row(0.53, 0.09 + 0.02 * i, n, "Комната отдыха", "10,0")
    a.put("персонала", 0.60, 0.136)  # goes on below the last name, within a word's height
    a.row(0.03, 0.60, "777", "Подпись плана")
    b = Page(2)  # learned forms: letters before digits, one that does not repeat
    b.put("Спецификация", 0.05, 0.04)
    b.put("помещений", 0.12, 0.04)
    b.head(0.03, 0.06, [("Номер", 0.0), ("Имя", 0.08), ("Площадь", 0.16)])
    for i, n in enumerate(["А101", "А102", "7"]):
        b.row(0.03, 0.09 + 0.02 * i, n, "Зал собраний", "40,5")
    c = Page(3)  # no explication
    c.put("Наименование", 0.2, 0.1)
    c.row(0.05, 0.15, "101", "Просто текст", "1,0")
    d = Page(4)  # one table below another: numbers begin anew
    d.put("Экспликация", 0.05, 0.01)
    for k, y in enumerate((0.05, 0.50)):
        d.head(0.03, y)
        for i, n in enumerate(["11", "12", "13", "14"]):
            d.row(0.03, y + 0.03 + 0.02 * i, n, f"Этаж {'первый второй'.split()[k]}", "1,5")
    got, counts = found(spark, a, b, c, d)
    assert got[1] == {("101", "Тамбур входной", 12.5, None), ("102", "Лаборантская", None, None), ("103", "Венткамера", 99.7, "В2"), ("201", "Комната отдыха", 10.0, None), ("202", "Комната отдыха", 10.0, None), ("203", "Комната персонала отдыха", 10.0, None)}
    assert counts[1] == (7, 6)
    assert got[2] == {("А101", "Зал собраний", 40.5, None), ("А102", "Зал собраний", 40.5, None)} and 3 not in got
    assert got[4] == {(n, f"Этаж {k}", 1.5, None) for n in ("11", "12", "13", "14") for k in ("первый", "второй")}


def test_no_words(spark):
    out, counts = rooms.rooms(spark.createDataFrame([], KIND), ["p"])
    assert out.collect() == [] == counts.collect()

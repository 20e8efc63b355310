"""What keeps queries within their limits on larger tables, seen in their plans and in small tables."""

import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"
PAGES = ["element_classes", "label_values", "picked_columns", "roof_stacks", "pavement_stacks", "rebar_classes", "plate_thicknesses", "mended_codes", "name_marks", "coating_systems", "schedule_items", "crane_free_text"]


@pytest.mark.parametrize("name", PAGES)
def test_pages_are_dealt_to_all_tasks(spark, name):
    """The file of the parts is one split: without a shuffle one task would do all the work."""
    assert e.queries()[name](spark, DATA).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("name", ["element_classes", "label_values", "picked_columns", "roof_stacks", "pavement_stacks", "rebar_classes"])
def test_no_filter_repeats_what_columns_reckon(spark, name):
    """A filter that Spark moves below computed columns holds their expressions once more for every use."""
    plan = e.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan()
    filters = [x for x in plan.treeString().splitlines() if x.strip(" :+-").startswith("Filter")]
    assert not [x for x in filters if "regexp" in x or "split(" in x or "lambda" in x.lower()]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize(("name", "most"), [("page_shift", 6), ("part_shift", 9)])
def test_votes_are_not_shuffled(spark, name, most):
    """Words go to the task of their page; votes and the cells around theirs stay there."""
    assert exchanges(e.queries()[name](spark, DATA)) <= most


def test_only_kinds_meet(spark):
    """Stacks meet by their kinds alone: no layers go through the join."""
    from tristage.operators import layers

    stack = "array(named_struct('kind', 'a', 'mm', 1D, 'text', ''), named_struct('kind', 'b', 'mm', 2D, 'text', '')) AS layers"
    df = spark.sql(f"SELECT 1 AS o, id AS n, 'k' AS key, '' AS purpose, {stack} FROM range(3)")
    plan = layers.pair(df, df, ["o"], "roof").select("o", "rd", "pd")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "array_intersect" in x]


def test_marks_of_one_place_meet_once(spark):
    """300 marks at one place and one beside them: no broadcast, and copies aren't joined with each other."""
    from tristage.operators import spatial

    df = spark.sql("SELECT 'b' AS g, id AS k, 1.0D AS x, 2.0D AS y FROM range(300) UNION ALL SELECT 'b', 1000, 1.5D, 2.0D UNION ALL SELECT 'c', 7, 0.0D, 0.0D")
    out = spatial.nearest(df, df, ["g"], "k", "x", "y", 20.0)
    assert {r.k: (r.nearest, r.distance) for r in out.collect()} == {k: (1 if k == 0 else 0, 0.5 if k == 1000 else 0.0) for k in [*range(300), 1000]}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over the given tables."""
    import duckdb

    con = duckdb.connect()
    for t, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = e.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    flat = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    return flat(map(tuple, got.collect())), flat(want)


def test_long_tables_of_rooms(spark, tmp_path):
    """2,100 rooms of a brand: both of its tables have some numbers, and some have four digits."""
    part = "SELECT i AS p_partkey, 'red oak' AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, CAST(i % 50 + 1 AS INTEGER) AS p_size, 900.0 AS p_retailprice FROM range(2100) t(i)"
    got, want = both(spark, tmp_path, "room_tables", part=part)
    assert got == want and len(got) < 2100


def test_zones_in_many_rounds(spark, tmp_path):
    """A page of this supplier needs more than five rounds."""
    got, want = both(spark, tmp_path, "word_zones", lineitem="SELECT * FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_suppkey = 363")
    assert got == want


def test_copies_of_names_stay_linear(spark):
    """400 rows with two sets of words: copies are linked with the first, the sets with each other."""
    from tristage.operators import joins

    df = spark.sql("SELECT 'b' AS g, id AS k, CASE WHEN id % 2 = 0 THEN 'red oak' WHEN id = 7 THEN 'red' ELSE 'oak red red' END AS t FROM range(400) UNION ALL SELECT 'b', 900, NULL")
    out = joins.token_similarity(df, ["g"], "k", "t", 0.3).collect()
    assert sum(r.link == "COPY" for r in out) == 398 and all(r.x == 0 for r in out if r.link == "COPY")
    assert [(r.x, r.y, r.similarity) for r in out if r.link == "PAIR"] == [(0, 7, 0.5)]


def test_acts_are_parsed_once(spark):
    """The filter of acts stays above what was read from their XML."""
    plan = e.queries()["act_contents"](spark, DATA)._jdf.queryExecution().optimizedPlan()
    assert not [x for x in plan.treeString().splitlines() if x.strip(" :+-").startswith("Filter") and "xpath" in x]


def test_contents_meet_in_blocks(spark, tmp_path, monkeypatch):
    """Blocks of three find every pair that the SQL finds, those of copies included; as classes, copies are linked with
    the first."""
    from tristage.operators import relations

    monkeypatch.setattr(relations, "BLOCK", 3)
    text = "CASE WHEN i % 10 = 3 THEN 'a a b c' ELSE concat('a b c d ', repeat('e ', i % 7), 'u', i) END"
    got, want = both(spark, tmp_path, "same_content", conversations=f"SELECT i AS conv_id, t AS turn, 'user' AS role, {text} AS text FROM range(40) r(i), range(2) s(t)")
    assert got == want
    assert {r[:2] for r in got if r[0] % 10 == 3 == r[1] % 10} == {(3, 13), (3, 23), (3, 33), (13, 23), (13, 33), (23, 33)}
    terms = spark.sql(f"SELECT i AS volume, 6 AS pages, explode(split({text}, ' +')) AS term FROM (SELECT id AS i FROM range(40))").groupBy("volume", "pages", "term").count()
    linked = relations.same_content(relations.profile_classes(terms.withColumnRenamed("count", "n"), []), [], 0.6).collect()
    assert sum(r.link == "COPY" for r in linked) == 3 and all(r.x == 3 for r in linked if r.link == "COPY")
    assert "PAIR" in {r.link for r in linked}


@pytest.mark.parametrize(("often", "spots"), [(0.0, 4_000_000), (0.3, 7), (2.0, 1)])
def test_like_contents_by_matrix_and_index(monkeypatch, often, spots):
    """Terms as a matrix, by the index or both, few at a time: the pairs of plain sums, counts above 2 ** 24 included."""
    import numpy as np
    import pandas as pd

    from tristage.operators import relations

    monkeypatch.setattr(relations, "OFTEN", often)
    monkeypatch.setattr(relations, "SPOTS", spots)
    r = np.random.default_rng(5)
    counts = r.integers(0, 3, (30, 12)) * r.integers(0, 2, (30, 12)) * np.where(np.arange(30) < 15, 1, 9001)[:, None]
    counts[:, 0] += 1
    df = pd.DataFrame({"volume": np.arange(30), "pages": r.integers(5, 11, 30).astype(float), "norm": np.sqrt((counts**2).sum(1)), "ids": [np.flatnonzero(c) for c in counts], "ns": [c[c > 0] for c in counts]})
    value = (counts @ counts.T) / np.outer(df["norm"], df["norm"])
    want = {(i, j, round(value[i, j], 6)) for i in range(30) for j in range(30) if value[i, j] >= 0.6 and abs(df["pages"][i] - df["pages"][j]) <= 3}
    both = lambda a, b, one: {tuple(x) for out in relations.like(a, b, 0.6, one) for x in out.itertuples(index=False)}
    assert both(df, df, True) == {x for x in want if x[0] < x[1]}
    assert both(df[:11], df[11:], False) == {x for x in want if x[0] < 11 <= x[1]}


def test_sheets_meet_in_blocks(spark, tmp_path, monkeypatch):
    """Classes in blocks of nine give what all pairs give, ties and copies of sheets included."""
    from tristage.operators import sheets

    monkeypatch.setattr(sheets, "BLOCK", 9)
    got, want = both(spark, tmp_path, "sheet_pairs", orders=f"SELECT o_orderkey, o_orderkey // 400 AS o_custkey FROM '{DATA}/orders.parquet'", lineitem=f"SELECT l_orderkey, l_partkey % 5 AS l_partkey FROM '{DATA}/lineitem.parquet'")
    assert got == want and len(got) > 1000


def test_working_sheets_meet_sets_of_rooms(spark, tmp_path, monkeypatch):
    """Both sides in several blocks and tables of few cells give what all pairs give; sheets that differ in name alone
    meet their rooms once."""
    import numpy as np
    import pandas as pd

    from tristage.operators import sheets

    for name, value in (("BLOCK", 7), ("LARGE", 11), ("CELLS", 40)):
        monkeypatch.setattr(sheets, name, value)
    got, want = both(spark, tmp_path, "sheet_pairs", orders=f"SELECT o_orderkey, o_orderkey // 400 AS o_custkey FROM '{DATA}/orders.parquet'", lineitem=f"SELECT l_orderkey, l_partkey % 7 AS l_partkey FROM '{DATA}/lineitem.parquet'")
    assert got == want and len(got) > 1000
    rows = []
    monkeypatch.setattr(sheets, "CELLS", 2_000_000)
    real = np.sort
    monkeypatch.setattr(sheets.np, "sort", lambda x, **k: rows.append(len(x)) or real(x, **k))
    side = lambda n: pd.DataFrame([{"key": i, "sheets": [i], "section": "AR", "words": ["w", f"v{i}"], "numbers": ["1"], "tags": [], "held": [1, 2, 3 + i % 2], "n_rooms": 3, "unnamed": False} for i in range(n)])
    assert sum(map(len, sheets.best(side(50), side(40)))) == 50 * 12 and sum(rows) == 2


def test_halves_are_rounded_as_in_sql():
    import numpy as np

    from tristage.operators import sheets

    assert sheets._half_up(np.array([0.0125, -0.0125, 1.0005, 2 / 3, 0.1 + 0.25, -0.1])).tolist() == [13, -13, 1001, 667, 350, -100]


def test_signs_of_editions_are_reckoned_once(spark):
    """What two editions are compared by stands in columns of its own, not again wherever it counts."""
    plan = e.queries()["edition_order"](spark, DATA)._jdf.queryExecution().optimizedPlan().treeString()
    assert max(map(len, plan.splitlines())) < 4000


def test_pages_are_placed_without_broadcasts(spark):
    """Tables between steps are small as files only: no join of the rounds sends one through the driver."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = lambda: [x for x in map(store.executionsList().apply, range(store.executionsList().size()))]
    last = max((x.executionId() for x in runs()), default=-1)
    assert e.queries()["placed_pages"](spark, DATA).count() > 0
    plans = [x.physicalPlanDescription() for x in runs() if x.executionId() > last]
    assert len(plans) > 10 and not [x for x in plans if "BroadcastExchange" in x]


def test_pages_of_many_volumes_are_aligned_side_by_side(spark):
    """Small rows that take work go to all tasks; words are shuffled, not broadcast; workers need not find the package."""
    import pickle

    from pyspark import cloudpickle

    from tristage.operators import alignment

    out = e.queries()["aligned_pages"](spark, DATA)
    assert out.rdd.getNumPartitions() >= 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "FlatMapGroups" not in plan
    assert pickle.loads(cloudpickle.dumps(alignment.chain)) is not alignment.chain


def test_chains_as_heavy_are_told_apart_by_order(spark):
    """Volumes with ties, in whatever order their pairs come, and one with more than one chain."""
    from tristage.operators import alignment

    rows = [(v, i, j, 0.5) for v in range(50) for i in range(3) for j in range(3)] + [(99, 0, 1, 0.9), (99, 1, 0, 0.5), (99, 2, 2, 0.4)]
    make = lambda x: spark.createDataFrame(x, "v int, i int, j int, similarity double")
    got = [sorted(map(tuple, alignment.align(make(x), ["v"]).collect())) for x in (rows, rows[::-1])]
    assert got[0] == got[1] == [(v, i, i) for v in range(50) for i in range(3)] + [(99, 0, 1), (99, 2, 2)]


def test_all_copies_of_names_are_paired(spark, tmp_path, monkeypatch):
    """Every pair of copies counts, also over lists of three, with rows that repeat a key and rows without name or brand."""
    from tristage.operators import joins

    monkeypatch.setattr(joins, "LIST", 3)
    name = "CASE i % 5 WHEN 0 THEN 'red oak' WHEN 1 THEN 'oak red red' WHEN 2 THEN 'red pine' WHEN 3 THEN '' END"
    part = f"SELECT i // 2 * 2 - i % 3 AS p_partkey, {name} AS p_name, CASE WHEN i < 35 THEN 'b' END AS p_brand, 'SMALL' AS p_type, 1 AS p_size FROM range(40) t(i)"
    got, want = both(spark, tmp_path, "name_similarity", part=part)
    assert got == want and sum(r[2] == 1 for r in got) > 60


def test_zones_need_one_shuffle(spark):
    """All rounds of a page are in one task: nothing is written or moved between them."""
    out = e.queries()["word_zones"](spark, DATA)
    assert "FileScan" in (plan := out._jdf.queryExecution().executedPlan().toString()) and plan.count("FileScan") == 1
    assert exchanges(out) == 1 and "steps-" not in plan


@pytest.mark.parametrize(("near", "pairs"), [(1, 1), (2, 10), (64, 2_000_000)])
def test_frames_of_pages_taken_together(monkeypatch, near, pairs):
    """However few boxes are tested at a time, the frames of several pages are those of each page alone."""
    import numpy as np

    from tests.test_layout import naive_zones
    from tristage.operators import pagewise

    monkeypatch.setattr(pagewise, "NEAR", near)
    monkeypatch.setattr(pagewise, "PAIRS", pairs)
    r = np.random.default_rng(2)
    page = np.sort(r.integers(0, 9, 150))
    corner = r.integers(0, 300, (2, 150)).astype(float)
    boxes = np.concatenate([corner, corner + r.integers(2, 40, (2, 150))])
    at, found, n = pagewise.frames(page, boxes, 3.0)
    for p in range(9):
        assert sorted(map(tuple, found[:, at == p].T)) == naive_zones(boxes[:, page == p].T.tolist(), 3.0)
    assert n.sum() == 150


def test_pages_longer_than_a_batch(spark, monkeypatch):
    """Pages are whole to their function, also those that end or begin between two batches."""
    import pandas as pd

    from tristage.operators import pagewise

    monkeypatch.setattr(pagewise, "ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(200).selectExpr("CASE WHEN id < 60 THEN 'long' ELSE concat('p', id % 40) END AS p", "id")
        count = lambda rows, page: pd.DataFrame({"p": rows["p"], "n": pd.Series(page).groupby(page).transform("size").to_numpy(), "id": rows["id"]})
        got = pagewise.by_page(df, ["p"], count, "p string, n long, id long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 200 and all(r.n == (60 if r.p == "long" else 4 if int(r.p[1:]) >= 20 else 3) for r in got)


def test_marks_meet_those_near_them(spark, tmp_path):
    """Dense marks, some far from all others, and copies: few marks meet, all find the nearest that the SQL finds."""
    from tristage.operators import spatial

    part = """SELECT i AS p_partkey, 'x' AS p_name, CASE WHEN i % 50 = 0 THEN 'far' ELSE 'b' END AS p_brand, 'SMALL' AS p_type, CAST(i * 37 % 50 + 1 AS INTEGER) AS p_size,
     CASE WHEN i % 50 = 0 THEN 900.0 + i // 50 * 6 WHEN i % 40 < 2 THEN 950.0 ELSE 900.0 + i * 7919 % 4001 / 10 END AS p_retailprice FROM range(6000) t(i)"""
    got, want = both(spark, tmp_path, "nearest_mark", part=part)
    assert got == want and len(got) > 5900
    store = spark._jsparkSession.sharedState().statusStore()
    df = spark.read.parquet(f"{tmp_path}/part.parquet")
    before = store.executionsCount()
    spatial.nearest(df, df, ["p_brand"], "p_partkey", "p_size", "p_retailprice", 20.0).count()
    rows = []
    for x in map(store.executionsList().apply, range(before, store.executionsCount())):
        graph, values = store.planGraph(x.executionId()), store.executionMetrics(x.executionId())
        nodes = graph.allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if node.name() == "SortMergeJoin":
                rows += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in map(node.metrics().apply, range(node.metrics().size())) if m.name() == "number of output rows"]
    assert rows and max(rows) < 300_000


def test_pages_are_placed_in_few_steps(spark):
    """No step for each round, and of the tables between steps those that nothing reads any more are gone."""
    import os

    from tristage.sources import shared

    store, made, real = spark._jsparkSession.sharedState().statusStore(), [], shared.folder
    shared.folder = lambda s: made.append(real(s)) or made[-1]
    before = store.executionsCount()
    try:
        assert e.queries()["placed_pages"](spark, DATA).count() > 0
    finally:
        shared.folder = real
    assert store.executionsCount() - before < 16
    assert sum(not os.path.exists(p.removeprefix("file://")) for p in made) == 4


def test_shuffles_of_written_tables_are_removed(spark):
    import time

    from tristage.sources.shared import cut

    disk = spark._jsc.sc().env().blockManager().diskBlockManager()

    def names():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = names()
    table = cut(spark.range(1000).groupBy("id").count())
    for _ in range(50):
        if not names() - before:
            break
        time.sleep(0.2)
    assert not names() - before and len(table.collect()) == 1000


@pytest.mark.parametrize("first", [True, False])
def test_peaks_of_a_page_are_those_of_all_pages(spark, first):
    """What the task of a page finds is what the joins over all pages find."""
    from tristage.operators import layout, pagewise
    from tristage.plans import catalogue_places as P

    w, new = P._words(spark, DATA)
    want = {(r.f, r.page): (r.dx, r.dy, *((r.rx0, r.ry0, r.rx1, r.ry1) if not first else ())) for r in layout.peaks(w, new, P.BY, first).collect()}
    pages = {}
    for side, df, key in ((0, w, "word"), (1, new, "other")):
        for r in df.collect():
            pages.setdefault((r.f, r.page), ([], []))[side].append((r[key], r.t, r.x, r.y, False, 150.0))
    got = {}
    for p, (a, b) in pages.items():
        top = pagewise.peak(a, b, layout.POS_TOL, layout.RARE, layout.FIRST_VOTES if first else layout.MIN_VOTES, None if first else layout.REGION, layout.LOCAL_SUPPORT)
        if top:
            got[p] = (top[0], top[1], *(top[2] or ()))
    assert got == want and len(got) > 10


def test_crowded_texts_of_a_page_meet_by_place():
    """More words of one text than are looked through one by one: taken in order, each the nearest that is left."""
    import random

    from tristage.operators import pagewise

    r = random.Random(4)
    make = lambda n: [(i, "-", r.randint(0, 60) / 2, r.randint(0, 60) / 2, False, 9.0) for i in range(n)]
    old, new = make(80), make(70)
    far = lambda o, n: max(abs(o[2] + 1 - n[2]), abs(o[3] - n[3]))

    def taken(pairs):
        left, right, out = set(), set(), set()
        for w, n in pairs:
            if w not in left and n not in right:
                left.add(w), right.add(n), out.add((w, n))
        return out

    near = [(o[0], far(o, n), n[0]) for o in old for n in new]
    assert set(pagewise.matched(old, new, 4.0, 1.0, 0.0)) == taken((w, n) for w, d, n in sorted(near, key=lambda x: (x[0], x[1], -x[2])) if d <= 4)
    assert set(pagewise.moved(old, new, 1.0, 0.0)) == taken((w, n) for d, w, n in sorted((d, w, n) for w, d, n in near) if d <= 9)

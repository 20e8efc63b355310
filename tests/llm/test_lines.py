"""Line dedup: what moves between its steps, and crowds in parts."""

import random

from test_llm import edited, line_report, prose

from tristage.llm import lines


def test_prefixes_move_once(spark, monkeypatch):
    """Prefixes go to classes and tokens only, full sets come without a shuffle; crowds in parts of few rows and
    versions of a document give all links."""
    plans, save = {}, lines.save

    def noted(df, name="t"):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    monkeypatch.setattr(lines, "save", noted)
    monkeypatch.setattr(lines, "SPLIT", 30)
    r = random.Random(5)
    base = [prose(60, k).replace("\n", " ") for k in range(3)]
    texts = [(i, "\n".join(edited(r.choice(base), 1, i * 5 + k) for k in range(2))) for i in range(50)]
    df = spark.createDataFrame([*texts, (7, texts[7][1]), (3, "\n\na\nb")], "doc_id long, text string")
    got = {(x.doc_id, x.pos): (x.n_links, tuple(x.earliest)) for x in lines.matches(df).collect()}
    want = line_report([*texts, (7, texts[7][1]), (3, "\n\na\nb")])
    assert got.items() <= want.items() and sum(n for n, _ in want.values()) == sum(n for n, _ in got.values()) > 0
    assert "sketches" in plans and not [k for k in set(plans) - {"lines", "classes", "met"} if "prefix" in "".join(plans[k])]
    assert "Exchange hashpartitioning" not in plans["sets"][0]

"""Mixing, vector codes and clustering against plain versions, and secrets in adversarial texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tristage.llm import clusters, mixing, secrets, vectorcodes, vectors

WS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def shares(sizes, weights, percent, most):
    """Targets by sharing again and again what sources can't take."""
    left, open_, out = Fraction(percent, 100) * sum(sizes.values()), {s for s in sizes if weights.get(s)}, {s: Fraction(0) for s in sizes}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not over:
            for s in open_:
                out[s] = left * weights[s] / total
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def mixed(docs, seed, percent=150, most=2, cycle=(5, 2, 1)):
    sizes = Counter()
    for _, source, text in docs:
        sizes[source] += len(WS.findall(text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    goals = shares(sizes, {s: cycle[i % len(cycle)] for i, s in enumerate(names)}, percent, most)
    by = defaultdict(list)
    for d, source, text in docs:
        key = hashlib.md5(f"{seed}:{'' if d is None else d}:{text or ''}".encode()).hexdigest()
        by[source].append((key, d, len(WS.findall(text or ""))))
    out = []
    for source, members in by.items():
        n, goal = sizes[source], goals[source]
        epochs, rest = divmod(int(goal), n) if n else (0, 0)
        for _, d, k in sorted(members, key=lambda m: m[0]):
            part = min(k, max(0, rest))
            rest -= k
            out.append((d, k, n, round(float(goal), 6), epochs * k + part))
    return sorted(out, key=str), goals


def mix(docs, cycle=(5, 2, 1), percent=150, epochs=2):
    documents = mixing.sized(docs)
    sizes = mixing.sources(documents)
    return mixing.mix(documents, mixing.targets(sizes, mixing.cycled(sizes, cycle), percent, epochs))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    made = [(i, r.choice(["web", "web", "web", "Книги", "code", "a", "é", None, ""]), " ".join("w" * r.randint(1, 4) for _ in range(r.choice([0, 1, 5, 40])))) for i in range(400)]
    made += [(900, "web", " x\t y\r\n z" * 3000), (901, None, None), (901, None, None), (902, "void", None), (903, "void", " \n"), (None, "a", "one two"), (904, "tiny", "word")]
    return made


def test_mixing(spark, docs):
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, source string, text string, target int, epochs int").repartition(5)
    out = mix(df)
    want, goals = mixed(docs, "11")
    assert rows(out.select("doc_id", "size", "source_size", F.round("target", 6), "taken")) == want
    taken = {r.source: r.n for r in out.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert all(n == int(goals[s]) for s, n in taken.items())
    assert out.where("taken > 2 * size").count() == 0
    assert rows(out.select("doc_id", "taken")) == rows(mix(df.repartition(2)).select("doc_id", "taken"))
    assert mix(df.where("false")).collect() == []


@pytest.mark.parametrize(("percent", "epochs", "cycle"), [(30, 1, (3,)), (90, 3, (1, 9, 4)), (500, 2, (5, 2, 1))])
def test_mixing_of_other_shares(spark, docs, percent, epochs, cycle):
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    want, _ = mixed(docs, "11", percent, epochs, cycle)
    assert rows(mix(df, cycle, percent, epochs).select("doc_id", "size", "source_size", F.round("target", 6), "taken")) == want


def test_mixture_as_texts(spark, docs):
    df = spark.createDataFrame([d for d in docs if d[0] not in (901, None)], "doc_id long, source string, text string")
    out = mix(df)
    times = defaultdict(list)
    for r in mixing.expand(out, df.withColumn("n_words", F.lit(1))).collect():
        assert len(WS.findall(r.text)) == r.n_words
        times[r.doc_id].append((r.epoch, r.n_words))
    for r in out.collect():
        assert sum(n for _, n in times[r.doc_id]) == r.taken and sorted(e for e, _ in times[r.doc_id]) == list(range(len(times[r.doc_id])))


def floor(x, factor):
    return int(Fraction(x) * factor // 1)


def lloyd(points, centroids, rounds):
    """Assignments after the last round, and the centroids."""
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        by = defaultdict(list)
        for p in points:
            by[near(p)[1]].append(p)
        centroids = [tuple(sum(x) // len(by[i]) for x in zip(*by[i], strict=True)) if i in by else c for i, c in enumerate(centroids)]
    return [near(p) for p in points], centroids


def vectors_of(n, dim, seed, scale=1.0):
    g = np.random.default_rng(seed)
    return (g.normal(size=(n, dim)) * scale).astype(np.float32).astype(float).tolist()


ODD = [(90_001, None, 1), (90_002, [float("nan")] * 64, 1), (90_003, [0.5] * 63 + [None], 2), (90_004, [float("inf")] + [0.1] * 63, None)]
KIND = "vec_id long, embedding array<float>, label int, cluster string"


@pytest.mark.parametrize("scale", [1.0, 1e7, 1e15, 1e30])
def test_clusters(spark, scale):
    """From 1e7 on doubles are too small for the products, from 1e15 on 64-bit integers."""
    made = vectors_of(120, 64, 3, scale)
    kept = list(enumerate(made)) + [(5, made[5]), (5, made[6]), (None, made[7]), (7, made[0])]
    data = [(i, v, 1, "x") for i, v in kept] + [(i, v, lab, "x") for i, v, lab in ODD] + [(90_005, [1.0] * 63, 1, "x"), (90_006, [], 1, "x")]
    points = [tuple(floor(x, 64) for x in v) for _, v in kept]
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"1:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    at, centroids = lloyd(points, [points[j] for j in order[:16]], 3)
    sums, total = Counter(), sum(d for d, _ in at)
    for d, c in at:
        sums[c] += d
    long = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = sorted(((i, c, long(d), long(sums[c]), long(total), digest[c]) for (i, _), (d, c) in zip(kept, at, strict=True)), key=str)
    assert rows(clusters.cluster(spark.createDataFrame(data, KIND).repartition(4))) == want


def test_few_clusters(spark):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors_of(3, 64, 1))] + [(9, None, 1, "x")], KIND)
    assert sorted(r.cluster for r in clusters.cluster(df).collect()) == [0, 1, 2]
    assert clusters.cluster(df.where("false")).collect() == [] == clusters.cluster(df.where("vec_id = 9")).collect()


@pytest.mark.parametrize(("scale", "dim"), [(0.2, 64), (0.02, 32), (1e12, 64), (1e30, 16)])
def test_codes(spark, scale, dim):
    """Small scales have many equal distances and entries."""
    made = vectors_of(200, dim, 8, scale)
    kept = [(i, v, [None, 1, 2][i % 3]) for i, v in enumerate(made)] + [(5, made[5], 1), (5, made[9], None)]
    odd = [(i - 100_000, v, lab) for i, v, lab in ODD if v is None or len(v) != dim or not all(x is not None and abs(x) < 9e99 for x in v)] + [(77, [0.5] * (dim + 16), 3)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in [*kept, *odd]], KIND).repartition(4)
    points, width = [tuple(floor(x, 256) for x in v) for _, v, _ in kept], dim // 16
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0], kept[j][1]))[:64]
    books, codes, errors = [], [[] for _ in kept], [0] * len(kept)
    for p in range(16):
        cut = [x[p * width : (p + 1) * width] for x in points]
        at, book = lloyd(cut, [cut[j] for j in first], 2)
        books += book
        for j, (d, c) in enumerate(at):
            codes[j].append(f"{c:02x}")
            errors[j] += d
    by = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] += e
    digest = hashlib.sha256(",".join(str(x) for c in books for x in c).encode()).hexdigest()
    long = lambda v: v if v < 1 << 63 else None
    got = rows(vectorcodes.report(*vectorcodes.compress(df)))
    sums = (lambda lab: long(by[lab])) if max(errors) < 1 << 63 else (lambda lab: None)  # sums leave out what no long holds
    want = sorted(((i, "".join(c), long(e), sums(lab), digest) for (i, _, lab), c, e in zip(kept, codes, errors, strict=True)), key=str)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert max(errors) >= 1 << 62 or [r[3] for r in got] == [r[3] for r in want]


def test_few_codes(spark, monkeypatch):
    df = spark.createDataFrame([(i, v, i, "x") for i, v in enumerate(vectors_of(5, 64, 1))], KIND)
    want = rows(vectorcodes.report(*vectorcodes.compress(df)))
    assert [r[1] for r in want] == [f"{i:02x}" * 16 for i in range(5)] and all(r[2] == 0 for r in want)
    monkeypatch.setattr(vectorcodes, "SMALL", 2)  # labels are dealt instead of broadcast
    assert rows(vectorcodes.report(*vectorcodes.compress(df))) == want
    assert vectorcodes.report(*vectorcodes.compress(df.where("false"))).collect() == []


def test_search_reads_less_and_finds_all():
    """The radius leaves entries out and none that is nearest; ties go to the lower index."""
    g = np.random.default_rng(4)
    entries, x = g.integers(-40, 40, (3 * 64, 4)), g.integers(-40, 40, (3 * 500, 4))
    entries[5] = entries[3]
    book = vectorcodes.Book(entries, 3)
    whole = ((x.reshape(-1, 3, 1, 4) - entries.reshape(1, 3, 64, 4)) ** 2).sum(axis=3)
    want = whole.argmin(axis=2)
    at, d = book.search(x)
    again, same = book.search(x, at)
    assert (at % 64 == want.ravel()).all() and (d == whole.min(axis=2).ravel()).all() and (again == at).all() and (same == d).all()
    assert (book.spans[at] <= 4 * d[:, None]).sum(axis=1).mean() < 32
    assert (book.search(x, g.integers(0, 64, 1500) + np.tile([0, 64, 128], 500))[0] == at).all()


def test_packed_integers():
    for m in (np.array([[1, -128]]), np.array([[300, -5]]), np.array([[1 << 40, 0]]), np.array([[1 << 70, -3]], object), np.zeros((0, 2), np.int64)):
        assert vectors.unpack(vectors.pack(m), 2).tolist() == m.tolist() or not m.size


@pytest.mark.parametrize("text", ["-----BEGIN " + "A " * 500_000 + "x", "eyJ" * 340_000, "eyJ" + "a" * 1_000_000 + ".eyJ", "token " * 170_000, "password" + " " * 1_000_000, "AKIA" * 250_000, "deadbeef " * 100_000, "xoxb-" * 200_000, "ghp_" * 250_000, "-----BEGIN RSA PRIVATE KEY-----" * 3])
def test_long_texts_end_no_job(spark, text):
    df = spark.createDataFrame([(1, text), (2, "secret=0123456789abcdefgh")], "path long, text string")
    got = {r.path: r.spans for r in secrets.findings(df, secrets.ledger_of(df)).collect()}
    assert len(got[2]) == 2 and (len(got[1]) == 3) == ("RSA" in text)

"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct runs of five words (the whole line if it has fewer), as 64-bit hashes and in their
order: runs of five words are rare enough that an order by rarity, which takes a pass over the corpus, gives few fewer
candidates; the links are the same in any order. Two lines with enough in common share one of their first tokens
(prefix filter), so lines meet by single tokens of their prefixes; the length filter bounds the sizes, the positional
filter what can still follow after the shared place. What passes is verified by Jaccard on the full sets. A line that
matches an earlier one, by doc_id and place, is removed.

Equal lines are one class: copies are counted before anything else moves, and only classes are joined. All links
between different lines are found. Where many lines share a token, as variants of one line do, sketches of the sets
decide within the join, so little but links comes out of it; what is compared there, in a few machine words, still
grows with the square of such a group of different lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, save, small, tracked

WORDS, PERCENT = 5, 80
#: Lines that share a token: above this their pairs are decided before they are put out; in parts of so many rows.
CROWD, SPLIT = 16, 512
#: Longs of a sketch, a power of two.
SKETCH = 8
_OTHER = "\t\r\x0b\x0c"


def _text() -> Column:
    """text with its white space as spaces, line feeds but kept."""
    other = F.lit(False)
    for c in _OTHER:
        other = other | F.col("text").contains(c)
    return F.when(other, F.translate("text", _OTHER, " " * len(_OTHER))).otherwise(F.col("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line for lines of documents that have an id."""
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split(_text(), "\n")).alias("pos", "line"))


def _runs(words: Column, size: int) -> Column:
    """A hash of each run of `size` elements; of all elements if there are fewer."""
    at = lambda x: lambda y, i: F.xxhash64(y, *(F.get(x, i + k) for k in range(1, size)))
    whole = lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - (size - 1)), at(x))
    short = lambda x: F.transform(F.slice(x, 1, 1), lambda y: F.xxhash64(x))
    runs = lambda x: F.when(F.size(x) < size, short(x)).otherwise(whole(x))
    return F.get(F.transform(F.array(words), runs), 0)  # a one-element array binds words to a name


def tokens(line: Column, size: int) -> Column:
    """Distinct tokens in order: 64-bit hashes of the runs."""
    words = F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(_runs(words, size)))


def _up(n: Column, by: int, over: int) -> Column:
    """n * by / over, rounded up, in whole numbers."""
    return F.floor((n.cast("long") * by + (over - 1)) / over).cast("int")


def _met(percent: int) -> Column:
    """Whether the rows a and b (token, id, n tokens in all, i the token's place) of one token pass the length and
    positional filters, x before y. Products instead of quotients, as pairs are many and this is all that is done for
    most of them; sets of sizes n and m must share percent * (n + m) / (100 + percent) tokens."""
    n, m = F.col("a.n").cast("long"), F.col("b.n").cast("long")
    left, right = (n - F.col("a.i")) * (100 + percent), (m - F.col("b.i")) * (100 + percent)
    place = F.least(left, right) >= percent * (n + m)
    # of two lines the smaller one needs only the shorter prefix, which its own size gives
    short = F.when(n <= m, left >= 2 * percent * n).otherwise(right >= 2 * percent * m)
    close = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & close & place & short


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x < y) that share a token within their prefixes and pass the filters."""
    return rows.alias("a").join(rows.alias("b"), _met(percent)).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()


def sketches(sets: DataFrame) -> DataFrame:
    """id, m (size of its set) and a sketch of 64 * SKETCH bits in longs b0 and on: each element flips one bit."""
    rows = sets.select("id", F.explode("set").alias("t"))
    word = F.shiftrightunsigned("t", 6).bitwiseAND(F.lit(SKETCH - 1))
    bit = F.expr("shiftleft(1L, cast(t & 63 AS int))")
    return rows.groupBy("id").agg(F.count("*").alias("m"), *(F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(SKETCH)))


def crowded(rows: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of tokens that many lines share: variants of one line, most of them apart.

    An element that only one of two sets holds flips at most one bit between their sketches, so sketches too far apart
    tell within the join that a pair is none; a pair is put out only at the first of these tokens that both have.
    The rows of a token are dealt to parts of SPLIT rows on one side, so no token's pairs fall to one task. rows: token, id, n, i, c (lines of the token); known: id, m, sketch.
    """
    own = rows.groupBy("id").agg(F.collect_list("token").alias("own"))
    rows = rows.join(known.join(own, "id"), "id")
    total = F.col("a.m") + F.col("b.m")
    apart = sum((F.bit_count(F.col(f"a.b{k}").bitwiseXOR(F.col(f"b.b{k}"))) for k in range(SKETCH)), F.lit(0))
    near = (total - apart) * (100 + percent) >= 2 * percent * total
    first = F.array_min(F.array_intersect("a.own", "b.own")) == F.col("a.token")
    rows = rows.withColumn("parts", (F.col("c") / SPLIT).cast("int") + 1)
    a = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("a")
    b = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    met = a.join(b, (F.col("a.part") == F.col("b.part")) & _met(percent) & near & first)
    return met.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, crowd and set of the classes ids (id, crowd, doc_id, pos, h1, h2); a written table."""
    lines = _lines(docs).withColumn("h1", F.xxhash64("line"))
    known = small(ids.select("id", "crowd", "doc_id", "pos", "h1"), 500_000)
    sets = save(lines.join(known, ["doc_id", "pos", "h1"]).select("id", "crowd", tokens(F.col("line"), size).alias("set")), "sets")
    # versions of a document may have a line at the same place
    return sets if sets.count() == ids.count() else save(sets.dropDuplicates(["id"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets (id, set) are similar."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"s{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("c", F.size(F.array_intersect("sx", "sy")))
    return save(both.where(100 * F.col("c") >= percent * (F.size("sx") + F.size("sy") - F.col("c"))).select("x", "y"), "links")


def matches(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, pos (from 0), n_links and earliest of each line with a copy or a link; a written table.

    n_links: how many different lines are similar to it. earliest: doc_id and pos of the first line that is equal or
    similar to it, which may be itself.
    """
    with tracked() as paths:
        out = save(_matches(docs, size, percent), "matches")
    for path in paths[:-1]:  # what the join has left on the way
        drop(docs.sparkSession, path)
    return out


def _matches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    found = _lines(docs).select("doc_id", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), tokens(F.col("line"), size).alias("set"))
    n = F.size("set")
    prefix = F.slice("set", F.lit(1), n - _up(n, percent, 100) + 1).alias("prefix")
    with tracked() as wide:
        found = save(found.select("doc_id", "pos", "h1", "h2", n.alias("n"), prefix), "lines").where("n > 0")
    classes = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = save(classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "f.*", "copies", "n", "prefix"), "classes")
    found = save(found.select("doc_id", "pos", "h1", "h2"), "places")
    drop(docs.sparkSession, wide[0])  # prefixes are with the classes
    rows = classes.select("id", "n", F.posexplode("prefix").alias("i", "token"))
    met = save(rows.withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("c > 1"), "met")
    pairs = save(candidates(met.where(F.col("c") <= CROWD), percent), "pairs")
    crowd = met.where(F.col("c") > CROWD)
    # only the lines in question are read again, once, into full sets; their hashes and places go with their ids
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id"), F.lit(False).alias("crowd")).unionByName(crowd.select("id", F.lit(True).alias("crowd")))
    ids = save(classes.select("id", "doc_id", "pos", "h1", "h2").join(ids.groupBy("id").agg(F.max("crowd").alias("crowd")), "id"), "ids")
    sets = _sets(docs, ids, size)
    if not crowd.isEmpty():
        known = save(sketches(sets.where("crowd")), "sketches")
        pairs = save(pairs.unionByName(crowded(crowd, known, percent)).distinct(), "pairs")
    links = verified(pairs, sets, percent)
    both = links.unionByName(links.select(F.col("x").alias("y"), F.col("y").alias("x")))
    place = F.struct("doc_id", "pos")
    linked = both.join(ids.select(F.col("id").alias("y"), place.alias("place")), "y").groupBy(F.col("x").alias("id")).agg(F.count("*").alias("n_links"), F.min("place").alias("other"))
    linked = linked.join(ids, "id").select("h1", "h2", "n_links", F.least(place, "other").alias("earliest"))
    copied = classes.where("copies > 1").select("h1", "h2", F.lit(0).cast("long").alias("n_links"), place.alias("earliest"))
    heads = linked.unionByName(copied).groupBy("h1", "h2").agg(F.max("n_links").alias("n_links"), F.min("earliest").alias("earliest"))
    return found.join(save(heads, "heads"), ["h1", "h2"]).select("doc_id", "pos", "n_links", "earliest")


def removed(matched: DataFrame) -> DataFrame:
    """doc_id, pos and earliest of the lines that match an earlier one."""
    return matched.where(F.struct("doc_id", "pos") > F.col("earliest")).select("doc_id", "pos", "earliest")


def report(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs, without moving texts: doc_id, n_lines, n_removed, removed (places), matched (for
    each removed line the doc_id of the first line that it matches) and n_links (how many links to different lines
    the document's lines have). Nulls, repeats and empty tables as for dedup."""
    gone = F.when(F.struct("doc_id", "pos") > F.col("earliest"), F.struct("pos", F.col("earliest.doc_id").alias("doc")))
    found = matches(docs, size, percent).groupBy("doc_id").agg(F.array_sort(F.collect_set(gone)).alias("g"), F.sum("n_links").alias("n_links"))
    kind = dict(docs.dtypes)["doc_id"]
    found = save(found.select("doc_id", F.col("g.pos").alias("removed"), F.col("g.doc").alias("matched"), "n_links"), "gone")
    lines = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    return lines.join(found, "doc_id", "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), none("removed", "int"), none("matched", kind), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def dedup(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with text without the removed lines, and n_removed.

    Nulls: a null text stays null; lines of rows without doc_id stay and remove nothing. Rows that repeat a doc_id are
    versions of one document: of equal lines at the same place in them none removes another. Lines without a word stay.
    Texts of any length are taken whole. An empty table gives an empty result. A column of docs named n_removed is
    replaced; all others pass, whatever their names.
    """
    gone = save(removed(matches(docs, size, percent)).groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set("pos")).alias("_gone")), "gone")
    # only doc_id and text take part; the others travel under names of ours. The same join at every size: places grow with the documents
    others = [c for c in docs.columns if c not in ("n_removed", "text")]
    rows = docs.select(*(docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(others)), F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    out = rows.join(gone.hint("merge"), F.col("_doc") == F.col("_id"), "left")
    parts = F.split("_text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone")), lambda i: F.get(parts, i))
    text = F.when(F.col("_gone").isNull() | F.col("_text").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(others)), text.alias("text"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))

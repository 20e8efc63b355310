"""Chains of editions: families of documents, guarded merging of families, places in a chain (rows 203 and chains).

Families are merged one pair after another, and a merge is allowed only if all marks of both sides agree, so later pairs
depend on earlier ones. A pair that is the next one for both its sides can be decided at once: no earlier pair touches
them. All such pairs of all objects are decided in one round, so the result is that of going through them one by one.
What two sides disagree on they never lose, so pairs that disagree go at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tristage.operators import relations, revisions
from tristage.sources.shared import cut

#: The number of a volume agrees with any mark; a title that stands for a missing mark begins so.
TOME, TITLE = "ТОМ", "~"


def letters(mark: Column) -> Column:
    return F.regexp_replace(mark, "[^А-ЯЁA-Z]", "")


def compatible(a: Column, b: Column) -> Column:
    """Whether two marks may name one document: the same, one without a number, or the number of a volume."""
    none = lambda m: F.coalesce(m, F.lit("")) == ""
    number = lambda m: m.rlike("[0-9]")
    return none(a) | none(b) | (a == b) | a.startswith(TOME) | b.startswith(TOME) | ((letters(a) == letters(b)) & ~(number(a) & number(b)))


def agree(a: Column, b: Column) -> Column:
    """Whether two families may merge: all their marks agree, and their parts are the same if both have any."""
    marks = F.forall(a.marks, lambda x: F.forall(b.marks, lambda y: compatible(x, y)))
    return marks & ((F.size(a.parts) == 0) | (F.size(b.parts) == 0) | (F.array_sort(a.parts) == F.array_sort(b.parts)))


def guarded_merge(families: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """by, family, root: what merging pair by pair in ascending order of (a, b) gives, each if agree() allows it.

    families: by, family (a number within by), marks, parts (arrays of strings); edges: by, a, b. Repeated edges, loops
    and edges of unknown families change nothing. Rounds are as many as the longest run of pairs that wait for each other.
    """
    roots = cut(families.select(*by, "family", F.col("family").alias("root")))
    groups = cut(families.select(*by, F.col("family").alias("root"), F.struct(F.array_distinct("marks").alias("marks"), F.array_distinct("parts").alias("parts")).alias("held")))
    pending = edges.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    while True:
        of = lambda side: roots.select(*by, F.col("family").alias(side), F.col("root").alias(f"r{side}"))
        held = lambda r: groups.select(*by, F.col("root").alias(r), F.col("held").alias(f"h{r}"))
        open_ = pending.join(of("a"), [*by, "a"]).join(of("b"), [*by, "b"]).where("ra <> rb").join(held("ra"), [*by, "ra"]).join(held("rb"), [*by, "rb"])
        # marks only gather and parts never change once there: who disagrees now will never agree
        open_ = cut(open_.where(agree(F.col("hra"), F.col("hrb"))).select(*by, "a", "b", "ra", "rb", "hra", "hrb"))
        if not open_.take(1):
            return roots
        next_ = open_.select(*by, F.explode(F.array("ra", "rb")).alias("root"), F.struct("a", "b").alias("_e")).groupBy(*by, "root").agg(F.min("_e").alias("_next"))
        best = lambda r: next_.select(*by, F.col("root").alias(r), F.col("_next").alias(f"_{r}"))
        ready = open_.join(best("ra"), [*by, "ra"]).join(best("rb"), [*by, "rb"]).where((F.col("_ra") == F.struct("a", "b")) & (F.col("_rb") == F.struct("a", "b")))
        joins = cut(ready.select(open_.columns))
        pending = open_.select(*by, "a", "b")
        moved = joins.select(*by, F.col("rb").alias("root"), F.col("ra").alias("_to"))
        roots = cut(roots.join(moved, [*by, "root"], "left").select(*by, "family", F.coalesce("_to", "root").alias("root")))
        both = lambda c: F.array_union(f"hra.{c}", f"hrb.{c}").alias(c)
        grown = joins.select(*by, F.col("ra").alias("root"), F.struct(both("marks"), both("parts")).alias("held"))
        touched = grown.select(*by, "root").union(moved.select(*by, "root"))
        groups = cut(groups.join(touched, [*by, "root"], "left_anti").unionByName(grown))


def families(docs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Families (by, family, group, part, section_part, mark, marks, parts) and which document is in which one.

    docs: by, file_id, place (order of the registry), group (stage), part, section_part, mark, title, single (a notice, an
    act or a verdict, which is no edition of anything). Without a mark the title counts. A family's number is the place
    of its first document.
    """
    none = lambda c: F.coalesce(c, F.lit(""))
    name = F.when(none(F.col("mark")) == "", F.concat(F.lit(TITLE), none(F.col("title")))).otherwise(F.col("mark"))
    alone = F.coalesce(F.col("single"), F.lit(False))
    key = F.when(alone, F.struct(F.col("group"), F.lit("").alias("part"), F.lit("").alias("section"), F.concat(F.lit("#"), F.col("file_id").cast("string")).alias("name"))).otherwise(F.struct(F.col("group"), F.when(name.startswith(TITLE), "").otherwise(none(F.col("part"))).alias("part"), F.when(name.startswith(TITLE), "").otherwise(none(F.col("section_part"))).alias("section"), name.alias("name")))
    keyed = docs.select(*by, "file_id", "place", "group", alone.alias("single"), key.alias("_k"))
    fams = keyed.groupBy(*by, "_k").agg(F.min("place").alias("family"), F.first("single").alias("single"), F.first("group").alias("group"))
    parts = F.array_distinct(F.filter(F.array("_k.part", "_k.section"), lambda p: p != ""))
    marked = ~F.col("_k.name").startswith(TITLE) & ~F.col("single")
    out = fams.select(*by, "family", "group", "single", F.when(marked, F.col("_k.name")).alias("mark"), F.when(marked, F.array("_k.name")).otherwise(F.array().cast("array<string>")).alias("marks"), F.when(F.col("single"), F.array().cast("array<string>")).otherwise(parts).alias("parts"))
    return out, keyed.join(fams.select(*by, "_k", "family"), [*by, "_k"]).select(*by, "file_id", "family")


def issued_apart(fams: DataFrame, members: DataFrame, docs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (by, a, b) of families with marks that may be one document and of which all documents of one come from issue
    folders before all of the other. Families of an object meet by the letters of their marks; volumes meet all."""
    issues = members.join(docs.select(*by, "file_id", *(F.col(c) for c in ("archive", "year", "issue_corr"))), [*by, "file_id"]).groupBy(*by, "family").agg(F.collect_set(F.struct("archive", "year", "issue_corr")).alias("issues"))
    some = fams.where("mark IS NOT NULL AND NOT single").join(issues, [*by, "family"]).select(*by, "group", "family", "mark", "issues", letters(F.col("mark")).alias("_l"), F.col("mark").startswith(TOME).alias("_tome"))
    side = lambda p: some.select(*by, "group", *(F.col(c).alias(f"{p}{c}") for c in ("family", "mark", "issues", "_l", "_tome")))
    a, b = side("a_"), side("b_")
    same = a.join(b.withColumn("a__l", F.col("b__l")), [*by, "group", "a__l"])
    tome = a.join(b, [*by, "group"]).where("(a__tome OR b__tome) AND a__l <> b__l")
    met = same.unionByName(tome.select(same.columns)).where("a_family < b_family").where(compatible(F.col("a_mark"), F.col("b_mark")))
    orders = F.flatten(F.transform("a_issues", lambda x: F.transform("b_issues", lambda y: F.coalesce(revisions.issue_order(x, y), F.lit(0)))))
    apart = (F.array_min(orders) == F.array_max(orders)) & (F.array_min(orders) != 0)
    return met.where(apart).select(*by, F.col("a_family").alias("a"), F.col("b_family").alias("b"))


def alike(profiles: DataFrame, members: DataFrame, fams: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (by, a, b) of families of one group with documents of like content. profiles: by, volume (file_id), pages,
    term (a code on its pages), n."""
    of = members.join(fams.select(*by, "family", "group"), [*by, "family"])
    p = profiles.join(of.select(*by, F.col("file_id").alias("volume"), "group"), [*by, "volume"])
    group = [*by, "group"]
    classes = relations.profile_classes(p, group)
    pairs = relations.same_content(classes, group).where("link = 'PAIR'")
    # families of a class: what holds for its first volume holds for all
    fams_of = classes.join(of.select(*group, F.col("file_id").alias("volume"), "family"), [*group, "volume"]).select(*group, "first", "family").distinct()
    fam = lambda v, n: fams_of.select(*group, F.col("first").alias(v), F.col("family").alias(n))
    apart = pairs.join(fam("x", "a"), [*group, "x"]).join(fam("y", "b"), [*group, "y"]).select(*by, "a", "b")
    copies = fam("x", "a").join(fam("x", "b"), [*group, "x"]).where("a < b").select(*by, "a", "b")
    return apart.union(copies).where("a <> b").distinct()


def build(docs: DataFrame, profiles: DataFrame, by: list[str]) -> DataFrame:
    """Every document with chain (the number of its first family), status, place, predecessor and successor.

    docs: the columns of families() and of revisions.MARKS. Editions of a chain are placed by revisions.resolve(); where
    their order is open, there is no predecessor. Documents marked as single are chains of their own.
    """
    fams, members = (cut(x) for x in families(docs, by))
    edges = issued_apart(fams, members, docs, by).union(alike(profiles, members, fams, by))
    roots = guarded_merge(fams, cut(edges), by)
    chained = members.join(roots, [*by, "family"]).select(*by, "file_id", F.col("root").alias("chain"))
    rows = docs.select(*by, "file_id", *revisions.MARKS).join(chained, [*by, "file_id"])
    placed = cut(revisions.resolve(rows, [*by, "chain"], "file_id"))
    order = Window.partitionBy(*by, "chain").orderBy(F.desc("place"), "file_id")
    near = lambda k: F.when(F.col("place").isNotNull(), F.lag("file_id", k).over(order))
    return placed.withColumns({"predecessor": near(1), "successor": near(-1)})


def chain_index(docs: DataFrame, by: list[str]) -> DataFrame:
    """by, file_id, rank: how many editions precede each document (row 203), by pointer jumping: a round doubles the steps.

    docs: by, file_id, predecessor. A predecessor that is no document ends the walk; where predecessors run in a circle
    the rank is null.
    """
    known = docs.select(*by, F.col("file_id").alias("predecessor"), F.lit(True).alias("_known")).distinct()
    start = docs.select(*by, "file_id", "predecessor").join(known, [*by, "predecessor"], "left")
    state = cut(start.select(*by, "file_id", F.when(F.col("_known"), F.col("predecessor")).alias("to"), F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("rank")))
    for _ in range(max(1, state.count()).bit_length() + 1):
        if not state.where("to IS NOT NULL").take(1):
            break
        far = state.select(*by, F.col("file_id").alias("to"), F.col("to").alias("_to"), F.col("rank").alias("_rank"))
        state = cut(state.join(far, [*by, "to"], "left").select(*by, "file_id", F.col("_to").alias("to"), (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank")))
    return state.select(*by, "file_id", F.when(F.col("to").isNull(), F.col("rank")).alias("rank"))

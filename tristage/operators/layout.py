"""Where on a page something changed: words of two editions by place (rows 327 to 331).

A page may be shifted as a whole and its parts by amounts of their own. Rare words vote for displacements; the peak of
the votes shifts the page, words that then stand in place are matched, and what is left votes again, part by part. All
pages go through a round together: votes, peaks and matches are joins and groups by page, words meet in grid cells.

Words: the keys of a page, word (its number in reading order), t, x0, y0, x1, y1, width and height of the page, all in
points from the upper left.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tristage.operators.graph import greedy
from tristage.operators.pagewise import aligned, by_page, frames
from tristage.sources.shared import cut, drop

# workers need not find this package: its functions travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tolerances in points, numbers of votes, shares, and the fields of a sheet in millimetres.
POS_TOL = 4.0
MAX_OFFSETS = 6
MIN_VOTES = 6
FIRST_VOTES = 3
RARE = 3
REGION = 60.0
PAIR = 40.0
ZONE_GAP = 12.0
MIN_MATCHED = 0.35
MOVE = 30.0
MOVE_TEXT = 150.0
LOCAL_SUPPORT = 0.3
MM = 72 / 25.4
STAMP_ZONE = (30.0, 6.0, 40.0, 65.0)
ARCHIVE_ZONE = (15.0, 15.0, 60.0, 10.0)
PAGE_STAMP_ZONE = (60.0, 12.0, 30.0, 8.0)
CORNER = (45.0, 15.0)
FURNITURE_GRID = 4.0
FURNITURE_SHARE = 0.6
FURNITURE_PAGES = 3
BINDING = 21.0
EDGE = 5.0
STAMP_W = 190.0
STAMP_FIRST = 60.0
STAMP_NEXT = 25.0
FIRST_SHEET = r"^(Разраб(?:\.|отал)?|Пров(?:\.|ерил)?|Н\.\s?[Кк]онтр(?:\.|оль)?|Нормоконтр(?:\.|оль)?|Стадия|Листов|ГИП|Утв(?:\.|ердил)?)$"
NUMERIC = r"^[-+±]?[0-9]+(?:[.,][0-9]+){0,30}$"
DATE = r"^[0-9]{2}\.[0-9]{2}\.[0-9]{2,4}$"
SEPARATOR = r"^[,.;:«»\"'()\[\]]+$"
#: Signs of symbol fonts and others for a bullet, with the one for all; dashes likewise; signs that broken fonts leave.
BULLETS = ("\uf0b7\uf0a7\uf0d8\uf076\uf0fc\u2022\u25cf\u25aa\u25e6\u2219\u00b7", "\u2022")
DASHES = ("-\u2013\u2014", "\u2013")
GARBLED = "[<>\u0180-\u02AF]"


def tidy(words: DataFrame) -> DataFrame:
    """With texts trimmed, one sign for bullets and one for dashes that stand alone; empty words go. x, y: the centre."""
    t = F.trim(F.coalesce("t", F.lit("")))
    one = F.when(t.isin(*BULLETS[0]), BULLETS[1]).when(t.isin(*DASHES[0]), DASHES[1]).otherwise(t)
    out = words.withColumn("t", one).where("t <> ''")
    return out.withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", (F.col("y0") + F.col("y1")) / 2)


def _grid(c: str, size: str) -> Column:
    """Cells from the lower right corner, where title blocks are moored."""
    return F.bround((F.col(size) - F.col(c)) / (FURNITURE_GRID * MM)).cast("int")


def repeated(words: DataFrame, file: list[str], page: str) -> DataFrame:
    """Places (file, t, gx, gy) where a word stands on most pages of a file of at least three: stamps (row 328)."""
    w = tidy(words).select(*file, page, "t", _grid("x", "width").alias("gx"), _grid("y", "height").alias("gy")).distinct()
    pages = w.groupBy(*file).agg(F.countDistinct(page).alias("_pages"))
    spots = w.groupBy(*file, "t", "gx", "gy").agg(F.count("*").alias("_n"))
    return spots.join(pages, file).where((F.col("_pages") >= FURNITURE_PAGES) & (F.col("_n") >= FURNITURE_SHARE * F.col("_pages"))).drop("_n", "_pages")


def service_zone(words: DataFrame, page: list[str], furniture: DataFrame | None = None, file: list[str] | None = None) -> DataFrame:
    """tidy words with `service` (row 327): whether one stands in the title block, a stamp, the binding, the frame's edge,
    the upper right corner, or where a word repeats over the pages of its file."""
    w = tidy(words)
    order = Window.partitionBy(*page).orderBy("word")
    whole = Window.partitionBy(*page)
    near = lambda k: F.lead(F.struct("t", "x", "y", "x0", "y0", "x1", "y1"), k).over(order)
    w = w.withColumns({"_b": near(-1), "_n1": near(1), "_n2": near(2), "_n3": near(3)})
    same = lambda v: F.abs(F.col(f"{v}.y") - F.col("y")) <= 3.0
    low, number = F.lower("t"), "^[0-9]{1,4}$"
    inner = F.col("_b").isNotNull() & F.col("_n1").isNotNull()
    goes_on = F.coalesce(same("_n2") & (F.col("_n2.x") > F.col("_n1.x")), F.lit(False))
    issued = inner & low.startswith("производств") & F.col("_b.t").isin("В", "в") & same("_b") & F.lower("_n1.t").startswith("работ") & same("_n1") & ~goes_on
    archive = inner & low.startswith("архивн") & F.col("_n1.t").startswith("№") & same("_n1")
    of = inner & (low == "страница") & F.col("_n1.t").rlike(number) & (F.col("_n2.t") == "из") & F.col("_n3.t").rlike(number) & same("_n3")
    here = F.struct("t", "x", "y", "x0", "y0", "x1", "y1")

    def zone(first: Column, last: Column, sizes: tuple[float, ...]) -> Column:
        left, up, right, down = (v * MM for v in sizes)
        return F.struct((first.x0 - left).alias("x0"), (F.least(first.y0, last.y0) - up).alias("y0"), (last.x1 + right).alias("x1"), (F.greatest(first.y1, last.y1) + down).alias("y1"))

    stamp = F.when(issued, zone(F.col("_b"), F.col("_n1"), STAMP_ZONE)).when(archive, zone(here, F.col("_n1"), ARCHIVE_ZONE)).when(of, zone(here, F.col("_n3"), PAGE_STAMP_ZONE))
    left = F.col("width") - STAMP_W * MM
    first = F.max(F.col("t").rlike(FIRST_SHEET) & (F.col("x") >= left) & (F.col("y") >= F.col("height") - STAMP_FIRST * MM)).over(whole)
    w = w.withColumns({"_stamp": stamp, "_first": first}).withColumn("_stamps", F.collect_list("_stamp").over(whole))
    top = F.col("height") - F.when(F.col("_first"), STAMP_FIRST * MM).otherwise(STAMP_NEXT * MM)
    x, y, edge = F.col("x"), F.col("y"), EDGE * MM
    field = ((x >= left) & (y >= top)) | (x <= BINDING * MM) | (y <= edge) | (y >= F.col("height") - edge) | (x >= F.col("width") - edge)
    field = field | ((x >= F.col("width") - CORNER[0] * MM) & (y <= CORNER[1] * MM)) | F.col("t").rlike(GARBLED)
    field = field | F.exists("_stamps", lambda s: x.between(s.x0, s.x1) & y.between(s.y0, s.y1))
    if furniture is not None:
        around = F.array(F.lit(-1), F.lit(0), F.lit(1))
        spots = furniture.withColumn("_a", F.explode(around)).withColumn("_b9", F.explode(around))
        spots = spots.select(*file, "t", (F.col("gx") + F.col("_a")).alias("_gx"), (F.col("gy") + F.col("_b9")).alias("_gy"), F.lit(True).alias("_often")).distinct()
        w = w.withColumns({"_gx": _grid("x", "width"), "_gy": _grid("y", "height")}).join(spots, [*file, "t", "_gx", "_gy"], "left")
        field = field | F.coalesce("_often", F.lit(False))
    return w.withColumn("service", field).select(*words.columns, "x", "y", "service")


def near_words(old: DataFrame, new: DataFrame, by: list[str], most: float, text: bool = True) -> DataFrame:
    """Pairs (by, word, other, d and both texts) of old words (word, x, y) and new ones (other, x, y) that are at most
    `most` apart in x and in y, with equal texts if wanted. Words lie in cells of side `most`."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cell = lambda c: F.floor(F.col(c) / most).cast("long")
    a = old.select(*by, "word", F.col("t").alias("_t"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.explode(around).alias("_i")).select("*", F.explode(around).alias("_j"))
    a = a.withColumns({"_i": cell("_x") + F.col("_i"), "_j": cell("_y") + F.col("_j")})
    b = new.select(*by, "other", F.col("t").alias("_u"), F.col("x").alias("_v"), F.col("y").alias("_w"), cell("x").alias("_i"), cell("y").alias("_j")).hint("merge")
    on = [*by, "_i", "_j"]
    both = a.withColumn("t", F.col("_t")).join(b.withColumn("t", F.col("_u")), [*on, "t"]) if text else a.join(b, on)
    d = F.greatest(F.abs(F.col("_v") - F.col("_x")), F.abs(F.col("_w") - F.col("_y")))
    return both.withColumn("d", d).where(F.col("d") <= most)


def peaks(old: DataFrame, new: DataFrame, by: list[str], first: bool) -> DataFrame:
    """The displacement (dx, dy) that the rare words of each page vote for (rows 329, 330), and its region.

    Votes fall into cells of POS_TOL; the fullest cell, with those around it, needs FIRST_VOTES on a page as a whole. A
    part needs MIN_VOTES, and of the rare words in the region of its voters LOCAL_SUPPORT must vote for it; cells are
    tried from the fullest on, down to the first with too few votes. Of cells alike, that of the earliest word is taken.
    """
    here = lambda df, key, side: df.select(*by, "t", F.lit(side).alias("_s"), F.struct(F.col(key).cast("long").alias("w"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("_v"))
    # all words of a page go to one task once; what follows groups by page and more, which needs no other shuffle
    words = here(old, "word", 0).unionByName(here(new, "other", 1))
    words = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    of = lambda side: F.collect_list(F.when(F.col("_s") == side, F.col("_v")))
    listed = words.where("t IS NOT NULL").groupBy(*by, "t").agg(of(0).alias("_a"), of(1).alias("_b")).where((F.size("_a") > 0) & (F.size("_a") <= RARE))
    some = listed.select(*by, F.explode("_a").alias("_o")).select(*by, F.col("_o.x").alias("_x"), F.col("_o.y").alias("_y"))
    votes = listed.where(F.size("_b") <= RARE).select(*by, "_b", F.explode("_a").alias("_o")).select(*by, "_o", F.explode("_b").alias("_v"))
    votes = votes.select(*by, F.col("_o.w").alias("word"), F.col("_v.w").alias("other"), F.col("_o.x").alias("_x"), F.col("_o.y").alias("_y"), (F.col("_v.x") - F.col("_o.x")).alias("_dx"), (F.col("_v.y") - F.col("_o.y")).alias("_dy"))
    votes = votes.withColumns({"_i": F.bround(F.col("_dx") / POS_TOL).cast("long"), "_j": F.bround(F.col("_dy") / POS_TOL).cast("long")})
    full = votes.groupBy(*by, "_i", "_j").agg(F.count("*").alias("_n"), F.min(F.struct("word", "other")).alias("_first"))
    order = Window.partitionBy(*by).orderBy(F.desc("_n"), F.asc("_first"))
    none = F.lit(None).cast("double")

    def voted(cells: DataFrame, key: list[str]) -> DataFrame:
        """What the votes in the chosen cells and those around them say: only these cells meet the votes again."""
        chosen = cells.select(*key, F.col("_i").alias("_ci"), F.col("_j").alias("_cj"))
        near = chosen.join(votes.hint("merge"), by).where((F.abs(F.col("_i") - F.col("_ci")) <= 1) & (F.abs(F.col("_j") - F.col("_cj")) <= 1))
        corners = [f(c).alias(n) for f, c, n in ((F.min, "_x", "_x0"), (F.min, "_y", "_y0"), (F.max, "_x", "_x1"), (F.max, "_y", "_y1"))]
        return near.groupBy(*key).agg(F.count("*").alias("_near"), F.size(F.collect_set("word")).alias("_voters"), F.median("_dx").alias("dx"), F.median("_dy").alias("dy"), *corners)

    if first:
        top = voted(full.withColumn("_rank", F.row_number().over(order)).where("_rank = 1"), by).where(F.col("_near") >= FIRST_VOTES)
        return top.select(*by, "dx", "dy", *(none.alias(c) for c in ("rx0", "ry0", "rx1", "ry1")))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = full.withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around))
    own = (F.col("_a") == 0) & (F.col("_b") == 0)
    spread = spread.select(*by, (F.col("_i") + F.col("_a")).alias("_i"), (F.col("_j") + F.col("_b")).alias("_j"), F.col("_n").alias("_m"), F.when(own, F.struct("_n", "_first")).alias("_own"))
    near = spread.groupBy(*by, "_i", "_j").agg(F.sum("_m").alias("_near"), F.max("_own").alias("_own")).where("_own IS NOT NULL")
    ranked = near.select(*by, "_i", "_j", "_near", "_own.*").withColumn("_rank", F.row_number().over(order))
    stop = F.min(F.when(F.col("_near") < MIN_VOTES, F.col("_rank"))).over(Window.partitionBy(*by))
    tried = ranked.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("_rank") < F.col("_stop")))
    tried = voted(tried, [*by, "_rank"]).select(*by, "_rank", "_voters", "dx", "dy", (F.col("_x0") - REGION).alias("rx0"), (F.col("_y0") - REGION).alias("ry0"), (F.col("_x1") + REGION).alias("rx1"), (F.col("_y1") + REGION).alias("ry1"))
    region = ["_voters", "dx", "dy", "rx0", "ry0", "rx1", "ry1"]
    inside = F.col("_x").between(F.col("rx0"), F.col("rx1")) & F.col("_y").between(F.col("ry0"), F.col("ry1"))
    held = tried.join(some.hint("merge"), by).groupBy(*by, "_rank").agg(F.count_if(inside).alias("_held"), *(F.first(c).alias(c) for c in region))
    good = held.where((F.col("_held") > 0) & (F.col("_voters") >= LOCAL_SUPPORT * F.greatest(F.col("_held"), F.lit(1))))
    best = good.groupBy(*by).agg(F.min(F.struct("_rank", "dx", "dy", "rx0", "ry0", "rx1", "ry1")).alias("_b"))
    return best.select(*by, *(F.col(f"_b.{c}").alias(c) for c in ("dx", "dy", "rx0", "ry0", "rx1", "ry1")))


def align(old: DataFrame, new: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Words that are paired (by, word, other, moved) and offsets (by, step, dx, dy, n) of pages in rounds: the whole page,
    then parts.

    old: by, word, t, x, y, service; new: by, other, t, x, y, service. All rounds of a page are in the task that has its
    words, with the rules of peaks(); each takes the nearest new word of its text that is left, in order of the old ones.
    At last, if a page has shifted, its service fields may have stayed in place. Content that is left may have moved.
    Both results are of one written table.
    """
    far = F.when(F.col("t").rlike(NUMERIC), MOVE).otherwise(MOVE_TEXT)
    word = lambda df, key, side: df.select(*by, F.lit(side).alias("_s"), F.col(key).cast("long").alias("_w"), "t", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "service", far.alias("_f"))
    both = word(old, "word", 0).unionByName(word(new, "other", 1)).where("t IS NOT NULL")

    def run(df: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        rows = list(zip(*(df[c].tolist() for c in ("_w", "t", "x", "y", "service", "_f")), strict=True))
        side = df["_s"].tolist()
        out: list[tuple] = []
        start = np.searchsorted(page, np.arange(page[-1] + 2)).tolist()
        for a, b in zip(start, start[1:], strict=False):
            was, now = ([rows[i] for i in range(a, b) if side[i] == s] for s in (0, 1))
            if was and now:
                pairs, steps, other = aligned(was, now, MAX_OFFSETS, (FIRST_VOTES, MIN_VOTES), POS_TOL, RARE, REGION, LOCAL_SUPPORT)
                out += [(a, m, w, o, None, None, None, None) for m, some in ((False, pairs), (True, other)) for w, o in some] + [(a, None, None, None, *s) for s in steps]
        found = pd.DataFrame(out, columns=["_at", "moved", "word", "other", "step", "dx", "dy", "n"])
        keys = {k: df[k].to_numpy()[found["_at"].to_numpy(dtype=int)] for k in by}
        whole = {c: found[c].astype("Int64") for c in ("word", "other", "step", "n")}
        return pd.DataFrame({**keys, **whole, "moved": found["moved"].astype("boolean"), "dx": found["dx"].astype(float), "dy": found["dy"].astype(float)})

    kinds = dict(both.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "word long, other long, step long, n long, moved boolean, dx double, dy double"])
    done = cut(by_page(both, by, run, schema))
    pairs = done.where("word IS NOT NULL").select(*by, F.col("word").cast(dict(old.dtypes)["word"]).alias("word"), F.col("other").cast(dict(new.dtypes)["other"]).alias("other"), "moved")
    return pairs, done.where("step IS NOT NULL").select(*by, F.col("step").cast("int").alias("step"), "dx", "dy", "n")


@dataclass(frozen=True)
class Placed:
    """What place() finds. pages: a row for each pair of pages; words: side, word, t, state; pairs: was, became, kind;
    zones: side, zone (largest first), corners as shares of the page."""

    pages: DataFrame
    words: DataFrame
    pairs: DataFrame
    zones: DataFrame


def place(old: DataFrame, new: DataFrame, page: list[str]) -> Placed:
    """Where two editions of pages differ (row 330). old, new: words with `service`, from service_zone().

    layout: SAME_PLACE, SHIFTED, RESIZED (of another format) or RELAID (fewer than MIN_MATCHED in place: no zones).
    States: MATCHED, MOVED (the same text not far away), REMOVED, ADDED, SEPARATOR; SERVICE ones are not content. A page
    that has no words on one side is left out. Of two formats both scaled and plain places are tried.
    """
    size = lambda df, p: df.groupBy(*page).agg(F.max("width").alias(f"_w{p}"), F.max("height").alias(f"_h{p}"), F.count("*").alias(f"_n{p}"))
    both = cut(size(old, 0).join(size(new, 1).hint("merge"), page))
    other = (F.abs(F.col("_w0") - F.col("_w1")) > 0.01 * F.col("_w1")) | (F.abs(F.col("_h0") - F.col("_h1")) > 0.01 * F.col("_h1"))
    frames = both.withColumn("frame", F.explode(F.when(other, F.array(F.lit("scaled"), F.lit("points"))).otherwise(F.array(F.lit("points")))))
    scaled = F.col("frame") == "scaled"
    kx, ky = F.when(scaled, F.col("_w1") / F.col("_w0")).otherwise(1.0), F.when(scaled, F.col("_h1") / F.col("_h0")).otherwise(1.0)
    a = old.join(frames, page).select(*page, "frame", "word", "t", "service", *((F.col(c) * (kx if c[0] == "x" else ky)).alias(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    b = new.join(frames, page).select(*page, "frame", F.col("word").alias("other"), "t", "service", "x", "y", "x0", "y0", "x1", "y1")
    by = [*page, "frame"]
    a, b = cut(a), cut(b)
    paired, offsets = align(a, b, by)
    n = frames.join(paired.where("NOT moved").groupBy(*by).agg(F.count("*").alias("matched")), by, "left").fillna({"matched": 0})
    best = n.groupBy(*page).agg(F.max(F.struct("matched", "frame")).alias("_b"))  # scaled counts first among equals
    best = cut(best.select(*page, F.col("_b.frame").alias("frame"), F.col("_b.matched").alias("matched")).join(both, page))
    lead = offsets.join(best.select(*by), by, "left_semi")
    shifts = lead.groupBy(*page).agg(F.max((F.abs("dx") > 1) | (F.abs("dy") > 1)).alias("_far"), F.count("*").alias("_steps"), F.max(F.when(F.col("step") == 0, F.struct("dx", "dy"))).alias("_g"), F.sort_array(F.collect_list(F.struct("step", "dx", "dy", "n"))).alias("offsets"))
    # the words of the frame that counts, then what has become of them
    keep = lambda df: cut(df.join(best.select(*by), by, "left_semi"))
    was, now = keep(a), keep(b)
    drop(a, b)
    base = best.select(*page).join(shifts, page, "left").select(*page, F.coalesce("_g.dx", F.lit(0.0)).alias("_gx"), F.coalesce("_g.dy", F.lit(0.0)).alias("_gy"))
    state = lambda word: F.when(~F.col("moved"), "MATCHED").when(F.col("service"), "SERVICE").when(F.col("moved"), "MOVED").when(F.col("t").rlike(SEPARATOR), "SEPARATOR").otherwise(word)
    tell = lambda df, key, word: df.join(paired.select(*by, key, "moved"), [*by, key], "left").withColumn("state", state(word)).drop("frame", "moved")
    first = was, now
    was, now = tell(was, "word", "REMOVED"), tell(now, "other", "ADDED")
    was, now = cut(was), cut(now)
    drop(*first)

    def changes(kind: str, left: DataFrame, right: DataFrame, form: str) -> DataFrame:
        """What became what: of unequal words near each other the nearest pairs first."""
        left, right = left.where(F.col("t").rlike(form)), right.where(F.col("t").rlike(form))
        d = F.sqrt(F.pow(F.col("_v") - F.col("_x"), 2) + F.pow(F.col("_w") - F.col("_y"), 2))
        near = near_words(left, right, page, PAIR, text=False).where("_t <> _u").withColumn("d", d).where(F.col("d") <= PAIR)
        pair = greedy(near, page, [F.col("d"), F.col("word"), F.col("other")], "word", "other")
        out = pair.join(left.select(*page, "word", F.col("t").alias("was")).hint("merge"), [*page, "word"]).join(right.select(*page, "other", F.col("t").alias("became")).hint("merge"), [*page, "other"])
        return out.select(*page, "word", "other", "was", "became", F.lit(kind).alias("kind"))

    gone, come = was.where("state = 'REMOVED'"), now.where("state = 'ADDED'")
    ahead = gone.join(base, page).withColumns({"x": F.col("x") + F.col("_gx"), "y": F.col("y") + F.col("_gy")})
    pairs = changes("NUMBER", ahead, come, NUMERIC).union(changes("DATE", was.where("state = 'SERVICE'"), now.where("state = 'SERVICE'"), DATE))
    words = was.select(*page, F.lit("OLD").alias("side"), "word", "t", "state").union(now.select(*page, F.lit("NEW"), "other", "t", "state"))
    count = lambda side, s: F.count_if((F.col("side") == side) & (F.col("state") == s))
    sums = words.groupBy(*page).agg(count("OLD", "REMOVED").alias("content_removed"), count("NEW", "ADDED").alias("content_added"), count("OLD", "MOVED").alias("moved"), count("OLD", "SERVICE").alias("service_removed"), count("NEW", "SERVICE").alias("service_added"))
    share = F.round(F.col("matched") / F.greatest(F.lit(1), F.least("_n0", "_n1")), 3)
    exact = F.col("matched") / F.greatest(F.lit(1), F.least("_n0", "_n1"))
    layout = F.when(exact < MIN_MATCHED, "RELAID").when(F.col("frame") == "scaled", "RESIZED").when(F.col("_far") | (F.col("_steps") > 1), "SHIFTED").otherwise("SAME_PLACE")
    pages = cut(best.join(shifts, page, "left").join(sums.hint("merge"), page).select(*page, layout.alias("layout"), "matched", share.alias("matched_share"), "offsets", *sums.columns[len(page) :]))
    sizes = best.select(*page, F.when(F.col("frame") == "scaled", F.col("_w1")).otherwise(F.col("_w0")).alias("_wo"), F.when(F.col("frame") == "scaled", F.col("_h1")).otherwise(F.col("_h0")).alias("_ho"), "_w1", "_h1")
    fine = pages.where("layout <> 'RELAID'").select(*page)
    box = lambda df, side, word: df.join(fine, page, "left_semi").select(*page, F.lit(side).alias("side"), F.col(word).alias("box"), "x0", "y0", "x1", "y1")
    marked = zones(box(gone, "OLD", "word").union(box(come, "NEW", "other")), [*page, "side"], ZONE_GAP)
    part = lambda c, o, n: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / F.when(F.col("side") == "OLD", F.col(o)).otherwise(F.col(n)))), 4).alias(c)
    rank = F.row_number().over(Window.partitionBy(*page, "side").orderBy(F.desc((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), "x0", "y0"))
    shares = marked.withColumn("zone", rank).join(sizes, page).select(*page, "side", "zone", "n", part("x0", "_wo", "_w1"), part("y0", "_ho", "_h1"), part("x1", "_wo", "_w1"), part("y1", "_ho", "_h1"))
    return Placed(pages, words, pairs, shares)


def zones(boxes: DataFrame, by: list[str], gap: float) -> DataFrame:
    """Boxes (box, x0, y0, x1, y1) merged until no two of a group lie within gap of each other (row 331): by, x0, y0, x1,
    y1 and n, the boxes in each.

    A round merges components of boxes that touch and takes the frame of each, which may touch others: then it goes on.
    All rounds of a page are in the task that has its boxes; a box without corners is none.
    """
    corners = ["x0", "y0", "x1", "y1"]

    def merge(df: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        at, box, n = frames(page, df[corners].to_numpy(dtype=float).T, gap)
        first = np.searchsorted(page, at)
        return pd.DataFrame({**{k: df[k].to_numpy()[first] for k in by}, **dict(zip(corners, box, strict=True)), "n": n})

    kinds = dict(boxes.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "x0 double, y0 double, x1 double, y1 double, n long"])
    return by_page(boxes.select(*by, *(F.col(c).cast("double").alias(c) for c in corners)).dropna(subset=corners), by, merge, schema)

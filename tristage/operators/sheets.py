"""Which working sheets belong to a design sheet: by shared rooms and by names (rows 176 to 178)."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tristage.sources.shared import cut

# workers need not find this package: its functions travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rooms and share of rooms that a pair shares, similarity and words of names, what names and disciplines
#: add, and how many pairs of a sheet are handed over.
SHARED, CONTAINED, NAMED, WORDS = 3, 0.15, 0.6, 3
DISCIPLINE, SAME_NAME, NAME, TOP = 0.25, 2.0, 0.5, 12
#: Classes of a block: design sheets of a group are cut into up to BUSY blocks of at least BLOCK, either side into more only
#: where a block would hold more than LARGE.
BLOCK, LARGE, BUSY = 4000, 64_000, 4
#: Cells of a table that is reckoned at a time.
CELLS = 2_000_000


def _keyed(sheets: DataFrame, rooms: DataFrame, by: list[str]) -> DataFrame:
    """Sheets with what pairs are scored by, in one order, and key, which is equal where all of it is; a written table."""
    room = rooms.select(*by, "sheet", "room").distinct().groupBy(*by, "sheet").agg(F.sort_array(F.collect_list("room")).alias("held"), F.count("*").alias("n_rooms"))
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    names = lambda c: F.sort_array(F.array_distinct(none(F.col(c)))).alias(c)
    some = sheets.where(F.col("stage").isin("PD", "RD")).dropna(subset=[*by, "sheet"])
    some = some.select(*by, "sheet", "stage", "section", names("words"), F.sort_array(none(F.col("numbers"))).alias("numbers"), names("tags"), (F.col("words").isNull() | F.col("numbers").isNull()).alias("unnamed"))
    held = F.coalesce("held", F.array().cast(dict(room.dtypes)["held"])).alias("held")
    out = some.join(room, [*by, "sheet"], "left").select(*some.columns, held, F.coalesce("n_rooms", F.lit(0)).alias("n_rooms"))
    return cut(out.withColumn("key", F.sha2(F.to_json(F.struct("section", "words", "numbers", "tags", "held", "n_rooms", "unnamed")), 256)))


def _half_up(x: np.ndarray) -> np.ndarray:
    """Thousandths, halves away from zero, as round() in SQL takes them from a number's shortest form."""
    out = np.floor(x * 1000 + 0.5)
    odd = np.abs(x * 1000 - np.floor(x * 1000) - 0.5) < 1e-6
    value, at = np.unique(x[odd], return_inverse=True)
    out[odd] = np.array([int(Decimal(repr(v)).scaleb(3).quantize(Decimal(1), ROUND_HALF_UP)) for v in value.tolist()], dtype=float)[at]
    return out.astype(np.int64)


def _incidence(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """Which of the elements that both sides know each row's list holds, as 0 and 1."""
    known = set().union(*map(set, left)) & set().union(*map(set, right))
    number = {x: i for i, x in enumerate(known)}

    def one(lists: list) -> np.ndarray:
        out = np.zeros((len(lists), max(1, len(number))), dtype=np.float32)
        for row, items in enumerate(lists):
            out[row, [number[x] for x in items if x in number]] = 1
        return out

    return one(left), one(right)


def _numbered(rows: Iterator) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row among those that differ, in order of their first, and where these stand."""
    number: dict = {}
    at = np.array([number.setdefault(x, len(number)) for x in rows])
    return at, np.unique(at, return_index=True)[1]


def best(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """key, rd and scores of the TOP working sheets in `right` (classes, with their first TOP sheets) for each class of
    design sheets in `left`. Of equal scores and rooms those of the earliest sheet count, so TOP classes hold TOP sheets.
    Names are as similar as the Jaccard of their words and numbers if the numbers are the same, else not at all; nor are
    those of one token (row 177).

    A pair's score is what its kinds (section, name and tags) give and the share of rooms, which for one design sheet grows
    with the rooms they share. So of working sheets of one kind, those that share most of a set of rooms are the best for
    any design sheet with that set: kinds meet kinds, sets meet sets, and only TOP classes of each kind meet the sheet.
    """
    lists = lambda df, c: [tuple(x) for x in df[c]]
    kind = lambda df: _numbered(zip(df["section"], *(lists(df, c) for c in ("words", "numbers", "tags")), df["unnamed"], strict=True))
    left = left.assign(_s=_numbered(lists(left, "held"))[0]).sort_values("_s", kind="stable", ignore_index=True)
    right = right.assign(_k=kind(right)[0], _first=[x[0] for x in right["sheets"]]).sort_values(["_k", "_first"], ignore_index=True)
    (set_l, sets_l), (set_r, sets_r) = (_numbered(lists(df, "held")) for df in (left, right))
    (kind_l, kinds_l), (kind_r, kinds_r) = kind(left), kind(right)
    room_l, room_r = _incidence(*([x for x in df["held"].iloc[at]] for df, at in ((left, sets_l), (right, sets_r))))
    # what a kind is to a kind
    one, two = left.iloc[kinds_l], right.iloc[kinds_r]
    tokens = lambda df: [list({*w, *n}) for w, n in zip(df["words"], df["numbers"], strict=True)]
    token = tokens(one), tokens(two)
    (word_l, word_r), (tag_l, tag_r), (tok_l, tok_r) = _incidence(lists(one, "words"), lists(two, "words")), _incidence(lists(one, "tags"), lists(two, "tags")), _incidence(*token)
    size = lambda x: np.array([len(v) for v in x], dtype=np.float64)
    size_l, size_r = size(token[0])[:, None], size(token[1])
    code: dict = {"OTHER": 0, None: 1}
    coded = lambda values: np.array([code.setdefault(v, len(code)) for v in values])
    part_l, part_r = coded(one["section"])[:, None], coded(two["section"])
    alike = coded(lists(one, "numbers"))[:, None] == coded(lists(two, "numbers"))
    both = (size(one["words"])[:, None] > 0) & (size_l >= 2) & (size(two["words"]) > 0) & (size_r >= 2)
    common = (tok_l @ tok_r.T).astype(np.float64)
    similar = np.where(alike & both, common / np.maximum(1, size_l + size_r - common), 0.0)
    named, informative = similar >= NAMED, size_l >= WORDS
    touching = alike & (word_l @ word_r.T > 0)
    same = part_l == part_r
    apart = ~same & (part_l > 1) & (part_r > 1)
    by_name = named & informative & same
    bonus = np.where((size(one["tags"])[:, None] > 0) & (size(two["tags"]) > 0), np.where(tag_l @ tag_r.T > 0, DISCIPLINE, -DISCIPLINE), 0.0)
    name = np.where(similar >= 0.999, SAME_NAME, np.where(named, NAME * similar, 0.0))
    unnamed = one["unnamed"].to_numpy(dtype=bool)[:, None] | two["unnamed"].to_numpy(dtype=bool)
    # the first TOP of every kind, when a kind's classes are in order of the rooms that they share, then of their sheets
    many = len(right)
    start = np.searchsorted(kind_r, np.arange(len(kinds_r) + 1))
    taken = np.flatnonzero(np.arange(many) - start[kind_r] < TOP)
    of = kind_r[taken]
    most = int(room_l.sum(axis=1).max(initial=0)) + 1
    whole = np.int32 if len(kinds_r) * (most + 1) * many < 2**31 else np.int64
    base = (kind_r.astype(np.int64) * (most + 1) * many + np.arange(many)).astype(whole)
    rank = np.empty(many, dtype=np.int64)
    rank[np.argsort(right["_first"].to_numpy(), kind="stable")] = np.arange(many)
    n_rooms, keys, sheets = left["n_rooms"].to_numpy(dtype=np.float64), left["key"].to_numpy(), right["sheets"].tolist()
    step = max(1, CELLS // many)
    for s in range(0, len(sets_l), step):
        shares = (room_l[s : s + step] @ room_r.T).astype(whole)[:, set_r]
        order = np.sort(base + (most - shares) * whole(many), axis=1)[:, taken]
        place, rooms = order % many, most - order // many % (most + 1)
        first, last = np.searchsorted(set_l, [s, s + step])
        rows = max(1, CELLS // len(taken))
        for at in range(first, last, rows):
            i = np.arange(at, min(last, at + rows))
            k = kind_l[i]
            shared, n = rooms[set_l[i] - s].astype(np.float64), n_rooms[i, None]
            contained = np.divide(shared, n, out=np.zeros_like(shared), where=n > 0)
            by_rooms = (shared >= SHARED) & (contained >= CONTAINED)
            good = ((shared > 0) | touching[k][:, of]) & ~apart[k][:, of] & (by_rooms | by_name[k][:, of]) & ((n >= SHARED) | informative[k])
            a, c = np.nonzero(good)
            if not len(a):
                continue
            b, ka, kb = place[set_l[i] - s][a, c], k[a], of[c]
            shared, contained, by_rooms = shared[a, c], contained[a, c], by_rooms[a, c]
            score = _half_up(contained + bonus[ka, kb] + name[ka, kb])
            order = np.lexsort((rank[b], -shared, -score, a))
            order = order[np.arange(len(a)) - np.searchsorted(a, a) < TOP]
            a, b, ka, kb, shared, contained, by_rooms, score = (x[order] for x in (a, b, ka, kb, shared, contained, by_rooms, score))
            # the sheets of these classes, the best of them
            each = np.repeat(np.arange(len(b)), [len(sheets[x]) for x in b])
            rd = np.concatenate([sheets[x] for x in b])
            order = np.lexsort((rd, -shared[each], -score[each], a[each]))
            order = order[np.arange(len(order)) - np.searchsorted(a[each], a[each]) < TOP]
            rd, each = rd[order], each[order]
            how = np.where(by_rooms & named[ka, kb], "BOTH", np.where(by_rooms, "ROOMS", "NAME"))
            near = np.where(unnamed[ka, kb], np.nan, similar[ka, kb])
            yield pd.DataFrame({"key": keys[i][a[each]], "rd": rd, "shared": shared[each].astype(np.int64), "containment": contained[each], "similarity": near[each], "how": how[each], "score": score[each] / 1000.0})


def pairs(sheets: DataFrame, rooms: DataFrame, by: list[str]) -> DataFrame:
    """by, pd, rd, shared, containment, similarity, how (ROOMS, NAME or BOTH), score and place of at most TOP working
    sheets for each design sheet; the limit is the feature.

    sheets: by, sheet, stage, section, words, numbers, tags; rooms: by, sheet, room. What shares neither a room nor a word
    of its name is never paired. Sheets alike in all that counts are one class; of a class of working sheets the first
    TOP are enough. Classes are dealt to blocks, design sheets in order of their rooms and working sheets in order of their
    kind; each two blocks of a group meet in a task, which hands over TOP pairs of each class: the work grows with the
    sets of rooms of the one and the classes of the other.
    """
    keyed = _keyed(sheets, rooms, by)
    kind = dict(keyed.dtypes)["sheet"]
    facts = [F.first(c).alias(c) for c in ("section", "words", "numbers", "tags", "held", "n_rooms", "unnamed")]
    place = F.row_number().over(Window.partitionBy(*by, "key").orderBy("sheet"))
    working = keyed.where("stage = 'RD'").withColumn("_place", place).where(F.col("_place") <= TOP)
    working = working.groupBy(*by, "key").agg(F.sort_array(F.collect_list("sheet")).alias("sheets"), *facts)
    design = keyed.where("stage = 'PD'").groupBy(*by, "key").agg(F.array().cast(f"array<{kind}>").alias("sheets"), *facts)
    both = cut(design.withColumn("stage", F.lit("PD")).unionByName(working.withColumn("stage", F.lit("RD"))).withColumn("_id", F.monotonically_increasing_id()))
    n = lambda s: F.count_if(F.col("stage") == s)
    cut_in = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    blocks = both.groupBy(*by).agg(n("PD").alias("_pd"), n("RD").alias("_rd")).where("_pd > 0 AND _rd > 0")
    blocks = blocks.withColumns({"_p": F.greatest(cut_in("_pd", max(BLOCK, LARGE)), F.least(cut_in("_pd", BLOCK), F.lit(BUSY))), "_r": cut_in("_rd", LARGE)})
    design_side = F.col("stage") == "PD"
    order = F.when(design_side, F.xxhash64("held")).otherwise(F.xxhash64("section", "words", "numbers", "tags", "unnamed"))
    rank = F.row_number().over(Window.partitionBy(*by, "stage").orderBy(order, "key")) - 1
    own = lambda c, n: F.array(F.floor(F.col("_rank") * F.col(c) / F.col(n)).cast("int"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    ranked = both.drop("key").withColumn("key", F.col("_id")).withColumn("_rank", rank).drop("_id")
    dealt = ranked.join(blocks, by).withColumn("_i", F.explode(F.when(design_side, own("_p", "_pd")).otherwise(every("_p")))).withColumn("_j", F.explode(F.when(design_side, every("_r")).otherwise(own("_r", "_rd")))).drop("_p", "_r", "_pd", "_rd", "_rank")

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(parts), ignore_index=True)
        left, right = df[df["stage"] == "PD"], df[df["stage"] == "RD"]
        if len(left) and len(right):
            for out in best(left, right):
                yield out

    schema = f"key long, rd {kind}, shared long, containment double, similarity double, how string, score double"
    spark = keyed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = dealt.repartition(tasks, *by, "_i", "_j").groupBy(*by, "_i", "_j").applyInPandas(meet, schema)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.desc("shared"), F.asc("rd")))
    found = found.withColumn("place", place).where(F.col("place") <= TOP)
    found = found.select(F.col("key").alias("_id"), "rd", "shared", F.round("containment", 3).alias("containment"), F.round("similarity", 3).alias("similarity"), "how", "score", "place")
    members = keyed.where("stage = 'PD'").select(*by, "key", F.col("sheet").alias("pd")).join(both.where(design_side).select(*by, "key", "_id"), [*by, "key"])
    return members.join(found, "_id").select(*by, "pd", "rd", "shared", "containment", "similarity", "how", "score", "place")

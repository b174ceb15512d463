"""Budgeted reduction: ordered items are packed into batches of bounded length, each batch becomes one text, again and again.

A round expands items over the budget into overlapping parts, packs greedily in order (an item that would exceed the
budget begins a new batch; separators don't count), and reduces every batch of every group at once.  A group is done
when it has one batch, or when a round has not shortened it to under 95 % (its results are then joined).

Packing is parallel within a group.  Running totals give each item the code point at which it begins; a batch that
begins with it is followed by the item that holds the code point a budget further on, so each item knows the next
start.  A group's code points are cut into cells of a budget.  A step leads to the same cell or the next, and two steps
never stay in one, so a cell is left after one or two.  Pointers over 2, 4, 8 ... cells are made by joining those of
half the length, only for the items of every 2nd, 4th, 8th cell, so that all levels together have twice the items; on
the way back the first start of each cell follows from its group's first item, with the number of its batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfold.functions.text import chunks
from arborfold.operators.prefix import running
from arborfold.plans.events import Log, quiet
from arborfold.plans.scratch import saved

SEPARATOR = "\n\n"
#: group, joined items -> text
Reducer = Callable[[Column, Column], Column]


def expand(items: DataFrame, budget: int) -> DataFrame:
    """(grp, ord, sub, text, len): items over the budget in parts of half of it, overlapping by a tenth."""
    long = F.char_length("text") > budget
    parts = F.when(long, chunks(F.col("text"), max(budget // 2, 1), budget // 10)).otherwise(F.array("text"))
    return items.select("grp", "ord", F.posexplode(parts).alias("sub", "text")).withColumn("len", F.char_length("text"))


def _next_starts(full: DataFrame, budget: int) -> DataFrame:
    """(grp, cell, p, next): where a batch that begins at p is followed by another; null if it is the last.

    full: (grp, p, e), the items that are not empty, each from code point p to e of its group.  The item that holds
    code point p + budget lies in the next cell or reaches into it, so a cell's items and the cell's points are sorted
    together.
    """
    cell = lambda at: F.floor(F.col(at) / budget)
    last = F.floor((F.col("e") - 1) / budget)
    items = full.select("grp", F.explode(F.sequence(cell("p"), last)).alias("at"), F.col("p").alias("key"), F.lit(0).alias("kind"), F.struct("p", "e").alias("item"), F.lit(None).cast("long").alias("p"))
    points = full.select("grp", (cell("p") + 1).alias("at"), (F.col("p") + budget).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("struct<p: bigint, e: bigint>"), "p")
    upto = Window.partitionBy("grp", "at").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = items.union(points).withColumn("held", F.last("item", ignorenulls=True).over(upto)).filter("kind = 1")
    follows = F.when(F.col("held.e") > F.col("key"), F.col("held.p"))
    return held.select("grp", cell("p").alias("cell"), "p", follows.alias("next"))


def _starts(full: DataFrame, budget: int, cells: int) -> DataFrame:
    """(grp, p, batch) of the items with which batches begin; cells: of the longest group."""
    step = saved(_next_starts(full, budget))
    cell = lambda c: F.floor(F.col(c) / budget)
    again = F.col("next").isNotNull() & (cell("next") == F.col("cell"))
    second = step.select(F.col("grp").alias("g"), F.col("p").alias("q"), F.col("next").alias("then"))
    twice = step.filter(again).join(second, F.col("grp").eqNullSafe(F.col("g")) & (F.col("next") == F.col("q")))
    leave = step.filter(~again).select("grp", "cell", "p", F.col("next").alias("to"), F.lit(1).cast("long").alias("n"))
    levels = [saved(leave.union(twice.select("grp", "cell", "p", F.col("then"), F.lit(2).cast("long"))))]
    while 1 << len(levels) < cells:
        here, far = levels[-1], 1 << len(levels)
        left, right = here.filter(F.col("cell") % far == 0), here.filter(F.col("cell") % far != 0)
        right = right.select(F.col("grp").alias("g"), F.col("p").alias("q"), F.col("to").alias("beyond"), F.col("n").alias("more"))
        both = left.join(right, F.col("grp").eqNullSafe(F.col("g")) & (F.col("to") == F.col("q")), "left")
        levels.append(saved(both.select("grp", "cell", "p", F.col("beyond").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))))
    first = step.filter("p = 0").select("grp", "p", F.lit(0).cast("long").alias("batch"))
    for level in reversed(levels):
        jump = level.filter("to is not null").select(F.col("grp").alias("g"), F.col("p").alias("q"), "to", "n")
        led = first.join(jump, F.col("grp").eqNullSafe(F.col("g")) & (F.col("p") == F.col("q")))
        first = saved(first.union(led.select("grp", F.col("to").alias("p"), F.col("batch") + F.col("n"))))
    inside = step.filter(again).select(F.col("grp").alias("g"), F.col("p").alias("q"), "next")
    led = first.join(inside, F.col("grp").eqNullSafe(F.col("g")) & (F.col("p") == F.col("q")))
    return first.union(led.select("grp", F.col("next").alias("p"), F.col("batch") + 1))


def _numbered(points: DataFrame, starts: DataFrame, budget: int) -> DataFrame:
    """(grp, at, batch): the last start at or before each of points (grp, at), which are different."""
    cell = F.floor(F.col("at") / budget)
    rows = starts.select("grp", F.col("p").alias("at"), "batch").union(points.select("grp", "at", F.lit(None).cast("long"))).withColumn("cell", cell)
    upto = Window.partitionBy("grp", "cell").orderBy("at", F.col("batch").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"own": F.max("batch").over(upto), "point": F.col("batch").isNull()}).filter("point")
    # a batch is at most a budget long, so what begins in no cell here begins in the one before
    before = starts.groupBy(F.col("grp").alias("g"), (F.floor(F.col("p") / budget) + 1).alias("after")).agg(F.max("batch").alias("carried"))
    rows = rows.join(before, F.col("grp").eqNullSafe(F.col("g")) & (F.col("cell") == F.col("after")), "left")
    return rows.select("grp", "at", F.coalesce("own", "carried", F.lit(0)).alias("batch"))


def pack(parts: DataFrame, budget: int) -> DataFrame:
    """(grp, ord, sub, len, batch) of parts (grp, ord, sub, len); batches are numbered from 0 in each group.

    Lengths over the budget count as the budget; expand() leaves none.  Empty parts go with what is before them.
    """
    own = F.least("len", F.lit(budget))
    parts = saved(parts.select("grp", "ord", "sub", "len"))  # texts are not looked at again
    longest = parts.groupBy("grp").agg(F.sum(own.cast("long")).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= budget:  # each group is one batch
        return parts.withColumn("batch", F.lit(0))
    placed = saved(running(parts, ["grp"], ["ord", "sub"], p=own))
    # the code point that decides: an item's first, or for empty ones the one before
    placed = placed.withColumn("point", F.when(F.col("len") > 0, F.col("p")).otherwise(F.col("p") - 1))
    full = placed.filter("len > 0").select("grp", "p", (F.col("p") + own).alias("e"))
    starts = saved(_starts(full, budget, (longest - 1) // budget + 1))
    numbered = _numbered(placed.select("grp", F.col("point").alias("at")).distinct(), starts, budget)
    numbered = numbered.select(F.col("grp").alias("g"), F.col("at").alias("q"), "batch")
    out = placed.join(numbered, F.col("grp").eqNullSafe(F.col("g")) & (F.col("point") == F.col("q")))
    return out.select("grp", "ord", "sub", "len", F.col("batch").cast("int").alias("batch"))


def batches(parts: DataFrame, packed: DataFrame) -> DataFrame:
    """(grp, batch, joined, len) of parts and where pack() puts them; a batch is bounded by the budget."""
    where = packed.select(F.col("grp").alias("g"), F.col("ord").alias("o"), F.col("sub").alias("s"), "batch")
    placed = parts.join(where, F.col("grp").eqNullSafe(F.col("g")) & F.col("ord").eqNullSafe(F.col("o")) & (F.col("sub") == F.col("s")))
    return placed.groupBy("grp", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sub", "text"))), lambda x: x["text"]), SEPARATOR).alias("joined"), F.sum("len").alias("len"))


def _itself(grp: Column) -> Column:
    return grp


def reduce_once(items: DataFrame, budget: int, reducer: Reducer, log: Log = quiet, name: Callable[[Column], Column] = _itself) -> tuple[DataFrame, DataFrame]:
    """One round for all groups of items (grp, ord, text): (grp, text) of those that are done, and the items of the others.

    ord: anything that sorts, different within a group; that of the new items is an int.  name: of a group, in events.
    """
    parts = expand(items.select("grp", "ord", "text"), budget)
    got = batches(parts, pack(parts, budget))
    out = saved(got.withColumn("out", reducer(F.col("grp"), F.col("joined"))).select("grp", "batch", "out", "len"))
    log("reduced", out.select(F.concat(name(F.col("grp")), F.lit(": batch "), F.col("batch") + 1)))
    per = out.groupBy("grp").agg(F.count("*").alias("n"), F.sum("len").alias("taken"), F.sum(F.char_length("out")).alias("made"))
    stop = (F.col("n") == 1) | (F.col("made") >= F.expr("taken * 95 div 100"))
    done = out.join(per.filter(stop), "grp", "left_semi").groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "out"))), lambda x: x["out"]), SEPARATOR).alias("text"))
    return done, out.join(per.filter(~stop), "grp", "left_semi").select("grp", F.col("batch").alias("ord"), F.col("out").alias("text"))


def reduce_items(items: DataFrame, budget: int, reducer: Reducer, log: Log = quiet, name: Callable[[Column], Column] = _itself) -> DataFrame:
    """(grp, text) for each group of items (grp, ord, text); ord: anything that sorts, different within a group."""
    done = None
    while True:
        ended, items = reduce_once(items, budget, reducer, log, name)
        done = ended if done is None else done.union(ended)
        if items.isEmpty():
            return done

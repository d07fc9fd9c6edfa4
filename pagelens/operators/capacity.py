"""What text a shape holds: straight lines that lie wholly inside a mask, filled word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import fixed as X
from pagelens.operators import runs as R
from pagelens.operators.texts import SPACE_W, sum_width, width_of

RK = ["page_id", "region_id"]


def line_rooms(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """``keys, size, rooms``: the widths of the lines of a shape, from the top line down.

    ``sizes`` has ``keys, size``, any number of sizes a region. A line is as many pixel rows as its size; its width is
    the widest stretch of columns inside the mask on all of them, which is where as many runs meet as the line has rows.
    Lines without such a stretch hold nothing and are left out.
    """
    keys = [*RK, "size", "line"]
    top = mask.groupBy(*RK).agg(F.min("y").alias("top"))
    j = mask.join(sizes.join(top, RK), RK).withColumn("line", F.floor((F.col("y") - F.col("top")) / F.col("size")).cast("int"))
    ends = F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))
    e = j.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("x")
    s = e.select(*keys, "x", F.lead("x").over(w).alias("x1"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    whole = s.filter("c = size").select(*keys, F.col("line").alias("y"), F.col("x").alias("x0"), "x1")
    widest = R.merge_runs(whole, tuple(keys)).groupBy(*keys).agg(F.max(F.col("x1") - F.col("x0")).cast("bigint").alias("room"))
    by_line = F.array_sort(F.collect_list(F.struct("line", "room")))
    return widest.groupBy(*RK, "size").agg(F.transform(by_line, lambda x: x["room"]).alias("rooms"))


def upto(widths: Column) -> Column:
    """Width of the first 0, 1, 2, ... words with a space after each."""
    total = lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + w + SPACE_W)
    return F.aggregate(widths, F.array(F.lit(0).cast("bigint")), total)


def words_held(ends: Column, rooms: Column, size: Column) -> Column:
    """How many words of a text lines of the widths ``rooms`` hold, each as many as it can.

    ``ends`` is :func:`upto` of the text; the word after a line is the last one whose end is within reach, so a line is
    one search, whatever it holds. A line too short for the next word stays empty.
    """

    def line(at, room):
        reach = F.get(ends, at) + F.floor(room * 1000 / size) + SPACE_W
        return F.greatest(at, F.size(F.filter(ends, lambda e: e <= reach)) - 1)

    return F.aggregate(rooms, F.lit(0), line)


def shape_budgets(mask: DataFrame, regions: DataFrame, cap: Column, low: Column) -> DataFrame:
    """``keys, cap, soft, hard, word_soft, word_hard`` of regions with a mask of their own.

    As :func:`texts.region_budgets`, for a shape instead of a box: characters of the filler text and letters of one word
    that fit at the wanted size, and at the smallest. What fits at a size fits at smaller ones, so the figures of the
    smallest size are at least those of the wanted one. A region without a mask, or too low for a line, holds nothing.
    """
    words = X.FILLER.split()
    filler = upto(F.array(*[F.lit(sum_width(w)).cast("bigint") for w in words]))
    chars = [0]
    for w in words:
        chars.append(chars[-1] + len(w) + (chars[-1] > 0))
    letters = [sum_width(X.LONG_WORD[:n]) for n in range(2, 25)]
    r = regions.select(*RK, cap.cast("int").alias("cap"), F.least(low, cap).cast("int").alias("low"))
    sizes = r.select(*RK, F.explode(F.array_distinct(F.array("cap", "low"))).alias("size"))
    # Equal shapes are filled once; the filler's ends are bound once a row by the outer one-element transform.
    rooms = line_rooms(mask, sizes)
    held = F.transform(F.array(filler), lambda ends: words_held(ends, F.col("rooms"), F.col("size")))[0]
    widest = F.floor(F.array_max("rooms") * 1000 / F.col("size"))
    fitting = F.size(F.filter(F.array(*[F.lit(w) for w in letters]), lambda w: w <= widest))
    figures = rooms.select("size", "rooms").distinct().select(
        "size", "rooms", F.get(F.array(*[F.lit(n) for n in chars]), held).alias("chars"), F.when(fitting > 0, fitting + 1).otherwise(0).alias("word"))
    at = rooms.join(figures, ["size", "rooms"]).select(*RK, "size", "chars", "word")
    for name, size in (("soft", "cap"), ("hard", "low")):
        mine = at.select(*RK, F.col("size").alias(size), F.col("chars").alias(name), F.col("word").alias(f"word_{name}"))
        r = r.join(mine, [*RK, size], "left").na.fill(0, [name, f"word_{name}"])
    best = lambda n: F.greatest(f"{n}hard", f"{n}soft").alias(f"{n}hard")
    return r.select(*RK, "cap", "soft", best(""), "word_soft", best("word_"))


def shape_sizes(texts: DataFrame, mask: DataFrame, lo: int, hi: int) -> DataFrame:
    """The largest size from ``lo`` to ``hi`` at which each text (``keys, text``) fits the shape of its region, 0 if none.

    Lines of every size are laid from the top of the shape. An empty text fits every shape that has a line.
    """
    words = F.filter(F.split("text", f"{X.SPACE}+"), lambda w: w != "")
    regions = texts.select(*RK).distinct()
    rooms = line_rooms(mask, regions.select(*RK, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("size")))
    shapes = rooms.groupBy(*RK).agg(F.collect_list(F.struct("size", "rooms")).alias("shapes"))
    t = texts.withColumn("ends", upto(F.transform(words, lambda w: width_of(w).cast("bigint")))).join(shapes, RK, "left")
    fit = F.filter("shapes", lambda s: words_held(F.col("ends"), s["rooms"], s["size"]) == F.size("ends") - 1)
    return t.select(*texts.columns, F.coalesce(F.array_max(F.transform(fit, lambda s: s["size"])), F.lit(0)).alias("best_size"))

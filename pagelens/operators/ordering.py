"""Ordering, banding and grouping of boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import geometry as G
from pagelens.operators.boxes import overlap_join
from pagelens.operators.graph import components
from pagelens.operators.grouping import GROUP_LIMIT, Scan, down, ranked, scan, split_hot
from pagelens.session import materialize, written

PAIR_LIMIT = 5_000


def reading_order(regions: DataFrame, rtl: bool = True, limit: int = GROUP_LIMIT) -> DataFrame:
    """Adds ``row_no`` and ``idx`` (from 0): rows top to bottom, boxes right to left inside a row.

    Row anchors depend only on the distinct ``y1`` values of a page, which its height bounds, so
    they fold from one small array per page; boxes then find their row by counting anchors.
    """
    h = F.col("y2") - F.col("y1")
    pages = regions.groupBy("page_id").agg(
        F.greatest((F.median(h) * F.lit(1.3)).cast("int"), F.lit(20)).alias("band"),
        F.sort_array(F.collect_set("y1")).alias("ys"),
    )
    anchors = F.aggregate(
        "ys", F.slice("ys", 1, 0),
        lambda acc, y: F.when((F.size(acc) > 0) & (y - F.element_at(acc, -1) < F.col("band")), acc).otherwise(F.array_append(acc, y)),
    )
    rows = regions.join(pages.select("page_id", anchors.alias("anchors")), "page_id")
    rows = rows.withColumn("row_no", F.size(F.filter("anchors", lambda a: a <= F.col("y1"))) - 1).drop("anchors")
    side = down(F.col("x1")) if rtl else F.col("x1")
    order = [F.col("row_no"), side, F.col("y1"), F.col("det_id")]
    return ranked(rows, ["page_id"], order, "idx", limit).withColumn("idx", F.col("idx") - 1)


def panels(regions: DataFrame) -> DataFrame:
    """Adds ``panel``: a new one starts where ``y1`` lies more than the gap below everything above."""
    h = F.col("y2") - F.col("y1")
    gap = regions.groupBy("page_id").agg(F.greatest((F.median(h) * F.lit(0.6)).cast("int"), F.lit(20)).alias("gap"))
    # One row per distinct y1: within equal tops the first box decides, the rest never starts a panel.
    tops = regions.groupBy("page_id", "y1").agg(F.max("y2").alias("bottom")).join(gap, "page_id")
    w = Window.partitionBy("page_id").orderBy("y1")
    above = F.greatest(F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = tops.withColumn("above", above).withColumn(
        "start", F.when(F.col("y1") - F.col("above") > F.col("gap"), 1).otherwise(0)
    )
    first = F.row_number().over(w) == 1
    marked = marked.withColumn("start", F.when(first, 0).otherwise(F.col("start")))
    panel = F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return regions.join(marked.select("page_id", "y1", panel.alias("panel")), ["page_id", "y1"])


def overlap_links(boxes: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges ``page_id, a, b`` that connect exactly the boxes chained by positive-area overlap.

    Ordinary pages list overlapping pairs. On larger pages each box is cut into pixel rows and
    every row is swept once: boxes of one unbroken interval are linked to its first box, so the
    number of edges grows with the boxes, not with their pairs.
    """
    box = boxes.select("page_id", F.col("det_id").alias("id"), "x1", "y1", "x2", "y2")
    cold, hot = split_hot(box, ["page_id"], limit)
    edges = overlap_join(cold, cold).filter("a_id < b_id").select("page_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    if hot is None:
        return edges
    rows = hot.filter("x2 > x1 and y2 > y1").select("page_id", "id", "x1", "x2", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"))
    order = [F.col("x1"), F.col("id")]
    swept = scan(rows, ["page_id", "y"], order, [Scan("reach", "max_before", "x2")])
    swept = swept.withColumn("start", F.when(F.col("reach").isNull() | (F.col("x1") >= F.col("reach")), 1).otherwise(0))
    swept = scan(swept, ["page_id", "y"], order, [Scan("island", "sum", "start")])
    head = swept.groupBy("page_id", "y", "island").agg(F.min("id").alias("a"))
    sweep = swept.join(head, ["page_id", "y", "island"]).filter("a <> id").select("page_id", "a", F.col("id").alias("b"))
    return edges.unionByName(sweep.distinct())


def overlap_groups(boxes: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """``page_id, det_id, grp`` for boxes in groups of two or more; ``grp`` is the lowest det_id."""
    nodes = boxes.select("page_id", F.col("det_id").alias("node"))
    links = materialize(overlap_links(boxes, limit), "links")
    ends = links.select("page_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    found = components(nodes.join(ends, ["page_id", "node"], "left_semi"), links, ["page_id"])
    return found.select("page_id", F.col("node").alias("det_id"), F.col("label").alias("grp"))


def merge_boxes(boxes: DataFrame, pad: int = 0, limit: int = PAIR_LIMIT) -> DataFrame:
    """Bounding boxes of padded boxes, merged until none overlap.

    The closure does not depend on the order of merging. A round labels whole chains of overlapping
    boxes and takes each chain's bounding box; pages without any overlap left drop out.
    """
    now = boxes.select(
        "page_id", "det_id", (F.col("x1") - pad).alias("x1"), (F.col("y1") - pad).alias("y1"),
        (F.col("x2") + pad).alias("x2"), (F.col("y2") + pad).alias("y2"),
    )
    now, done = materialize(now, "boxes"), []
    while True:
        chain = materialize(overlap_groups(now, limit), "chains")
        busy = chain.select("page_id").distinct()
        done.append(now.join(busy, "page_id", "left_anti"))
        if chain.isEmpty():
            return reduce(DataFrame.unionByName, done)
        merged = now.join(busy, "page_id", "left_semi").join(chain, ["page_id", "det_id"], "left").groupBy(
            "page_id", F.coalesce("grp", "det_id").alias("det_id")
        ).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
        now = materialize(merged, "boxes")


def split_shared_parents(assigned: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Cut a container shared by several regions into one slice per region.

    The axis with the larger spread of centres is cut (ties horizontal). The chained rule
    ``cut = max(gap, previous cut + 4)`` unrolls to a running maximum of ``gap - 4*i``, so slices
    come from ordinary running columns. Adds ``shared`` and overwrites ``parent_*``.
    """
    assigned = written(assigned, "assigned")
    P = ["parent_x1", "parent_y1", "parent_x2", "parent_y2"]
    keys = ["page_id", *P]
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    owned = assigned.filter(F.col("parent_x1").isNotNull())
    spread = owned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), ((F.max(cx) - F.min(cx)) >= (F.max(cy) - F.min(cy))).alias("horizontal")
    ).filter("n >= 2")
    df = owned.join(spread, keys).withColumns({
        "lo": F.when(F.col("horizontal"), F.col("x1")).otherwise(F.col("y1")),
        "hi": F.when(F.col("horizontal"), F.col("x2")).otherwise(F.col("y2")),
        "mid": F.when(F.col("horizontal"), cx).otherwise(cy),
        "base": F.when(F.col("horizontal"), F.col("parent_x1")).otherwise(F.col("parent_y1")),
    }).withColumn("me", F.struct("lo", "hi", "mid"))
    df = materialize(df, "shared")
    order = [F.col("mid"), F.col("det_id")]
    df = scan(df, keys, order, [Scan("rank", "row_number"), Scan("next", "lead", "me")], limit)
    nxt = F.col("next")
    gap = F.when(F.col("hi") < nxt["lo"], F.floor((F.col("hi") + nxt["lo"]) / 2).cast("int")).otherwise(
        ((F.col("mid") + nxt["mid"]) / 2).cast("int")
    )
    i = F.col("rank") - 1
    df = df.withColumn("slack", (gap - 4 * i).cast("bigint")).drop("me", "next")
    df = scan(df, keys, order, [Scan("before", "max_before", "slack")], limit)
    floor_ = F.col("base") + 4
    prev = F.when(i == 0, F.col("base")).otherwise(4 * (i - 1) + F.greatest(floor_, F.col("before")))
    cut = 4 * i + F.greatest(floor_, F.col("before"), F.col("slack"))
    last = F.col("rank") == F.col("n")
    h = F.col("horizontal")
    done = df.select("page_id", "det_id", F.lit(True).alias("shared"), *[c.cast("int").alias("s_" + n) for n, c in {
        "parent_x1": F.when(h, prev).otherwise(F.col("parent_x1")),
        "parent_y1": F.when(h, F.col("parent_y1")).otherwise(prev),
        "parent_x2": F.when(h & ~last, cut).otherwise(F.col("parent_x2")),
        "parent_y2": F.when(~h & ~last, cut).otherwise(F.col("parent_y2")),
    }.items()])
    out = assigned.join(done, ["page_id", "det_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    return out.withColumns({c: F.coalesce("s_" + c, c) for c in P}).drop(*["s_" + c for c in P])


def glyph_lines(glyphs: DataFrame, reach: int = 26, overlap: float = 0.45, least: int = 3) -> DataFrame:
    """Text lines of three or more glyph boxes, with cap height (median of the tallest third).

    Glyphs join the first line they overlap vertically and touch horizontally. Lines never reach
    across an empty horizontal strip or a gap wider than ``reach``, so the page is first cut into
    such blocks and only a block is folded.
    """
    keys = ["page_id"]
    by_y = [F.col("y1"), F.col("x1"), F.col("det_id")]
    df = scan(glyphs, keys, by_y, [Scan("above", "max_before", "y2")])
    df = df.withColumn("new", F.when(F.col("above").isNull() | (F.col("y1") >= F.col("above")), 1).otherwise(0))
    df = scan(df, keys, by_y, [Scan("strip", "sum", "new")]).drop("above", "new")
    keys, by_x = ["page_id", "strip"], [F.col("x1"), F.col("y1"), F.col("det_id")]
    df = scan(df, keys, by_x, [Scan("left", "max_before", "x2")])
    df = df.withColumn("new", F.when(F.col("left").isNull() | (F.col("x1") > F.col("left") + reach), 1).otherwise(0))
    df = scan(df, keys, by_x, [Scan("block", "sum", "new")])
    item = F.struct("y1", "x1", "det_id", "x2", "y2")
    blocks = df.groupBy("page_id", "strip", "block").agg(F.array_sort(F.collect_list(item)).alias("g"))

    def start(g) -> Column:
        return F.struct(g["x1"].alias("x1"), g["y1"].alias("y1"), g["x2"].alias("x2"), g["y2"].alias("y2"),
                        F.array(g["y2"] - g["y1"]).alias("hs"), g["det_id"].alias("line_id"))

    def fits(ln, g) -> Column:
        both = F.least(g["y2"], ln["y2"]) - F.greatest(g["y1"], ln["y1"])
        return (both > overlap * F.least(g["y2"] - g["y1"], ln["y2"] - ln["y1"])) & (g["x1"] >= ln["x1"] - reach) & (g["x1"] <= ln["x2"] + reach)

    def widen(ln, g) -> Column:
        return F.struct(
            F.least(ln["x1"], g["x1"]).alias("x1"), F.least(ln["y1"], g["y1"]).alias("y1"),
            F.greatest(ln["x2"], g["x2"]).alias("x2"), F.greatest(ln["y2"], g["y2"]).alias("y2"),
            F.array_append(ln["hs"], g["y2"] - g["y1"]).alias("hs"), ln["line_id"].alias("line_id"),
        )

    def step(acc, g) -> Column:
        hit = F.array_position(F.transform(acc, lambda ln: fits(ln, g)), True).cast("int")
        joined = F.transform(acc, lambda ln, i: F.when(i == hit - 1, widen(ln, g)).otherwise(ln))
        return F.when(hit > 0, joined).otherwise(F.array_append(acc, start(g)))

    empty = F.slice(F.transform("g", start), 1, 0)
    lines = blocks.select("page_id", F.inline(F.aggregate("g", empty, step))).filter(F.size("hs") >= least)
    tall = F.sort_array("hs")
    n = F.greatest(F.lit(2), F.floor(F.size("hs") / 3).cast("int"))
    top = F.slice(tall, F.size("hs") - n + 1, n)
    lo, hi = F.element_at(top, F.floor((n + 1) / 2).cast("int")), F.element_at(top, F.floor((n + 2) / 2).cast("int"))
    return lines.select("page_id", "line_id", "x1", "y1", "x2", "y2", F.size("hs").cast("bigint").alias("glyphs"), ((lo + hi) / 2).alias("cap_height"))


def pair_frames(a: DataFrame, b: DataFrame, heights: DataFrame) -> DataFrame:
    """Pair two frames' regions by reading order after scaling ``b`` by the height ratio."""
    side = lambda df, n: df.select(
        "page_id", "idx", F.col("det_id").alias(n + "_id"), F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias(n + "_side")
    )
    scale = F.col("ha") / F.col("hb")
    return side(a, "a").join(side(b, "b"), ["page_id", "idx"]).join(heights, "page_id").select(
        "page_id", "idx", "a_id", "b_id", scale.alias("scale"), (F.col("a_side") - F.col("b_side") * scale).alias("side_diff")
    )

"""Box projections, filters and spatial joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import geometry as G
from pagelens.operators.grouping import down, split_hot, top_k
from pagelens.session import materialize, written
from pagelens.settings import SETTINGS

#: Cells of a level of the grid are ``2 ** STEP_BITS`` times as wide as those of the level below.
STEP_BITS = 2
#: Boxes of one side in a cell that one task compares with one part of the other side.
CELL_PART = 4000
#: Pages with no more boxes than this on a side need no finer cells than their largest box does.
FEW = 200
FOLD_LIMIT = 1000


# ---------------------------------------------------------------- projections and filters


def with_box_measures(boxes: DataFrame) -> DataFrame:
    c = G.sides()
    return boxes.select(
        "*",
        (c["x2"] - c["x1"]).alias("width"),
        (c["y2"] - c["y1"]).alias("height"),
        G.area(c["x1"], c["y1"], c["x2"], c["y2"]).alias("area"),
        ((c["x1"] + c["x2"]) / 2).alias("cx"),
        ((c["y1"] + c["y2"]) / 2).alias("cy"),
    )


def clip_boxes(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """Clip to the page frame; runs before suppression."""
    joined = boxes.join(frames.select("page_id", "w", "h"), "page_id")
    fit = {c: G.clamp(F.col(c), F.lit(0), F.col("w" if c[0] == "x" else "h")) for c in ("x1", "y1", "x2", "y2")}
    return joined.withColumns(fit).drop("w", "h")


def truncate_boxes(boxes: DataFrame) -> DataFrame:
    """Truncate to whole pixels and drop sides under four; runs after suppression."""
    whole = boxes.withColumns({c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")})
    return whole.filter((F.col("x2") - F.col("x1") >= 4) & (F.col("y2") - F.col("y1") >= 4))


def tile_plan(frames: DataFrame, overlap: float = SETTINGS.tile_overlap) -> DataFrame:
    """Four overlapping tiles for every page whose longer side passes the gate."""
    share = F.lit(0.5 + overlap)
    sized = frames.filter(F.greatest("w", "h") > SETTINGS.tile_gate).select(
        "page_id", "w", "h", (F.col("w") * share).cast("int").alias("tw"), (F.col("h") * share).cast("int").alias("th")
    )
    spots = F.array(*[F.struct(F.lit(2 * j + i).alias("tile"), F.lit(i).alias("i"), F.lit(j).alias("j"))
                      for j in (0, 1) for i in (0, 1)])
    return sized.select("*", F.explode(spots).alias("s")).select(
        "page_id", F.col("s.tile").alias("tile"),
        (F.col("s.i") * (F.col("w") - F.col("tw"))).alias("ox"),
        (F.col("s.j") * (F.col("h") - F.col("th"))).alias("oy"),
        "tw", "th", "w", "h",
    )


def drop_cut_boxes(dets: DataFrame, tiles: DataFrame, margin: float = SETTINGS.tile_margin) -> DataFrame:
    """Tile-local boxes that do not touch an inner tile edge; keeps the tile offsets."""
    j = dets.join(tiles, ["page_id", "tile"])
    cut = (
        ((F.col("ox") > 0) & (F.col("x1") <= margin))
        | ((F.col("oy") > 0) & (F.col("y1") <= margin))
        | ((F.col("ox") + F.col("tw") < F.col("w")) & (F.col("x2") >= F.col("tw") - margin))
        | ((F.col("oy") + F.col("th") < F.col("h")) & (F.col("y2") >= F.col("th") - margin))
    )
    return j.filter(~cut).select(*dets.columns, "ox", "oy")


def merge_passes(full: DataFrame, tiled: DataFrame) -> DataFrame:
    """Full-page detections plus tile detections moved to page coordinates."""
    moved = tiled.withColumns({c: F.col(c) + F.col("ox" if c[0] == "x" else "oy") for c in ("x1", "y1", "x2", "y2")})
    return full.unionByName(moved.select(*full.columns))


def with_font_bounds(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    j = boxes.join(frames.select("page_id", "w"), "page_id")
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return j.select(
        *boxes.columns,
        G.min_font(F.col("w")).alias("font_floor"),
        G.font_cap(side, F.col("w")).alias("font_cap"),
        G.emergency_floor(F.col("w")).alias("emergency_floor"),
    )


def with_stroke_params(boxes: DataFrame, glyph: Column) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.select(
        "*", (h > w * F.lit(1.6)).alias("is_vertical"), G.stroke_px(glyph).alias("stroke"), G.kernel_px(glyph).alias("kernel")
    )


def grow_boxes(boxes: DataFrame, frames: DataFrame, min_side: int = 192, pad: int = 0) -> DataFrame:
    """Pad, then grow each side to ``min_side`` around its middle, clipped to the page, in two passes."""
    df = boxes.join(frames.select("page_id", "w", "h"), "page_id").withColumns(
        {c: F.col(c) + (pad if c[1] == "2" else -pad) for c in ("x1", "y1", "x2", "y2")}
    )
    for _ in range(2):
        step = {}
        for axis, page in (("x", "w"), ("y", "h")):
            lo, hi = F.col(axis + "1"), F.col(axis + "2")
            lack = F.greatest(F.lit(min_side) - (hi - lo), F.lit(0))
            left = F.floor(lack / 2).cast("int")
            step[axis + "1"] = F.greatest(lo - left, F.lit(0))
            step[axis + "2"] = F.least(hi + lack - left, F.col(page))
        df = df.withColumns(step)
    return df.drop("w", "h")


def search_windows(boxes: DataFrame, frames: DataFrame, share: float = 0.40) -> DataFrame:
    """Window grown by ``share`` of each side, clipped to the page."""
    df = boxes.join(frames.select("page_id", "w", "h"), "page_id")
    mx = ((F.col("x2") - F.col("x1")) * F.lit(share)).cast("int")
    my = ((F.col("y2") - F.col("y1")) * F.lit(share)).cast("int")
    zero = F.lit(0)
    return df.select(
        *boxes.columns,
        F.greatest(F.col("x1") - mx, zero).alias("wx1"), F.greatest(F.col("y1") - my, zero).alias("wy1"),
        F.least(F.col("x2") + mx, F.col("w")).alias("wx2"), F.least(F.col("y2") + my, F.col("h")).alias("wy2"),
    )


# ---------------------------------------------------------------- spatial join


def _level(c: dict[str, Column]) -> Column:
    """Level of a box: its longer side fits a cell of that level, so it touches at most four of them."""
    side = F.greatest(c["x2"] - c["x1"], c["y2"] - c["y1"]).cast("double")
    return F.greatest(F.ceil(F.log2(side) / STEP_BITS), F.lit(0)).cast("int")


def _listed(df: DataFrame, prefix: str, home: int, own: list[int], other: list[int]) -> DataFrame:
    """A box in the cells it touches: at home on its own level, as a visitor on coarser levels that the other side lives on.

    Boxes of unequal levels meet where the larger one is at home. ``home`` is the role of this side's homes, so that the
    other side's visitors carry it as well; boxes of equal level meet once, in role 0.
    """
    c = G.sides(prefix)
    solid = df.filter((c["x2"] > c["x1"]) & (c["y2"] > c["y1"])).withColumn("_own", F.lit(own[0]) if len(own) == 1 else _level(c))
    at = lambda role, level: F.struct(F.lit(role).alias("role"), F.lit(1 << STEP_BITS * level).cast("bigint").alias("wide"))
    roles = F.lit(None).cast("array<struct<role:int,wide:bigint>>")
    for level in own:  # the second side's homes also meet visitors of their own level
        visits = [at(1 - home, o) for o in other if o > level or (home and o == level)]
        roles = F.when(F.col("_own") == level, F.array(at(home, level), *visits)).otherwise(roles)
    w = F.col("_r.wide")
    low = {a: F.floor(c[f"{a}1"] / w) for a in "xy"}
    n = {a: F.ceil(c[f"{a}2"] / w) - low[a] for a in "xy"}
    each = solid.withColumn("_r", F.explode(roles)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), n["x"] * n["y"] - 1)))
    return each.select(
        *df.columns, "_r.role", "_r.wide", (low["x"] + F.col("_i") % n["x"]).alias("cell_x"), (low["y"] + F.floor(F.col("_i") / n["x"])).alias("cell_y"))


def _census(df: DataFrame, keys: list[str]) -> tuple[list[int], int]:
    """Levels that boxes live on, at most half as many as a coordinate has binary digits, and a bound on the boxes of one cell."""
    c = G.sides()
    solid = df.filter((c["x2"] > c["x1"]) & (c["y2"] > c["y1"])).select(*keys, _level(c).alias("level"))
    n = solid.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("n"))
    levels, most = n.agg(F.collect_set("level"), F.max("n")).first()
    return sorted(levels), len(levels) * (most or 0)


def _dealt(left: DataFrame, right: DataFrame, where: list[str], part: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``lp, rp``: a cell of more than ``part`` boxes on a side is cut into parts, every part meeting every other."""
    count = lambda df, n: df.groupBy(*where).agg(F.count(F.lit(1)).alias(n))
    both = count(left, "n").filter(F.col("n") > part).join(count(right, "m"), where, "full_outer")
    both = both.filter((F.coalesce("n", F.lit(0)) > part) | (F.coalesce("m", F.lit(0)) > part))
    full = materialize(both.select(*where, F.ceil(F.coalesce("n", F.lit(1)) / part).alias("ln"), F.ceil(F.coalesce("m", F.lit(1)) / part).alias("rn")), "full-cells")
    ln, rn = F.coalesce("ln", F.lit(1)), F.coalesce("rn", F.lit(1))

    def spread(df: DataFrame, own: Column, other: Column, mine: str, theirs: str) -> DataFrame:
        nth = F.pmod(F.xxhash64(*df.columns), own).cast("int")
        return df.join(full, where, "left").withColumn(mine, nth).withColumn(theirs, F.explode(F.sequence(F.lit(0), (other - 1).cast("int")))).drop("ln", "rn")

    return spread(left, ln, rn, "lp", "rp"), spread(right, rn, ln, "rp", "lp")


def overlap_join(a: DataFrame, b: DataFrame, keys=("page_id",), part: int = CELL_PART) -> DataFrame:
    """Pairs of boxes with positive-area overlap: equi join on page, level and cell of a hierarchical grid.

    A box lives on the level of its size and visits the coarser levels of the other side's boxes; small boxes never
    share a cell with others far from them, and large ones are not listed in many small cells. A pair is kept only in the
    cell that holds the top-left corner of its intersection, so each pair appears once. Cells with more than ``part`` boxes
    are dealt over tasks, part against part. Columns come back prefixed ``a_`` / ``b_``, with ``inter``, ``iou`` and
    ``contain``.
    """
    keys = list(keys)
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(p + c) for c in df.columns if c not in keys])
    same = b is a
    a = written(a, "boxes")
    b = a if same else written(b, "boxes")
    of_a, most_a = _census(a, keys)
    of_b, most_b = (of_a, most_a) if same else _census(b, keys)
    crowded = max(most_a, most_b) > part
    if of_a and of_b and max(most_a, most_b) <= FEW:
        of_a = of_b = [max(*of_a, *of_b)]
    left = _listed(side(a, "a_"), "a_", 0, of_a, of_b)
    right = _listed(side(b, "b_"), "b_", 1, of_b, of_a)
    where = [*keys, "role", "wide", "cell_x", "cell_y"]
    at = where
    if crowded:
        left, right = _dealt(left, right, where, part)
        at = [*where, "lp", "rp"]
    sa, sb = G.sides("a_"), G.sides("b_")
    x, y = F.greatest(sa["x1"], sb["x1"]), F.greatest(sa["y1"], sb["y1"])
    own = (F.floor(x / F.col("wide")) == F.col("cell_x")) & (F.floor(y / F.col("wide")) == F.col("cell_y"))
    meets = (F.least(sa["x2"], sb["x2"]) > x) & (F.least(sa["y2"], sb["y2"]) > y)
    i = G.inter(sa, sb)
    area_a, area_b = G.box_area(sa), G.box_area(sb)
    return (
        left.join(right, at)
        .filter(meets & own)
        .drop(*at[len(keys):])
        .withColumns({
            "inter": i,
            "iou": i / F.greatest(area_a + area_b - i, F.lit(1)),
            "contain": i / F.greatest(F.least(area_a, area_b), F.lit(1)),
        })
    )


def box_pairs(a: DataFrame, b: DataFrame, min_inter: int = 1) -> DataFrame:
    return overlap_join(a, b).filter(F.col("inter") >= min_inter)


# ---------------------------------------------------------------- suppression


def suppress(dets: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Greedy suppression in (score desc, det_id) order, containers and text separately.

    Small pages fold their sorted boxes in one expression; a page over ``fold_limit`` settles in
    rounds through the grid join.
    """
    parent = F.col("cls") == 0
    tagged = dets.withColumns({
        "grp": F.when(parent, 0).otherwise(1),
        "t": F.when(parent, SETTINGS.parent_iou).otherwise(SETTINGS.text_iou),
        "c": F.when(parent, SETTINGS.parent_contain).otherwise(0.0),
    })
    cold, hot = split_hot(tagged, ["page_id", "grp"], fold_limit)
    kept = _fold_survivors(cold)
    if hot is not None:
        kept = kept.unionByName(_suppress_large(hot, fold_limit))
    return kept.select(*dets.columns)


def _fold_survivors(tagged: DataFrame) -> DataFrame:
    rest = [c for c in tagged.columns if c not in ("page_id", "grp", "score", "det_id", "x1", "y1", "x2", "y2", "t", "c")]
    item = F.struct((-F.col("score")).alias("neg"), *[F.col(c) for c in ("det_id", "x1", "y1", "x2", "y2", "t", "c", "score", *rest)])
    pages = tagged.groupBy("page_id", "grp").agg(F.array_sort(F.collect_list(item)).alias("boxes"))
    empty = F.slice(F.col("boxes"), 1, 0)
    kept = F.aggregate(
        "boxes", empty,
        lambda acc, b: F.when(F.exists(acc, lambda a: G.suppresses(a, b, b["t"], b["c"])), acc).otherwise(F.array_append(acc, b)),
    )
    return pages.select("page_id", "grp", F.inline(kept)).select(*tagged.columns)


def _suppress_large(hot: DataFrame, batch: int) -> DataFrame:
    """The same survivors without folding a page.

    Boxes without area overlap nothing and all survive; of equal boxes with area only the best can. The
    best ``batch`` of a page fold among themselves and clear what they overlap. What is left settles in
    rounds: every box that no open box outranks and suppresses survives at once, and removes its losers.
    """
    keys = ["page_id", "grp"]
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    hot = written(hot, "boxes")
    other = [c for c in hot.columns if c not in (*keys, "x1", "y1", "x2", "y2")]
    best = F.min_by(F.struct(*other), F.struct(-F.col("score"), F.col("det_id"))).alias("o")
    rest = hot.filter(~flat).groupBy(*keys, "x1", "y1", "x2", "y2").agg(best).select(*keys, "x1", "y1", "x2", "y2", "o.*").select(*hot.columns)
    rest = materialize(rest, "boxes")
    head = top_k(rest, keys, [down(F.col("score")), F.col("det_id")], batch).drop("rank")
    survivors = materialize(_fold_survivors(head.select(*hot.columns)), "survivors")
    parts = [hot.filter(flat), survivors]
    box = [*keys, "det_id", "x1", "y1", "x2", "y2"]
    a, b = G.sides("a_"), G.sides("b_")
    lost = overlap_join(rest.select(*box, "t", "c"), survivors.select(*box), keys).filter(G.suppresses(b, a, F.col("a_t"), F.col("a_c")))
    settled = lost.select(*keys, F.col("a_det_id").alias("det_id")).union(head.select(*keys, "det_id")).distinct()
    rest = materialize(rest.join(settled, [*keys, "det_id"], "left_anti"), "boxes")
    ranks = (F.col("b_score") > F.col("a_score")) | ((F.col("b_score") == F.col("a_score")) & (F.col("b_det_id") < F.col("a_det_id")))
    edges = overlap_join(rest.select(*box, "score", "t", "c"), rest.select(*box, "score"), keys).filter(ranks & G.suppresses(b, a, F.col("a_t"), F.col("a_c")))
    edges = materialize(edges.select(*keys, F.col("b_det_id").alias("over"), F.col("a_det_id").alias("under")), "outranked")
    while not rest.isEmpty():
        free = materialize(rest.join(edges.withColumnRenamed("under", "det_id"), [*keys, "det_id"], "left_anti"), "survivors")
        parts.append(free)
        gone = edges.join(free.select(*keys, F.col("det_id").alias("over")), [*keys, "over"], "left_semi").select(*keys, F.col("under").alias("det_id")).distinct()
        out = materialize(free.select(*keys, "det_id").union(gone.select(*keys, "det_id")), "settled")
        rest = materialize(rest.join(out, [*keys, "det_id"], "left_anti"), "boxes")
        edges = materialize(
            edges.join(out.withColumnRenamed("det_id", "over"), [*keys, "over"], "left_anti")
            .join(out.withColumnRenamed("det_id", "under"), [*keys, "under"], "left_anti").select(*keys, "over", "under"), "outranked")
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- nested duplicates


def merge_nested(regions: DataFrame, contain: float = SETTINGS.nested_contain, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """A box nesting exactly one smaller box absorbs it and widens to the union.

    Pairs settle in (inner, outer) order and nesting is judged on the original boxes. Adds
    ``absorbed``, the number of boxes merged into the survivor.
    """
    regions = written(regions, "regions")
    box = regions.select("page_id", F.col("det_id").alias("id"), "x1", "y1", "x2", "y2")
    a, b = G.sides("a_"), G.sides("b_")
    inside = (
        (F.col("a_id") != F.col("b_id"))
        & (G.box_area(a) <= G.box_area(b))
        & (F.col("inter") / G.box_area(a) >= contain)
    )
    pairs = (
        overlap_join(box, box).filter(inside)
        .groupBy("page_id", F.col("b_id").alias("outer"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("a_id").alias("inner"))
        .filter("n = 1").select("page_id", "inner", "outer")
    )
    pairs = materialize(pairs, "nested")
    cold, hot = split_hot(pairs, ["page_id"], fold_limit)
    links = _fold_links(cold)
    if hot is not None:
        links = links.unionByName(_settle_links(hot))
    root = _roots(materialize(links, "absorbed"))
    tagged = regions.join(root.withColumnRenamed("inner", "det_id"), ["page_id", "det_id"], "left")
    home = F.coalesce(F.col("root"), F.col("det_id"))
    keep = [c for c in regions.columns if c not in ("page_id", "x1", "y1", "x2", "y2")]
    own = F.max(F.when(F.col("root").isNull(), F.struct(*keep))).alias("o")
    return tagged.groupBy("page_id", home.alias("home")).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        own, (F.count(F.lit(1)) - 1).alias("absorbed"),
    ).select(*[F.col("o." + c) if c in keep else F.col(c) for c in regions.columns], "absorbed")


def _fold_links(pairs: DataFrame) -> DataFrame:
    """Accepted absorptions per page, as one ordered fold."""
    page = pairs.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("inner", "outer"))).alias("p"))
    gone = lambda acc, v: F.exists(acc, lambda x: x["inner"] == v)
    done = F.aggregate(
        "p", F.slice("p", 1, 0),
        lambda acc, e: F.when(gone(acc, e["inner"]) | gone(acc, e["outer"]), acc).otherwise(F.array_append(acc, e)),
    )
    return page.select("page_id", F.inline(done)).select("page_id", "inner", "outer")


def _settle_links(pairs: DataFrame) -> DataFrame:
    """The same decisions without folding a page: a pair settles once it is first at both its ends."""
    rest, parts = pairs, []
    while not rest.isEmpty():
        at = F.struct(F.col("inner").alias("i"), F.col("outer").alias("o"))
        ends = rest.select("page_id", F.explode(F.array("inner", "outer")).alias("v"), at.alias("at"))
        first = ends.groupBy("page_id", "v").agg(F.min("at").alias("first"))
        f1 = first.select("page_id", F.col("v").alias("inner"), F.col("first").alias("f1"))
        f2 = first.select("page_id", F.col("v").alias("outer"), F.col("first").alias("f2"))
        won = rest.join(f1, ["page_id", "inner"]).join(f2, ["page_id", "outer"]).filter((F.col("f1") == at) & (F.col("f2") == at))
        won = materialize(won.select("page_id", "inner", "outer"), "absorbed")
        parts.append(won)
        gone = won.select("page_id", F.col("inner").alias("v"))
        rest = materialize(
            rest.join(gone.withColumnRenamed("v", "inner"), ["page_id", "inner"], "left_anti")
            .join(gone.withColumnRenamed("v", "outer"), ["page_id", "outer"], "left_anti").select("page_id", "inner", "outer"),
            "nested",
        )
    return reduce(DataFrame.unionByName, parts)


def _roots(links: DataFrame) -> DataFrame:
    """inner -> final absorber, by pointer jumping."""
    at = links.select("page_id", "inner", F.col("outer").alias("root"))
    while True:
        hop = at.select("page_id", F.col("inner").alias("root"), F.col("root").alias("up"))
        joined = at.join(hop, ["page_id", "root"], "left")
        if joined.filter(F.col("up").isNotNull()).isEmpty():
            return at
        at = materialize(joined.select("page_id", "inner", F.coalesce("up", "root").alias("root")), "roots")


# ---------------------------------------------------------------- parents and other joins


def assign_parents(regions: DataFrame, parents: DataFrame) -> DataFrame:
    """Left join each region to its container.

    Candidates cover at least 65 % of the region; among those within 5 points of the best cover
    the smallest container wins, then the first (``ord``). Text outside containers that found
    one changes class from 2 (free) to 1.
    """
    p = parents.select("page_id", "ord", "x1", "y1", "x2", "y2")
    r = regions.select("page_id", "det_id", "x1", "y1", "x2", "y2")
    a, b = G.sides("a_"), G.sides("b_")
    cover = F.col("inter") / F.greatest(G.box_area(a), F.lit(1))
    cand = overlap_join(r, p).select(
        "page_id", F.col("a_det_id").alias("det_id"), cover.alias("cover"), G.box_area(b).alias("size"),
        F.col("b_ord").alias("ord"), *[F.col("b_" + c).alias("parent_" + c) for c in ("x1", "y1", "x2", "y2")],
    ).filter(F.col("cover") >= SETTINGS.parent_cover)
    top = F.max("cover").over(Window.partitionBy("page_id", "det_id"))
    near = cand.withColumn("top", top).filter(F.col("cover") >= F.col("top") - SETTINGS.parent_slack)
    cols = ["parent_x1", "parent_y1", "parent_x2", "parent_y2"]
    best = near.groupBy("page_id", "det_id").agg(F.min(F.struct("size", "ord", *cols)).alias("m")).select(
        "page_id", "det_id", *[F.col("m." + c).alias(c) for c in cols]
    )
    out = regions.join(best, ["page_id", "det_id"], "left")
    if "cls" in regions.columns:
        out = out.withColumn("cls", F.when((F.col("cls") == 2) & F.col("parent_x1").isNotNull(), 1).otherwise(F.col("cls")))
    return out


def redetected(regions: DataFrame, found: DataFrame, iou: float = 0.25) -> DataFrame:
    """Regions a detector sees again after cleaning (left semi join on overlap)."""
    r = regions.select("page_id", "det_id", "x1", "y1", "x2", "y2")
    hits = overlap_join(r, found.select("page_id", "x1", "y1", "x2", "y2")).filter(F.col("iou") > iou)
    return regions.join(hits.select("page_id", F.col("a_det_id").alias("det_id")).distinct(), ["page_id", "det_id"], "left_semi")


def orphan_parents(parents: DataFrame, assigned: DataFrame) -> DataFrame:
    """Containers no region was assigned to, compared by their corners."""
    cols = ["x1", "y1", "x2", "y2"]
    used = assigned.filter(F.col("parent_x1").isNotNull()).select("page_id", *[F.col("parent_" + c).alias(c) for c in cols])
    return parents.join(used.distinct(), ["page_id", *cols], "left_anti")


def line_cost(dx: Column, dy: Column) -> Column:
    """Distance between text lines: vertical offsets count twice."""
    return F.abs(dx) + 2 * F.abs(dy)


def square_cost(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def nearest(targets: DataFrame, cands: DataFrame, keys=("page_id",), cost=line_cost, bound=lambda cell: cell, cell: int = 64) -> DataFrame:
    """For each target point the candidate of least ``cost`` inside the same ``keys`` (ties: lowest cand_id).

    Searches the 3x3 neighbourhood of a grid; the join feeds a partial minimum, so no pair is
    shuffled. Whatever lies outside the neighbourhood costs at least ``bound(cell)``, so a
    target with a lower cost is done. The others go on with a grid four times as coarse, until a
    cell is as wide as any key's points spread; then every candidate has been compared.
    """
    keys = list(keys)
    pool = materialize(cands.select(*keys, "cand_id", F.col("x").alias("qx"), F.col("y").alias("qy")), "cands")
    todo = targets.select(*keys, "target_id", "x", "y").join(pool.select(*keys).distinct(), keys, "left_semi")
    todo, parts = materialize(todo, "todo"), []
    points = pool.select(*keys, F.col("qx").alias("x"), F.col("qy").alias("y")).unionByName(todo.select(*keys, "x", "y"))
    spread = points.groupBy(*keys).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("s")).agg(F.max("s")).first()[0]
    while True:
        around = lambda c: F.explode(F.sequence(F.floor(c / cell) - 1, F.floor(c / cell) + 1))  # noqa: B023, E731
        left = todo.withColumn("cell_x", around(F.col("x"))).withColumn("cell_y", around(F.col("y")))
        right = pool.withColumn("cell_x", F.floor(F.col("qx") / cell)).withColumn("cell_y", F.floor(F.col("qy") / cell))
        price = cost(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))
        hit = left.join(right, [*keys, "cell_x", "cell_y"]).groupBy(*keys, "target_id").agg(
            F.min(F.struct(price.alias("cost"), F.col("cand_id"))).alias("m")
        ).select(*keys, "target_id", F.col("m.cost").alias("cost"), F.col("m.cand_id").alias("cand_id"))
        last = spread is None or cell >= spread
        found = materialize(hit if last else hit.filter(F.col("cost") < bound(cell)), "nearest")
        parts.append(found)
        if last:
            break
        todo = materialize(todo.join(found, [*keys, "target_id"], "left_anti"), "todo")
        if todo.isEmpty():
            break
        cell *= 4
    return reduce(DataFrame.unionByName, parts)


def frame_offset(edges_a: DataFrame, edges_b: DataFrame, max_shift: int = 3, split: int = 24) -> DataFrame:
    """Displacement with most agreeing edge pixels, for the whole frame and per quadrant."""
    span = range(-max_shift, max_shift + 1)
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in span for dx in span])
    quad = F.concat(F.when(F.col("y") < split, "top").otherwise("bottom"), F.when(F.col("x") < split, "-left").otherwise("-right"))
    moved = edges_a.select("page_id", "y", "x", quad.alias("quad"), F.explode(shifts).alias("s"))
    moved = moved.select("page_id", "quad", "s.dx", "s.dy", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    votes = moved.join(edges_b.select("page_id", "y", "x"), ["page_id", "y", "x"]).groupBy("page_id", "quad", "dx", "dy").count()
    total = edges_a.withColumn("quad", quad).groupBy("page_id", "quad").agg(F.count(F.lit(1)).alias("n"))
    each = lambda df, v: df.select("page_id", F.explode(F.array(F.lit("all"), F.col("quad"))).alias("part"), *v)
    votes = each(votes, ["dx", "dy", "count"]).groupBy("page_id", "part", "dx", "dy").agg(F.sum("count").alias("votes"))
    total = each(total, ["n"]).groupBy("page_id", "part").agg(F.sum("n").alias("n"))
    best = F.max(F.struct(F.col("votes"), -(F.abs("dx") + F.abs("dy")), -F.col("dy"), -F.col("dx"), F.col("dx").alias("bx"), F.col("dy").alias("by")))
    return votes.groupBy("page_id", "part").agg(best.alias("m")).join(total, ["page_id", "part"]).select(
        "page_id", "part", F.col("m.bx").alias("dx"), F.col("m.by").alias("dy"), F.col("m.votes").alias("votes"),
        (F.col("m.votes") / F.col("n")).alias("confidence"),
    )


def grid(df: DataFrame, **axes) -> DataFrame:
    """Every row with every combination of the given literal values."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df

"""Mask and grey-level jobs. Masks are run tables, rasters are ``page_id, y, x, grey``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators import runs as R
from pagelens.operators import tones as T
from pagelens.operators.distance import squared_distance
from pagelens.operators.grouping import down, ranked, top_k
from pagelens.operators.runs import RK
from pagelens.session import materialize
from pagelens.settings import SETTINGS

PX = ["page_id", "y", "x"]
#: Pixels of a row in which runs of different regions meet.
CELL = 32


def scanlines(raster: DataFrame) -> DataFrame:
    """A pixel table as ``page_id, y, x0, x1, px``: unbroken stretches of a row with their channels in one array.

    A row of a page is bounded by its width, so no stretch is large, and a raster that is kept in this
    form is read and shuffled by rows instead of pixels.
    """
    rest = [c for c in raster.columns if c not in PX]
    row = raster.groupBy("page_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", *rest))).alias("px"))
    n = F.size("px")
    x = lambda i: F.element_at("px", i)["x"]
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, True).otherwise(x(i) != x(i - 1) + 1))
    ends = F.concat(F.slice("begins", 2, n), F.array(n + 1))
    cut = F.transform(F.arrays_zip(F.col("begins").alias("a"), ends.alias("b")), lambda s: F.slice("px", s["a"], s["b"] - s["a"]))
    whole = x(n) - x(F.lit(1)) + 1 == n
    line = row.withColumn("begins", F.when(whole, F.array(F.lit(1))).otherwise(begins))
    line = line.select("page_id", "y", F.explode(F.when(whole, F.array("px")).otherwise(cut)).alias("px"))
    first, last = F.element_at("px", 1)["x"], F.element_at("px", -1)["x"]
    return line.select("page_id", "y", first.alias("x0"), (last + 1).alias("x1"), F.transform("px", lambda p: F.struct(*[p[c].alias(c) for c in rest])).alias("px"))


def values(runs: DataFrame, raster: DataFrame) -> DataFrame:
    """The raster's channels at every mask pixel; from scanlines only runs and rows meet, and pixels come up in place."""
    if "px" not in raster.columns:
        return R.to_pixels(runs).join(raster, PX)
    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    lines = raster.select("page_id", "y", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("px").alias("_px"))
    lo, hi = F.greatest("x0", "_x0"), F.least("x1", "_x1")
    j = runs.join(lines, ["page_id", "y"]).filter(lo < hi)
    at = F.posexplode(F.slice("_px", (lo - F.col("_x0") + 1).cast("int"), (hi - lo).cast("int"))).alias("_at", "_v")
    return j.select(*rest, lo.alias("_lo"), at).select(*rest, (F.col("_lo") + F.col("_at")).cast("int").alias("x"), "_v.*")


def pixels_of(raster: DataFrame) -> DataFrame:
    """The pixels of a raster in either form.

    A condition on channels stays above scanlines; over a derived raster Spark would move it into the
    expressions that make the channels and work those out again for every comparison.
    """
    if "px" not in raster.columns:
        return raster
    return raster.select("page_id", "y", "x0", F.posexplode("px").alias("_at", "_v")).select("page_id", "y", (F.col("x0") + F.col("_at")).cast("int").alias("x"), "_v.*")


def middle(runs: DataFrame, raster: DataFrame, name: str = "bg") -> DataFrame:
    """Median grey level of every region's pixels, from its histogram."""
    return T.tones(values(runs, raster), RK).select(*RK, T.median(F.col("h_grey")).alias(name))


def masked(pixels: DataFrame, cond: Column, keys=RK) -> DataFrame:
    return R.to_runs(pixels.filter(cond).select(*keys, "y", "x"), keys)


def within_page(runs: DataFrame, page: DataFrame) -> DataFrame:
    """Parts of region runs covered by (disjoint) page runs."""
    p = page.select("page_id", "y", F.col("x0").alias("p0"), F.col("x1").alias("p1"))
    hit = runs.join(p, ["page_id", "y"]).filter((F.col("x0") < F.col("p1")) & (F.col("p0") < F.col("x1")))
    return hit.select(*RK, "y", F.greatest("x0", "p0").alias("x0"), F.least("x1", "p1").alias("x1"))


def size(runs: DataFrame, keys=RK, name: str = "px") -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias(name))


# ---------------------------------------------------------------- thresholds


def otsu(pixels: DataFrame, keys) -> DataFrame:
    """Threshold of maximum between-class variance per crop (ties: lowest), from a 256-bin histogram."""
    keys = list(keys)
    hist = pixels.groupBy(*keys, "grey").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("grey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("n") * F.col("grey")
    cum = hist.select(
        *keys, "grey", F.sum("n").over(upto).alias("w0"), F.sum("n").over(w).alias("w"),
        F.sum(mass).over(upto).alias("s0"), F.sum(mass).over(w).alias("s"),
    ).filter("w0 < w")
    d = (F.col("s0") * F.col("w") - F.col("w0") * F.col("s")).cast("double")
    var = d * d / (F.col("w0") * (F.col("w") - F.col("w0"))).cast("double")
    return cum.groupBy(*keys).agg(F.max(F.struct(var.alias("v"), (-F.col("grey")).alias("g"))).alias("m")).select(
        *keys, (-F.col("m.g")).alias("threshold"), F.col("m.v").alias("variance")
    )


def smooth(pixels: DataFrame, keys) -> DataFrame:
    """3x3 Gaussian with mirrored borders, as two neighbour windows."""
    keys = list(keys)

    def axis(df, along, across):
        w = Window.partitionBy(*keys, across).orderBy(along)
        before, after = F.lag("grey").over(w), F.lead("grey").over(w)
        total = 2 * F.col("grey") + F.coalesce(before, after, F.col("grey")) + F.coalesce(after, before, F.col("grey"))
        return df.withColumn("grey", total)

    out = axis(axis(pixels, "x", "y"), "y", "x")
    return out.withColumn("grey", F.floor((F.col("grey") + 8) / 16).cast("int"))


def minority_mask(pixels: DataFrame, keys) -> DataFrame:
    """Otsu mask of the polarity with fewer pixels (ties: dark), after smoothing."""
    keys = list(keys)
    soft = smooth(pixels, keys)
    h = T.tones(soft, keys).withColumn("cut", T.otsu(F.col("h_grey"))["threshold"]).filter("cut IS NOT NULL")
    pick = h.select(*keys, F.col("cut").alias("threshold"), (2 * T.total(T.upto(F.col("h_grey"), F.col("cut"))) <= F.col("n")).alias("take_dark"))
    return soft.join(pick, keys).filter((F.col("grey") <= F.col("threshold")) == F.col("take_dark")).select(*keys, "y", "x")


def polarity(pixels: DataFrame, ink: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per region: Otsu threshold, whether the bright class must be inverted, ring background, MAD and wall.

    A ring of 9 px around the ink votes; without a ring the majority class decides by its median.
    """
    around = R.clip(R.ring(ink, 9), boxes).withColumn("part", F.lit("near"))
    crop = R.box_runs(boxes).withColumn("part", F.lit("all")).unionByName(around)
    h = T.tones(values(crop, pixels), (*RK, "part"))
    of = lambda part: F.first(F.when(F.col("part") == part, F.col("h_grey")), ignorenulls=True)
    h = h.groupBy(*RK).agg(of("all").alias("all"), F.coalesce(of("near"), F.array().cast("array<struct<v:int,n:bigint>>")).alias("near"))
    h = h.withColumn("cut", T.otsu(F.col("all"))["threshold"]).filter("cut IS NOT NULL").withColumn("bg", T.median(F.col("near")))
    g = h.select(
        *RK, F.col("cut").alias("threshold"), "bg", T.mad(F.col("near"), F.col("bg")).alias("mad"), T.total(F.col("near")).alias("ring_px"),
        T.total(T.above(F.col("near"), F.col("cut"))).alias("ring_bright"), T.total(F.col("all")).alias("n"),
        T.total(T.above(F.col("all"), F.col("cut"))).alias("nb"), T.median(T.above(F.col("all"), F.col("cut"))).alias("mb"), T.median(T.upto(F.col("all"), F.col("cut"))).alias("md"))
    flip = F.when(F.col("ring_px") > 0, F.col("ring_bright") / F.col("ring_px") < 0.5).otherwise(
        F.when(F.col("nb") < F.col("n") - F.col("nb"), F.col("md")).otherwise(F.col("mb")) < 128
    )
    wall = F.when(flip & (F.col("ring_px") > 0), F.col("bg") - F.greatest(3.0 * F.col("mad"), F.lit(20.0)))
    return g.select(*RK, "threshold", flip.alias("inverted"), "bg", "mad", wall.alias("wall"))


# ---------------------------------------------------------------- ink


def seed_grow(prob: DataFrame, pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Weak components that hold a strong pixel, plus dark Otsu pixels in a 9 px band around them."""
    weak = masked(prob, F.col("p") >= SETTINGS.grow_thresh)
    strong = masked(prob, F.col("p") >= SETTINGS.seed_thresh)
    labelled = R.label_runs(weak)
    ink = R.keep_components(labelled, R.touching(labelled, strong))
    crop = values(R.box_runs(boxes), pixels)
    few = R.to_runs(minority_mask(crop, RK))
    band = R.grow(ink, 9)
    return R.combine({"i": ink, "o": few, "b": band}, lambda c: (c["i"] > 0) | ((c["o"] > 0) & (c["b"] > 0)))


def filter_glyphs(mask: DataFrame, boxes: DataFrame) -> DataFrame:
    """Drop specks, slabs, hollow shapes and frames; a crop that would lose everything keeps it all."""
    labelled = R.label_runs(mask)
    side = boxes.select(*RK, (F.col("x2") - F.col("x1")).alias("bw"), (F.col("y2") - F.col("y1")).alias("bh"))
    s = R.component_stats(labelled).join(side, list(RK))
    box = F.col("bw") * F.col("bh")
    bad = (
        (F.col("area") < 8) | (F.col("area") > box * F.lit(0.55))
        | ((F.col("width") * F.col("height") > box * F.lit(0.30)) & (F.col("area") < F.col("width") * F.col("height") * F.lit(0.25)))
        | ((F.col("height") > F.col("bh") * F.lit(0.90)) & (F.col("width") > F.col("bw") * F.lit(0.90)))
    )
    judged = s.withColumn("good", ~bad)
    some = judged.groupBy(*RK).agg(F.max("good").alias("some"))
    return R.keep_components(labelled, judged.join(some, list(RK)).filter("good or not some"))


def glyph_size(mask: DataFrame, boxes: DataFrame, min_area: int = SETTINGS.min_component) -> DataFrame:
    """Median cross-direction size of the larger components; ``max(side/4, 8)`` when there is none."""
    frame = boxes.select(*RK, (F.col("x2") - F.col("x1")).alias("bw"), (F.col("y2") - F.col("y1")).alias("bh"))
    tall = F.col("bh") > F.col("bw") * F.lit(1.6)
    s = R.component_stats(R.label_runs(mask)).filter(F.col("area") >= min_area).join(frame, list(RK))
    s = s.withColumn("size", F.when(tall, F.col("width")).otherwise(F.col("height")))
    top = s.groupBy(*RK).agg(F.max("size").alias("top"))
    body = s.join(top, list(RK)).filter(F.col("size") >= F.col("top") * F.lit(0.45)).groupBy(*RK).agg(F.median("size").alias("m"))
    spare = F.greatest(F.when(tall, F.col("bw")).otherwise(F.col("bh")) * F.lit(0.25), F.lit(8.0))
    return frame.join(body, list(RK), "left").select(*RK, F.coalesce(F.col("m").cast("double"), spare).alias("glyph_size"))


def halo(ink: DataFrame, pixels: DataFrame, boxes: DataFrame, deviation: int = SETTINGS.halo_deviation) -> DataFrame:
    """Pixels of the 5 px ring that stand out from the crop background join the ink."""
    paper = middle(R.subtract(R.box_runs(boxes), ink), pixels)
    near = values(R.clip(R.ring(ink, 5), boxes), pixels).join(paper, list(RK), "left")
    odd = masked(near, F.abs(F.col("grey") - F.coalesce("bg", F.lit(255.0))) > deviation)
    return R.union(ink, odd)


# ---------------------------------------------------------------- page masks


def on_page(runs: DataFrame) -> DataFrame:
    return R.merge_runs(runs.select("page_id", "y", "x0", "x1"), ["page_id"])


def compose_masks(ink: DataFrame, boxes: DataFrame, outline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page erase mask and protected mask; erasing keeps 9 px off protected ink and off outlines."""
    shut = boxes.select(*RK, F.col("label").isin("SFX", "UNREADABLE").alias("shut"))
    tagged = ink.join(shut, list(RK))
    page = on_page(tagged.filter("not shut"))
    protected = on_page(tagged.filter("shut"))
    guard = R.grow(protected, 9, ["page_id"])
    erase = R.combine({"p": page, "g": guard, "o": outline}, lambda c: (c["p"] > 0) & (c["g"] == 0) & (c["o"] == 0), ["page_id"])
    return erase, protected


def outline_guard(interior: DataFrame, pixels: DataFrame, stroke: int, frame: DataFrame, dark: int = 110) -> DataFrame:
    """Long dark components in the band just outside an interior: the drawn outline, as page runs."""
    band = R.clip(R.subtract(R.dilate_times(interior, stroke + 4), interior), frame)
    labelled = R.label_runs(masked(values(band, pixels), F.col("grey") < dark))
    long = R.component_stats(labelled).filter(F.col("long_side") >= 8 * max(stroke, 1))
    return materialize(on_page(R.keep_components(labelled, long)), "outline")


def protected_guard(ink: DataFrame, boxes: DataFrame, outline: DataFrame) -> DataFrame:
    """What no fill may touch, as page runs: protected ink grown by 5 px, and the drawn outlines."""
    shut = boxes.filter(F.col("label").isin("SFX", "UNREADABLE")).select(*RK)
    protected = ink.join(shut, list(RK), "left_semi")
    return R.combine({"p": R.grow(protected, 5, ["page_id"]), "o": outline}, lambda c: (c["p"] > 0) | (c["o"] > 0), ["page_id"])


def protect_outline(ink: DataFrame, guard: DataFrame) -> DataFrame:
    """Ink pixels each region gives up to the outline guard."""
    return size(within_page(ink, guard), RK, "freed")


def protected_touched(erase: DataFrame, protected: DataFrame) -> DataFrame:
    """Pages where erasing would touch protected ink; empty when the contract holds."""
    both = R.intersect(erase, protected, ["page_id"])
    return size(both, ["page_id"], "touched")


def changed_under(boxes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Pixels under protected boxes, and how many differ between two rasters."""
    shut = boxes.filter(F.col("label").isin("SFX", "UNREADABLE"))
    j = values(R.box_runs(shut), before).join(after.select(*PX, F.col("grey").alias("grey2")), PX)
    return j.groupBy(*RK).agg(F.count(F.lit(1)).alias("px"), F.count_if(F.col("grey") != F.col("grey2")).alias("changed"))


# ---------------------------------------------------------------- background, fill and routing


def background_stats(ink: DataFrame, rgb: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per-channel background median and the largest robust spread around the ink.

    Uses the 9 px ring, or the whole box off the ink when the ring is under 30 values; white with
    spread 0 when even that is under 10 values. A spread past its limit is reported as 999.
    """
    frame = R.box_runs(boxes)
    near = R.combine({"b": frame, "d": R.grow(ink, 9), "i": ink}, lambda c: (c["b"] > 0) & (c["d"] > 0) & (c["i"] == 0))
    both = R.subtract(frame, ink).withColumn("near", F.lit(False)).unionByName(near.withColumn("near", F.lit(True)))
    h = T.tones(values(both, rgb), (*RK, "near"), "rgb")
    of = lambda name, near: F.first(F.when(F.col("near") == near, F.col(name)), ignorenulls=True)
    h = h.groupBy(*RK).agg(
        F.coalesce(of("n", True), F.lit(0)).alias("n_ring"), F.coalesce(of("n", False), F.lit(0)).alias("n_all"),
        *[of(f"h_{c}", near).alias(f"{c}{int(near)}") for c in "rgb" for near in (True, False)])
    thin = F.col("n_ring") * 3 < 30
    h = h.select(*RK, "n_ring", "n_all", *[F.when(thin, F.col(c + "0")).otherwise(F.col(c + "1")).alias("h" + c) for c in "rgb"])
    mid = h.withColumns({"m" + c: F.floor(T.median(F.col("h" + c))).cast("int") for c in "rgb"})
    dev = mid.select(*RK, "n_ring", "n_all", *["m" + c for c in "rgb"], *[(T.mad(F.col("h" + c), F.col("m" + c)) * 1.4826).alias("s" + c) for c in "rgb"])
    avg = (F.col("sr") + F.col("sg") + F.col("sb")) / 3
    sq = lambda c: (F.col(c) - avg) * (F.col(c) - avg)
    noise = F.sqrt((sq("sr") + sq("sg") + sq("sb")) / 3)
    top = F.greatest("sr", "sg", "sb")
    limit = F.when(noise > 1, SETTINGS.flat_spread_noisy).otherwise(SETTINGS.flat_spread)
    enough = F.when(F.col("n_ring") * 3 >= 30, F.col("n_ring")).otherwise(F.col("n_all")) * 3 >= 10
    full = boxes.select(*RK).join(dev, list(RK), "left")
    ok = F.coalesce(enough, F.lit(False))
    return full.select(
        *RK, *[F.when(ok, F.col("m" + c)).otherwise(255).alias("bg_" + c) for c in "rgb"],
        F.when(~ok, 0.0).when(top < limit, top).otherwise(999.0).alias("spread"),
    )


def fill_colour(fill: DataFrame, ink: DataFrame, rgb: DataFrame) -> DataFrame:
    """Median colour of the fill area off the grown ink; of the whole area if that leaves under 30 values."""
    grown = R.grow(ink, 5)
    off = R.subtract(fill, grown).withColumn("free", F.lit(True))
    h = T.tones(values(off.unionByName(R.intersect(fill, grown).withColumn("free", F.lit(False))), rgb), (*RK, "free"), "rgb")
    none = F.array().cast("array<struct<v:int,n:bigint>>")
    of = lambda c, free: F.coalesce(F.first(F.when(F.col("free") == free, F.col("h_" + c)), ignorenulls=True), none)
    parts = h.groupBy(*RK).agg(*[of(c, free).alias(f"{c}{int(free)}") for c in "rgb" for free in (True, False)])
    short = T.total(F.col("r1")) * 3 < 30
    whole = lambda c: F.sort_array(F.concat(f"{c}0", f"{c}1"))
    return parts.select(*RK, *[T.median(F.when(short, whole(c)).otherwise(F.col(c + "1"))).cast("int").alias("fill_" + c) for c in "rgb"])


def route(boxes: DataFrame, ink: DataFrame, colours: DataFrame, background: DataFrame) -> DataFrame:
    """skip (protected or no ink), flat (fill colour known or even background), else lama (repaint)."""
    inked = ink.select(*RK).distinct().withColumn("inked", F.lit(True))
    j = boxes.select(*RK, "label").join(inked, list(RK), "left").join(colours, list(RK), "left").join(background, list(RK), "left")
    way = (
        F.when(F.col("label").isin("SFX", "UNREADABLE") | F.col("inked").isNull(), "skip")
        .when(F.col("fill_r").isNotNull() | (F.col("spread") < SETTINGS.flat_spread), "flat").otherwise("lama")
    )
    colour = {c: F.when(way != "skip", F.coalesce("fill_" + c, "bg_" + c)).alias("bg_" + c) for c in "rgb"}
    return j.select(*RK, way.alias("route"), *colour.values())


def apply_flat_fill(rgb: DataFrame, fill: DataFrame, colours: DataFrame, guard: DataFrame) -> DataFrame:
    """Recolour fill pixels outside the guard; on contested pixels the last region wins."""
    hole = R.to_pixels(guard).select(*PX).withColumn("kept", F.lit(1))
    paint = R.to_pixels(fill).join(colours, list(RK)).groupBy(*PX).agg(
        F.max_by(F.struct("fill_r", "fill_g", "fill_b"), "region_id").alias("c")
    ).join(hole, PX, "left").filter("kept is null").drop("kept")
    j = rgb.join(paint, PX, "left")
    return j.select(*PX, *[F.coalesce(F.col("c.fill_" + ch), F.col(ch)).alias(ch) for ch in "rgb"], F.col("c").isNotNull().alias("painted"))


# ---------------------------------------------------------------- interiors


def ink_centre(ink: DataFrame, boxes: DataFrame) -> DataFrame:
    """Mean ink position, or the box centre without ink."""
    mean = R.to_pixels(ink).groupBy(*RK).agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    return boxes.join(mean, list(RK), "left").select(
        *RK,
        F.when(F.col("ax").isNull(), F.floor((F.col("x1") + F.col("x2")) / 2)).otherwise(F.col("x1") + F.floor(F.col("ax") - F.col("x1"))).cast("int").alias("sx"),
        F.when(F.col("ay").isNull(), F.floor((F.col("y1") + F.col("y2")) / 2)).otherwise(F.col("y1") + F.floor(F.col("ay") - F.col("y1"))).cast("int").alias("sy"),
    )


def seeded_region(foreground: DataFrame, seeds: DataFrame, ink: DataFrame, boxes: DataFrame, share: float = 0.05) -> DataFrame:
    """Component (4-neighbour) of the foreground pixel nearest the seed, with the ink added back.

    Falls back to the whole foreground when the component is under ``share`` of the crop. Within a
    run the nearest pixel is the seed clamped to it, so runs are compared, not pixels.
    """
    labelled = R.label_runs(foreground, conn=4)
    j = labelled.join(seeds, list(RK))
    px = F.least(F.greatest("sx", "x0"), F.col("x1") - 1)
    d = (px - F.col("sx")) * (px - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    pick = j.groupBy(*RK).agg(F.min_by("label", F.struct(d, F.col("y"), px)).alias("pick"))
    area = boxes.select(*RK, ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("crop"))
    got = labelled.join(pick, list(RK)).withColumn("mine", F.col("label") == F.col("pick"))
    enough = got.filter("mine").groupBy(*RK).agg(F.sum(F.col("x1") - F.col("x0")).alias("px")).join(area, list(RK)).select(
        *RK, (F.col("px") >= F.col("crop") * F.lit(share)).alias("enough")
    )
    kept = got.join(enough, list(RK)).filter("mine or not enough").select(*RK, "y", "x0", "x1")
    return R.union(kept, R.clip(ink, boxes))


def interior_masks(pixels: DataFrame, ink: DataFrame, boxes: DataFrame, stroke: int = 1) -> DataFrame:
    """Interior of each crop: bright class (polarity-checked), seeded, holes filled, closed, eroded."""
    pol = polarity(pixels, ink, boxes)
    px = values(R.box_runs(boxes), pixels).join(pol, list(RK))
    bright = F.col("grey") > F.col("threshold")
    on = F.when(F.col("inverted"), ~bright & (F.col("wall").isNull() | (F.col("grey") > F.col("wall")))).otherwise(bright)
    binv = materialize(masked(px, on), "binarised")
    base = R.union(binv, R.clip(ink, boxes))
    inner = materialize(seeded_region(binv, ink_centre(ink, boxes), ink, boxes), "seeded")
    inner = materialize(R.fill_holes(inner, boxes), "filled")
    closed = R.close(inner, 7, boxes)
    inner = R.combine({"c": closed, "i": inner, "b": base}, lambda c: (c["c"] > 0) & ((c["i"] > 0) | (c["b"] > 0)))
    return R.erode(inner, 2 * max(stroke, 1) + 1, boxes)


def fill_masks(interior: DataFrame, ink: DataFrame, boxes: DataFrame, most: float = 0.97) -> DataFrame:
    """Components of the interior that meet the region's own ink; none, or nearly the whole crop, gives no mask.

    An interior of a single component is kept as it is.
    """
    labelled = R.label_runs(interior)
    parts = labelled.groupBy(*RK).agg(F.count_distinct("label").alias("parts"))
    single = labelled.join(parts.filter("parts = 1"), list(RK), "left_semi").drop("label")
    own = R.keep_components(labelled, R.touching(labelled, ink))
    kept = R.union(own, single)
    crop = boxes.select(*RK, ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("crop"))
    ok = size(kept).join(crop, list(RK)).filter(F.col("px") / F.col("crop") <= most)
    return kept.join(ok.select(*RK), list(RK), "left_semi")


def discovered_parents(interior: DataFrame, windows: DataFrame, texts: DataFrame) -> DataFrame:
    """Boxes of interiors found in a search window: 15-85 % full and holding the text box within tolerance."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    box = interior.groupBy(*RK).agg(
        F.min("x0").alias("bx1"), F.min("y").alias("by1"), F.max("x1").alias("bx2"), (F.max("y") + 1).alias("by2"), F.sum(F.col("x1") - F.col("x0")).alias("px")
    )
    w = windows.select(*RK, area.alias("win"))
    j = box.join(w, list(RK)).join(texts.select(*RK, "x1", "y1", "x2", "y2"), list(RK))
    share = F.col("px") / F.col("win")
    tx = F.greatest(F.floor((F.col("x2") - F.col("x1")) / 10), F.lit(2))
    ty = F.greatest(F.floor((F.col("y2") - F.col("y1")) / 10), F.lit(2))
    holds = (F.col("bx1") <= F.col("x1") + tx) & (F.col("by1") <= F.col("y1") + ty) & (F.col("bx2") >= F.col("x2") - tx) & (F.col("by2") >= F.col("y2") - ty)
    return j.filter((share >= 0.15) & (share <= 0.85) & holds).select(*RK, "bx1", "by1", "bx2", "by2")


def nearest_owner(claims: DataFrame, seeds: DataFrame, keys=("page_id",)) -> DataFrame:
    """Pixels that regions claim, with ``owner``: the claimant whose seeds are nearest (ties: the lowest region).

    ``claims`` and ``seeds`` are runs of regions; a region without seeds owns a pixel only if no other claimant has any.
    """
    d = squared_distance(claims, seeds, [*keys, "region_id"])
    return d.withColumn("owner", F.min(F.struct("d", "region_id")).over(Window.partitionBy(*keys, "y", "x"))["region_id"])


def disjoin(interior: DataFrame, ink: DataFrame) -> DataFrame:
    """Interiors without shared pixels: a contested pixel goes to the claimant with the nearest ink.

    Ties go to the lowest region. A region that would lose every pixel keeps its mask. Only
    contested pixels are measured.
    """
    over = R.combine({"m": interior}, lambda c: c["m"] > 1, ["page_id"])
    claim = materialize(within_page(interior, over), "contested")
    lost = nearest_owner(claim, ink).filter("region_id <> owner").select(*RK, "y", "x")
    left = materialize(R.subtract(interior, R.to_runs(lost)), "kept")
    gone = interior.select(*RK).distinct().join(left.select(*RK).distinct(), list(RK), "left_anti")
    return left.unionByName(interior.join(gone, list(RK), "left_semi").select(*RK, "y", "x0", "x1"))


def share_interior(interior: DataFrame, ink: DataFrame, boxes: DataFrame, members: DataFrame) -> DataFrame:
    """One lobe for each region of a shared parent: the interiors of its regions together, dealt out by nearest ink.

    ``members`` has ``page_id, region_id, parent_id`` and the parent's box ``px1 .. py2``. Ink counts inside that box; a region
    without any there is measured from its middle (:func:`ink_centre` of ``ink`` and ``boxes``), moved into the box. Ties go
    to the lowest region. A region that gets no pixel has no lobe, and keeps what it had.
    """
    who = materialize(members.select(*RK, "parent_id", "px1", "py1", "px2", "py2"), "members")
    of = ["page_id", "parent_id"]
    whole = R.merge_runs(interior.join(who.select(*RK, "parent_id"), list(RK)).select(*of, "y", "x0", "x1"), of)
    claims = whole.join(who.select(*RK, "parent_id"), of).select(*of, "region_id", "y", "x0", "x1")
    frame = who.select(*RK, F.col("px1").alias("x1"), F.col("py1").alias("y1"), F.col("px2").alias("x2"), F.col("py2").alias("y2"))
    seen = materialize(R.clip(ink, frame), "seeds")
    blind = who.join(seen.select(*RK).distinct(), list(RK), "left_anti").join(ink_centre(ink, boxes), list(RK))
    at = lambda c, lo, hi: F.greatest(F.least(F.col(c), F.col(hi) - 1), F.col(lo)).cast("int")
    middle_ = blind.select(*RK, at("sy", "py1", "py2").alias("y"), at("sx", "px1", "px2").alias("x0")).withColumn("x1", F.col("x0") + 1)
    seeds = seen.unionByName(middle_).join(who.select(*RK, "parent_id"), list(RK))
    own = nearest_owner(claims, seeds, of).filter("region_id = owner")
    return R.to_runs(own.select(*RK, "y", "x"))


def mask_boxes(mask: DataFrame) -> DataFrame:
    """Bounding boxes of masks."""
    return mask.groupBy(*RK).agg(F.min("x0").alias("x1"), F.min("y").alias("y1"), F.max("x1").alias("x2"), (F.max("y") + 1).alias("y2"))


def separate_interiors(interior: DataFrame, ink: DataFrame, boxes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interiors of a page after shared parents are dealt out and overlaps between others settled, and their new boxes."""
    lobes = materialize(share_interior(interior, ink, boxes, members), "lobes")
    rest = interior.join(lobes.select(*RK).distinct(), list(RK), "left_anti").select(*RK, "y", "x0", "x1")
    out = materialize(disjoin(materialize(lobes.unionByName(rest), "interior"), ink), "separate")
    return out, mask_boxes(out)


# ---------------------------------------------------------------- verification


def residue_hits(clean: DataFrame, ink: DataFrame, interior: DataFrame, boxes: DataFrame, deviation: int = SETTINGS.residue_deviation) -> DataFrame:
    """Deviating pixels in the residue scope, as runs.

    Scope: ink plus its 3 px ring inside the interior, all within 7 px of the interior; background
    is the box median off the ink. A region without an interior is judged on its ink alone.
    """
    own = materialize(R.clip(ink, boxes), "ink")
    bg = middle(R.subtract(R.box_runs(boxes), own), clean)
    near = R.clip(R.grow(own, 3), boxes)
    wide = R.grow(interior, 7)
    has = interior.select(*RK).distinct()
    free = own.join(has, list(RK), "left_anti")
    scope = R.combine(
        {"i": own.join(has, list(RK), "left_semi"), "n": near, "t": interior, "w": wide},
        lambda c: ((c["i"] > 0) | ((c["n"] > 0) & (c["t"] > 0))) & (c["w"] > 0),
    )
    scope = scope.unionByName(free.select(*RK, "y", "x0", "x1"))
    px = values(scope, clean).join(bg, list(RK), "left")
    return masked(px, F.abs(F.col("grey") - F.coalesce("bg", F.lit(255.0))) > deviation)


def residue(clean, ink, interior, boxes, redetected: DataFrame, deviation: int = SETTINGS.residue_deviation) -> DataFrame:
    """Residue pixels, largest blob and verdict per erased (unprotected) region."""
    hits = residue_hits(clean, ink, interior, boxes, deviation)
    blob = R.component_stats(R.label_runs(hits)).groupBy(*RK).agg(F.max("area").alias("blob"), F.sum("area").alias("residue_px"))
    todo = boxes.filter(~F.col("label").isin("SFX", "UNREADABLE"))
    again = redetected.select(*RK).distinct().withColumn("again", F.lit(True))
    j = todo.join(blob, list(RK), "left").join(again, list(RK), "left")
    px, big = F.coalesce("residue_px", F.lit(0)), F.coalesce("blob", F.lit(0))
    limit = F.greatest(F.lit(30), (F.lit(0.002) * (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("int"))
    seen = F.coalesce("again", F.lit(False))
    return j.select(*RK, px.cast("bigint").alias("residue_px"), big.cast("bigint").alias("blob"), (seen | (px > limit) | (big > SETTINGS.residue_blob_max)).alias("failed"))


def escalation_masks(failed: DataFrame, ink: DataFrame, interior: DataFrame, boxes: DataFrame, attempt: int) -> DataFrame:
    """Wider erase masks for failing regions: ink grown by ``3 + 2*attempt``, kept within 7 px of the interior."""
    bad = failed.select(*RK)
    mine = ink.join(bad, list(RK), "left_semi")
    grown = R.clip(R.dilate(mine, 3 + 2 * attempt), boxes)
    inner = interior.join(bad, list(RK), "left_semi")
    has = inner.select(*RK).distinct()
    held = R.intersect(grown.join(has, list(RK), "left_semi"), R.dilate(inner, 7))
    return held.unionByName(grown.join(has, list(RK), "left_anti").select(*RK, "y", "x0", "x1"))


def clean_audit(clean, ink, interior, boxes, deviation: int = 16) -> tuple[DataFrame, DataFrame]:
    """Dirty components inside grown ink, and the page/corpus roll-up with totals."""
    todo = boxes.filter(~F.col("label").isin("SFX", "UNREADABLE"))
    grown = materialize(R.dilate(ink.join(todo, list(RK), "left_semi"), 5), "grown")
    inner = interior.join(todo, list(RK), "left_semi")
    ref = R.subtract(inner, grown)
    plenty = size(ref).filter("px >= 50")
    spare = R.subtract(R.box_runs(todo.join(plenty, list(RK), "left_anti")), grown)
    base = ref.join(plenty, list(RK), "left_semi").unionByName(spare)
    bg = middle(base, clean)
    has = inner.select(*RK).distinct()
    scope = R.intersect(grown.join(has, list(RK), "left_semi"), inner).unionByName(grown.join(has, list(RK), "left_anti").select(*RK, "y", "x0", "x1"))
    px = values(scope, clean).join(bg, list(RK), "left")
    bad = masked(px, F.abs(F.col("grey") - F.coalesce("bg", F.lit(255.0))) > deviation)
    s = R.component_stats(R.label_runs(bad))
    kind = F.when((F.col("long_side") >= 12) | (F.col("long_side") / F.col("short_side") >= 3.0), "line").otherwise("dot")
    parts = s.select(*RK, kind.alias("kind"), "area", "bx1", "by1", "bx2", "by2", "width", "height")
    rolled = parts.rollup("page_id", "region_id").agg(
        F.sum("area").alias("bad_px"), F.count(F.lit(1)).alias("components"), F.max("area").alias("max_area"),
        F.count_if(F.col("kind") == "line").alias("lines"), F.grouping_id().cast("bigint").alias("level"),
    )
    return parts, rolled


def lasting_ink(before: DataFrame, after: DataFrame, interior: DataFrame, deviation: int = 16, least: int = 2, long: int = 10) -> DataFrame:
    """Components that stand out from the cleaned background before and after: ink that was not erased.

    The background is the median of the result inside the interior. What stands out only afterwards is a
    fault of the fill and no part of this. Lines are ``long`` pixels or three times as long as wide.
    """
    bg = middle(interior, after)
    odd = lambda raster: masked(values(interior, raster).join(bg, list(RK)), F.abs(F.col("grey") - F.col("bg")) > deviation)
    s = R.component_stats(R.label_runs(R.intersect(odd(before), odd(after)))).filter(F.col("area") >= least)
    kind = F.when((F.col("long_side") >= long) | (F.col("long_side") / F.col("short_side") >= 3.0), "line").otherwise("dot")
    return s.select(*RK, kind.alias("kind"), "area", "bx1", "by1", "bx2", "by2")


def dark_share(boxes: DataFrame, raster: DataFrame, keys=("page_id", "det_id"), dark: int = 110) -> DataFrame:
    """Share of dark pixels in each box; boxes off the raster have none."""
    runs = R.box_runs(boxes, keys)
    tone = values(runs, raster).groupBy(*keys).agg(F.avg((F.col("grey") < dark).cast("int")).alias("dark"))
    return boxes.join(tone, list(keys), "left").withColumn("dark", F.coalesce("dark", F.lit(0.0)))


def leakage(interior: DataFrame, ink: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlap of every two interiors of a page, and ink outside any interior."""
    cells = F.explode(F.sequence(F.floor(F.col("x0") / CELL), F.floor((F.col("x1") - 1) / CELL))).alias("cell")
    part = lambda n: interior.select("page_id", "y", F.col("region_id").alias(n), F.col("x0").alias(n + "0"), F.col("x1").alias(n + "1"), cells)
    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    met = part("a").join(part("b"), ["page_id", "y", "cell"]).filter((F.col("a") < F.col("b")) & (lo < hi) & (F.floor(lo / CELL) == F.col("cell")))
    over = met.groupBy("page_id", "a", "b").agg(F.sum(hi - lo).alias("overlap_px"))
    out = size(R.subtract(on_page(ink), on_page(interior), ["page_id"]), ["page_id"], "outside_px")
    return over, out


def image_diff(a: DataFrame, b: DataFrame, limit: int = 120) -> DataFrame:
    """Mean absolute error, strongly changed pixels and equality per page."""
    j = a.join(b.select(*PX, *[F.col(c).alias(c + "2") for c in "rgb"]), PX)
    total = sum((F.abs(F.col(c) - F.col(c + "2")) for c in "rgb"), F.lit(0))
    return j.groupBy("page_id").agg((F.avg(total) / 3).alias("mae"), F.count_if(total > limit).alias("changed_px"), (F.max(total) == 0).alias("same"))


# ---------------------------------------------------------------- measures


def free_runs(mask: DataFrame, bands: DataFrame) -> DataFrame:
    """Widest stretch of columns free over every row of a band (ties: leftmost), as inclusive ``lo, hi``.

    ``bands`` has ``keys, band_y0, band_y1``. A column is free where as many runs meet as the band has rows.
    """
    keys, need = list(RK), F.col("band_y1") - F.col("band_y0")
    j = mask.join(bands, keys).filter("y >= band_y0 and y < band_y1")
    ends = F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))
    e = j.select(*keys, need.alias("need"), F.explode(ends).alias("e")).groupBy(*keys, "need", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("x")
    s = e.select(*keys, "need", "x", F.lead("x").over(w).alias("nx"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    full = s.filter("c = need").select(*keys, F.lit(0).alias("y"), F.col("x").alias("x0"), F.col("nx").alias("x1"))
    widest = F.max(F.struct((F.col("x1") - F.col("x0")).alias("w"), (-F.col("x0")).alias("n"))).alias("m")
    return R.merge_runs(full).groupBy(*keys).agg(widest).select(
        *keys, (-F.col("m.n")).alias("lo"), (F.col("m.w") - F.col("m.n") - 1).alias("hi")
    )


def block_slack(mask: DataFrame, blocks: DataFrame, cover: float = 0.20) -> DataFrame:
    """Free rows above and below a text block: rows covered at least ``cover`` over the block width.

    ``blocks`` has ``keys, bx0, bx1, ink_a, ink_b, pad, top, bottom``; of the stretches of free
    rows the one overlapping the block's ink most counts (ties: first).
    """
    j = mask.join(blocks, list(RK))
    part = F.greatest(F.least("x1", "bx1") - F.greatest("x0", "bx0"), F.lit(0))
    rows = j.groupBy(*RK, "y", "bx0", "bx1", "ink_a", "ink_b", "pad", "top", "bottom").agg(F.sum(part).alias("c"))
    rows = rows.filter(F.col("c") / (F.col("bx1") - F.col("bx0")) >= cover)
    w = Window.partitionBy(*RK).orderBy("y")
    isle = rows.withColumn("isle", F.col("y") - F.row_number().over(w))
    span = isle.groupBy(*RK, "isle", "ink_a", "ink_b", "pad", "top", "bottom").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    over = F.least("hi", "ink_b") - F.greatest("lo", "ink_a")
    best = span.groupBy(*RK, "ink_a", "ink_b", "pad", "top", "bottom").agg(F.max(F.struct(over.alias("o"), (-F.col("lo")).alias("n"), F.col("hi"))).alias("m"))
    lo, hi = -F.col("m.n"), F.col("m.hi")
    return best.select(*RK, (F.col("ink_a") - F.greatest(lo, F.col("top") + F.col("pad"))).alias("above"),
                       (F.least(hi, F.col("bottom") - F.col("pad")) - F.col("ink_b")).alias("below"))


def mask_moments(mask: DataFrame, boxes: DataFrame) -> DataFrame:
    """Centroid, pixel count, fill share and effective box; a missing mask counts as the full box."""
    n = F.col("x1") - F.col("x0")
    m = mask.groupBy(*RK).agg(
        F.sum(n).alias("px"), F.sum(n * (F.col("x0") + F.col("x1") - 1) / 2).alias("sx"), F.sum(n * F.col("y")).alias("sy"),
        F.min("x0").alias("mx1"), F.min("y").alias("my1"), F.max("x1").alias("mx2"), (F.max("y") + 1).alias("my2"),
    )
    j = boxes.join(m, list(RK), "left")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    mid = lambda s, lo, hi: F.coalesce((F.col(s) / F.col("px")).cast("int"), F.floor((F.col(lo) + F.col(hi)) / 2).cast("int"))
    return j.select(
        *RK, mid("sx", "x1", "x2").alias("cx"), mid("sy", "y1", "y2").alias("cy"), F.coalesce("px", area).cast("bigint").alias("px"),
        (F.coalesce("px", area) / area).alias("fill_share"),
        *[F.coalesce("m" + c, c).alias("eff_" + c) for c in ("x1", "y1", "x2", "y2")],
    )


def ink_colour(interior: DataFrame, pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """white on dark interiors (median under 128), black otherwise."""
    lum = middle(interior, pixels, "lum")
    level = F.coalesce("lum", F.lit(255.0))
    return boxes.select(*RK).join(lum, list(RK), "left").select(*RK, level.alias("luminance"), F.when(level < 128, "white").otherwise("black").alias("ink_colour"))


def reclaim_candidates(fill, interior, laid_ink, boxes, state: DataFrame) -> DataFrame:
    """Pixels a cramped region could take back from its neighbours, worst region first.

    Own fill outside the own interior, inside another interior, off laid-out ink and off the
    interiors of protected regions. ``state`` has ``keys, hyphens, overflow, size``.
    """
    shut = on_page(interior.join(boxes.filter(F.col("label").isin("SFX", "UNREADABLE")), list(RK), "left_semi"))
    ready = R.combine({"t": on_page(interior), "k": on_page(laid_ink), "s": shut}, lambda c: (c["t"] > 0) & (c["k"] == 0) & (c["s"] == 0), ["page_id"])
    cand = within_page(R.subtract(fill, interior), ready)
    live = size(cand).join(state, list(RK)).filter("hyphens > 0 or overflow > 0")
    order = [down(F.col("hyphens")), down(F.col("overflow")), F.col("size"), F.col("region_id")]
    return ranked(live, ["page_id"], order, "turn").select(*RK, "px", "turn")


def lettering_measures(interior, pixels, boxes, dark: int = 110, least_ink: int = 40, least_glyphs: int = 4) -> DataFrame:
    """Cap height (median and mode of glyph heights), margins, width use, line count and pitch of the dark lettering inside an interior."""
    px = values(interior, pixels).filter(F.col("grey") < dark)
    ink = R.to_runs(px.select(*RK, "y", "x"))
    s = R.component_stats(R.label_runs(ink)).filter("height between 4 and 60 and width between 2 and 60 and area >= 6")
    often = Window.partitionBy(*RK, "height")
    s = s.withColumn("same", F.count(F.lit(1)).over(often))
    mode = F.max_by("height", F.struct("same", -F.col("height"))).alias("mode")  # of equally frequent heights the lowest
    glyphs = s.groupBy(*RK).agg(mode, F.median("height").alias("cap"), F.count(F.lit(1)).alias("glyphs"), F.min(F.struct("height")).alias("lo"),
                                F.max("height").alias("hi"))
    box = ink.groupBy(*RK).agg(F.min("x0").alias("ix0"), F.max("x1").alias("ix1"), F.min("y").alias("iy0"), F.max("y").alias("iy1"),
                               F.sum(F.col("x1") - F.col("x0")).alias("ink_px")).filter(F.col("ink_px") >= least_ink)
    inner = interior.join(box.select(*RK, "iy0", "iy1"), list(RK)).filter("y between iy0 and iy1").groupBy(*RK).agg(F.min("x0").alias("b0"), F.max("x1").alias("b1"))
    rows = ink.select(*RK, "y").distinct()
    w = Window.partitionBy(*RK).orderBy("y")
    starts = rows.withColumn("prev", F.lag("y").over(w)).filter("prev is null or y - prev > 1")
    gaps = starts.withColumn("gap", F.col("y") - F.lag("y").over(w))
    lines = gaps.groupBy(*RK).agg(F.count(F.lit(1)).alias("lines"), F.median("gap").alias("pitch"))
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    margin = ((F.col("ix0") - F.col("b0")) + (F.col("b1") - F.col("ix1"))) / 2
    return box.join(glyphs.filter(F.col("glyphs") >= least_glyphs), list(RK)).join(inner, list(RK)).join(lines, list(RK)).join(boxes, list(RK)).select(
        *RK, F.col("cap").cast("double").alias("cap"), (F.col("cap") / side).alias("cap_ratio"), (margin / side).alias("margin_ratio"),
        ((F.col("ix1") - F.col("ix0")) / (F.col("b1") - F.col("b0"))).alias("width_use"), "lines",
        F.col("pitch").cast("double").alias("pitch"), (F.col("pitch") / F.col("cap")).alias("pitch_per_cap"),
        (F.col("hi") - F.col("lo.height")).alias("height_spread"), F.col("mode").cast("double").alias("mode"),
    )


def compare_masks(old: DataFrame, new: DataFrame, ink: DataFrame, pixels: DataFrame, boxes: DataFrame, dark: int = 110) -> DataFrame:
    """Cover, ink coverage and dark share of two masks, with the increase in dark share."""
    crop = boxes.select(*RK, ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("crop"))
    n_ink = size(ink, RK, "ink_px")
    out = crop.join(n_ink, list(RK), "left")
    for tag, m in (("old", old), ("new", new)):
        shade = values(m, pixels).groupBy(*RK).agg(F.count(F.lit(1)).alias(f"{tag}_px"), F.avg((F.col("grey") <= dark).cast("int")).alias(f"{tag}_dark"))
        held = size(R.intersect(m, ink), RK, f"{tag}_held")
        out = out.join(shade, list(RK), "left").join(held, list(RK), "left")
    zero = F.lit(0)
    cols = []
    for tag in ("old", "new"):
        cols += [(F.coalesce(f"{tag}_px", zero) / F.col("crop")).alias(f"{tag}_cover"),
                 F.when(F.col("ink_px").isNull(), -1.0).otherwise(F.coalesce(f"{tag}_held", zero) / F.col("ink_px")).alias(f"{tag}_ink"),
                 F.coalesce(f"{tag}_dark", F.lit(0.0)).alias(f"{tag}_dark")]
    return out.select(*RK, *cols).withColumn("dark_increase", F.col("new_dark") - F.col("old_dark"))


def fill_leak(fill, ink, pixels, boxes, reach: int = 13, dark: int = 110) -> DataFrame:
    """Share of the box a fill covers, ink it holds, its dark share, and its grey level near and far from the ink."""
    crop = boxes.select(*RK, ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("crop"))
    held = size(R.intersect(fill, ink), RK, "held").join(size(ink, RK, "ink_px"), list(RK))
    wide, tight = R.grow(ink, reach), R.grow(ink, 5)
    near = R.combine({"f": fill, "n": wide, "i": tight}, lambda c: (c["f"] > 0) & (c["n"] > 0) & (c["i"] == 0))
    parts = {"near": near, "far": R.subtract(fill, wide), "held": R.intersect(fill, tight)}
    tagged = reduce(DataFrame.unionByName, [runs.withColumn("part", F.lit(name)) for name, runs in parts.items()])
    h = T.tones(values(tagged, pixels), (*RK, "part"))
    of = lambda name, part: F.first(F.when(F.col("part") == part, F.col(name)), ignorenulls=True)
    shade = h.groupBy(*RK).agg(
        F.sum("n").alias("px"), F.sum(T.total(T.upto(F.col("h_grey"), F.lit(dark - 1)))).alias("dark_px"),
        *[c for part in ("near", "far") for c in (of("n", part).alias(f"{part}_px"), of("h_grey", part).alias(part))])
    for part in ("near", "far"):
        shade = shade.withColumn(f"{part}_median", T.median(F.col(part))).withColumn(f"{part}_spread", T.mad(F.col(part), F.col(f"{part}_median")) * 1.4826)
    j = crop.join(shade.withColumn("dark_share", F.col("dark_px") / F.col("px")), list(RK)).join(held, list(RK), "left")
    return j.select(
        *RK, (F.col("px") / F.col("crop")).alias("box_share"), (F.coalesce("held", F.lit(0)) / F.coalesce("ink_px", F.lit(1))).alias("ink_held"), "dark_share",
        "near_median", "near_spread", "far_median", "far_spread", F.abs(F.col("near_median") - F.col("far_median")).alias("median_gap"),
        (F.col("near_px").isNotNull() & (F.col("near_px") >= 30) & F.col("far_px").isNotNull() & (F.col("far_px") >= 30)).alias("tested"),
    )


def edge_background(mask: DataFrame, boxes: DataFrame, keep: int = 2) -> DataFrame:
    """The largest components of a box off its mask that touch the border of the box (ties: the later one).

    Added to a fill they make a control: a fill that is known to leak.
    """
    back = R.label_runs(R.subtract(R.box_runs(boxes), mask))
    s = R.component_stats(back).join(boxes.select(*RK, "x1", "y1", "x2", "y2"), list(RK)).filter("bx1 = x1 or by1 = y1 or bx2 = x2 or by2 = y2")
    return R.keep_components(back, top_k(s, list(RK), [F.desc("area"), F.desc("label")], keep))


def colour_marks(rgb: DataFrame, pad: int = 6, least: int = 30, most: int = 4) -> DataFrame:
    """Boxes of red marks: components of strongly red pixels, the largest few per page, padded."""
    red = (F.col("r") > 110) & (F.col("r") - F.col("g") > 50) & (F.col("r") - F.col("b") > 50)
    marks = R.to_runs(pixels_of(rgb).filter(red).select(*PX), ["page_id"])
    s = R.component_stats(R.label_runs(marks, ["page_id"]), ["page_id"])
    w = Window.partitionBy("page_id").orderBy(F.desc("area"), "by1", "bx1", "label")
    return s.withColumn("rank", F.row_number().over(w).cast("bigint")).filter((F.col("rank") <= most) & (F.col("area") >= least)).select(
        "page_id", "rank", "area", (F.col("bx1") - pad).alias("x1"), (F.col("by1") - pad).alias("y1"), (F.col("bx2") + pad).alias("x2"), (F.col("by2") + pad).alias("y2"))


def lost_outline(before, after, interior, guard, frame, stroke: int = 1, dark: int = 110, light: int = 170) -> DataFrame:
    """Outline pixels dark before and light after, still-guarded pixels and dark pixels left inside."""
    band = R.clip(R.subtract(R.dilate_times(interior, stroke + 4), interior), frame)
    both = before.select(*PX, "grey").join(after.select(*PX, F.col("grey").alias("grey2")), PX)
    was, gone = F.col("grey") < dark, F.col("grey2") > light
    line = values(band, both).groupBy(*RK).agg(F.count_if(was).alias("line_px"), F.count_if(was & gone).alias("lost_px"))
    stay = values(interior, both).groupBy(*RK).agg(F.count_if(was & ~gone).alias("stay_px"))
    kept = size(within_page(band, guard), RK, "kept_px")
    share = F.when(F.col("line_px") > 0, 100.0 * F.col("lost_px") / F.col("line_px")).otherwise(0.0)
    return line.join(stay, list(RK)).join(kept, list(RK), "left").select(
        *RK, "line_px", "lost_px", share.alias("lost_pct"), F.coalesce("kept_px", F.lit(0)).alias("kept_px"), "stay_px")


def clearance(ink: DataFrame, interior: DataFrame) -> DataFrame:
    """Ink pixels outside the interior, and the least distance from inside ink to the outside.

    The nearest outside pixel is always a direct neighbour of the interior, so only that rim is searched.
    """
    out = size(R.subtract(ink, interior), RK, "outside_px")
    near = squared_distance(R.intersect(ink, interior), R.ring(interior, 3))
    least = near.groupBy(*RK).agg(F.sqrt(F.min("d").cast("double")).alias("least_gap"))
    ids = ink.select(*RK).distinct()
    return ids.join(out, list(RK), "left").join(least, list(RK), "left").select(*RK, F.coalesce("outside_px", F.lit(0)).cast("bigint").alias("outside_px"), "least_gap")

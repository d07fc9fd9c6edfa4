"""Raster queries over the derived page rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.operators import alike, capacity
from pagelens.operators import raster as P
from pagelens.operators import runs as R
from pagelens.functions import fixed as X
from pagelens.operators.texts import sum_width
from pagelens.plans import raster_sql as S
from pagelens.plans.corpus import SIDE
from pagelens.plans.registry import query
from pagelens.sources import images

RK = ["page_id", "region_id"]
PXCOLS = [*RK, "y", "x"]


def px(runs):
    return R.to_pixels(runs).select(*PXCOLS)


def page_px(runs):
    return R.to_pixels(runs).select("page_id", "y", "x")


def ink(c):
    return c.runs("ink")


def inner(c):
    return c.runs("interior")


def fill(c):
    return c.runs("fill")


def frame(c, keys=None):
    """The raster frame of every region."""
    return c.crops.select(*RK, F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(SIDE).alias("x2"), F.lit(SIDE).alias("y2"))


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


CROP = ("crop AS (SELECT c.page_id, c.region_id, p.y, p.x, p.grey FROM crops c JOIN pix p ON p.page_id = c.page_id "
        "AND p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2)")
ALL4 = "SELECT page_id, region_id, y, x FROM "


@query("explode_pixels", "SELECT page_id, y, x, r, g, b, (4899 * r + 9617 * g + 1868 * b + 8192) >> 14 AS grey FROM rgb", "rgb")
def _(c):
    return images.explode_pixels(images.pack_images(c.rgb, "page_id"), "page_id")


@query("shift_layer", "SELECT i.page_id, i.region_id, i.y + 3 AS y, i.x - 12 AS x FROM ink i WHERE i.x >= 12", "ink crops")
def _(c):
    boxes = c.crops
    local = c.ink.join(boxes, RK).select(*RK, (F.col("y") - F.col("y1") + 3).alias("y"), (F.col("x") - F.col("x1") - 12).alias("x"))
    page = c.pages.select("page_id", F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"))
    return images.shift_layer(local, boxes, page)


@query("to_runs", with_(S.runs("r", "ink")) + "SELECT page_id, region_id, y, CAST(x0 AS INT) AS x0, CAST(x1 AS INT) AS x1 FROM r", "ink")
def _(c):
    return R.to_runs(c.ink)


@query("to_pixels", "SELECT page_id, region_id, y, x FROM interior", "interior")
def _(c):
    return px(inner(c))


@query("otsu", with_(S.otsu("o", "pix", "page_id")) + "SELECT * FROM o", "pix")
def _(c):
    return P.otsu(c.pix, ["page_id"])


@query("minority_mask", with_(S.minority("m", "pix", "page_id")) + "SELECT * FROM m", "pix")
def _(c):
    return P.minority_mask(c.pix, ["page_id"])


DARK = "dk AS (SELECT page_id, 0 AS region_id, y, x FROM pix WHERE grey < 110)"


@query("components", with_(DARK, S.labels("l", "dk"), S.stats("s", "l")) + """
SELECT page_id, bx1, by1, bx2, by2, CAST(area AS BIGINT) AS area, width, height, greatest(width, height) AS long_side,
  greatest(least(width, height), 1) AS short_side, area / CAST(width * height AS DOUBLE) AS fill_ratio
FROM (SELECT page_id, CAST(bx1 AS INT) AS bx1, by1, CAST(bx2 AS INT) AS bx2, by2, area, CAST(width AS INT) AS width, height FROM s)""", "pix")
def _(c):
    runs = R.to_runs(c.pix.filter("grey < 110"), ["page_id"])
    return R.component_stats(R.label_runs(runs, ["page_id"]), ["page_id"]).drop("label")


TEXTS = "SELECT * FROM crops WHERE region_id < 2"  # regions that the text detector has probabilities for


@query("seed_grow", with_(
    "weak AS (SELECT * FROM prob WHERE p >= 118e-3)", S.labels("wl", "weak"),
    "ik AS (SELECT wl.* FROM wl WHERE (page_id, region_id, lab) IN (SELECT wl.page_id, wl.region_id, lab FROM wl JOIN prob USING (page_id, region_id, y, x) WHERE p >= 5e-1))",
    f"c0 AS ({TEXTS})", CROP.replace("FROM crops", "FROM c0"), S.minority("mi", "crop", S.K), S.dilate("band", "ik", 9), S.meet("near", "mi", "band"),
    S.join("res", "ik", "near")) + ALL4 + "res", "prob pix crops")
def _(c):
    return px(P.seed_grow(c.prob, c.lines("pix"), c.crops.filter("region_id < 2")))


NOISY = "SELECT page_id, region_id, y, x FROM {crop} WHERE grey < 110 OR grey BETWEEN 176 AND 182"


@query("filter_glyphs", with_(CROP, "nz AS (" + NOISY.replace("{crop}", "crop") + ")", S.labels("l", "nz"), S.stats("s", "l"), """
j AS (SELECT s.*, NOT (area < 8 OR area > 55e-2 * bw * bh OR (width * height > 3e-1 * bw * bh AND area < 25e-2 * width * height) OR (height > 9e-1 * bh AND width > 9e-1 * bw)) AS good
  FROM s JOIN (SELECT page_id, region_id, x2 - x1 AS bw, y2 - y1 AS bh FROM crops) USING (page_id, region_id)),
k AS (SELECT *, bool_or(good) OVER (PARTITION BY page_id, region_id) AS anyg FROM j)""") + """
SELECT page_id, region_id, y, CAST(x AS INT) AS x FROM l JOIN k USING (page_id, region_id, lab) WHERE good OR NOT anyg""", "pix crops")
def _(c):
    crop = P.values(R.box_runs(c.crops), c.lines("pix"))
    return px(P.filter_glyphs(R.to_runs(c.spark.sql(NOISY, crop=crop)), c.crops))


@query("glyph_size", with_(S.labels("l", "ink"), S.stats("s", "l"), """
g AS (SELECT s.*, CASE WHEN y2 - y1 > 16e-1 * (x2 - x1) THEN width ELSE height END AS sz FROM s JOIN crops USING (page_id, region_id) WHERE area >= 8),
b AS (SELECT * FROM g QUALIFY sz >= 45e-2 * max(sz) OVER (PARTITION BY page_id, region_id)),
m AS (SELECT page_id, region_id, median(sz) AS m FROM b GROUP BY ALL)""") + """
SELECT page_id, region_id, coalesce(CAST(m AS DOUBLE), greatest(25e-2 * CASE WHEN y2 - y1 > 16e-1 * (x2 - x1) THEN x2 - x1 ELSE y2 - y1 END, 8e0)) AS glyph_size
FROM crops LEFT JOIN m USING (page_id, region_id)""", "ink crops")
def _(c):
    return P.glyph_size(ink(c), c.crops, min_area=8)


@query("dilate", with_(S.dilate("d", "ink", 9)) + ALL4 + "d", "ink")
def _(c):
    return px(R.dilate(ink(c), 9))


ERODE7 = f"""SELECT i.page_id, i.region_id, i.y, i.x FROM interior i JOIN (VALUES {S.offsets(7)}) o(dy, dx) ON true
JOIN interior n ON n.page_id = i.page_id AND n.region_id = i.region_id AND n.y = i.y + dy AND n.x = i.x + dx
GROUP BY ALL HAVING count(*) = {S.offsets(7).count("(")}"""


@query("erode", ERODE7, "interior")
def _(c):
    return px(R.erode(inner(c), 7))


@query("close", with_(S.box("bx"), S.dilate("d0", "ink", 7), S.clip("d", "d0"), S.minus("out", "bx", "d"), S.dilate("o7", "out", 7), S.minus("res", "d", "o7"))
       + ALL4 + "res", "ink crops")
def _(c):
    return px(R.close(ink(c), 7, c.crops))


@query("ring", with_(S.dilate("d", "ink", 5), S.minus("r", "d", "ink")) + ALL4 + "r", "ink")
def _(c):
    return px(R.ring(ink(c), 5))


@query("halo", with_(
    CROP, S.box("bx"), S.minus("pp", "bx", "ink"), "bg AS (SELECT page_id, region_id, median(grey) AS bg FROM pp JOIN crop USING (page_id, region_id, y, x) GROUP BY ALL)",
    S.dilate("d", "ink", 5), S.minus("rg", "d", "ink"),
    "od AS (SELECT page_id, region_id, y, x FROM rg JOIN crop USING (page_id, region_id, y, x) JOIN bg USING (page_id, region_id) WHERE abs(grey - bg) > 12)",
    S.join("res", "ink", "od")) + ALL4 + "res", "ink pix crops")
def _(c):
    return px(P.halo(ink(c), c.lines("pix"), c.crops))


@query("mask_union", with_(S.join("r", "ink", "fill")) + ALL4 + "r", "ink fill")
def _(c):
    return px(R.union(ink(c), fill(c)))


@query("mask_intersect", with_(S.meet("r", "interior", "fill")) + ALL4 + "r", "interior fill")
def _(c):
    return px(R.intersect(inner(c), fill(c)))


@query("mask_subtract", with_(S.minus("r", "interior", "ink")) + ALL4 + "r", "interior ink")
def _(c):
    return px(R.subtract(inner(c), ink(c)))


@query("mask_clip", with_(S.clip("r", "interior")) + ALL4 + "r", "interior crops")
def _(c):
    return px(R.clip(inner(c), c.crops))


FRAMED = "x >= 0 AND y >= 0 AND x < 48 AND y < 48"
GUARD = [
    S.dilate("gd", "interior", 0, cells=S.diamond(5)), S.minus("gb0", "gd", "interior"),
    f"gb AS (SELECT g.* FROM gb0 g WHERE {FRAMED})",
    "gk AS (SELECT page_id, region_id, y, x FROM gb JOIN pix USING (page_id, y, x) WHERE grey < 110)",
    S.labels("gl", "gk"), S.stats("gs", "gl"),
    "guard AS (SELECT DISTINCT page_id, y, CAST(x AS INT) AS x FROM gl JOIN gs USING (page_id, region_id, lab) WHERE greatest(width, height) >= 8)",
]


def guard(c):
    return P.outline_guard(inner(c), c.lines("pix"), 1, frame(c))


@query("outline_guard", with_(*GUARD) + "SELECT * FROM guard", "interior pix")
def _(c):
    return page_px(guard(c))


WIDE = "wide AS (SELECT DISTINCT page_id, region_id, y + dy AS y, x + dx AS x FROM ink, (VALUES " + S.offsets(15) + ") o(dy, dx))"


@query("protect_outline", with_(*GUARD, WIDE) + "SELECT page_id, region_id, count(*) AS freed FROM wide JOIN guard USING (page_id, y, x) GROUP BY ALL", "interior pix ink")
def _(c):
    return P.protect_outline(R.dilate(ink(c), 15), guard(c))


COMPOSE = [*GUARD, S.spread("wide", "ink", 15), "pr AS (SELECT DISTINCT page_id, y, x FROM wide WHERE region_id = 2)", "pg AS (SELECT DISTINCT page_id, y, x FROM wide WHERE region_id <> 2)",
           S.spread("pd", "pr", 9, "page_id"), S.minus("e1", "pg", "pd", "page_id"), S.minus("er", "e1", "guard", "page_id")]


@query("compose_masks", with_(*COMPOSE) + "SELECT 'erase' AS mask, page_id, y, x FROM er UNION ALL SELECT 'protected', page_id, y, x FROM pr", "interior pix ink")
def _(c):
    erase, protected = P.compose_masks(R.dilate(ink(c), 15), c.crops, guard(c))
    tag = lambda df, m: page_px(df).select(F.lit(m).alias("mask"), "page_id", "y", "x")
    return tag(erase, "erase").unionByName(tag(protected, "protected"))


@query("protected_contract", with_(*COMPOSE) + """
SELECT page_id, (SELECT count(*) FROM er e JOIN pr USING (page_id, y, x) WHERE e.page_id = t.page_id) AS touched, px, changed FROM (
  SELECT c.page_id, count(*) AS px, count(*) FILTER (p.grey <> a.grey) AS changed FROM crops c JOIN pix p ON p.page_id = c.page_id AND x >= x1 AND x < x2 AND y >= y1 AND y < y2
  JOIN after a ON a.page_id = p.page_id AND a.y = p.y AND a.x = p.x WHERE region_id = 2 GROUP BY 1) t""", "interior pix ink crops after")
def _(c):
    erase, protected = P.compose_masks(R.dilate(ink(c), 15), c.crops, guard(c))
    under = P.changed_under(c.crops, c.pix, c.after)
    return under.join(P.protected_touched(erase, protected), "page_id", "left").select("page_id", F.coalesce("touched", F.lit(0)).cast("bigint").alias("touched"), "px", "changed")


BG = [
    S.box("bx"), S.minus("rest", "bx", "ink"), S.dilate("d", "ink", 9), S.minus("rg0", "d", "ink"), S.clip("rg", "rg0"),
    "px AS (SELECT r.page_id, r.region_id, r.y, r.x, c.r, c.g, c.b, n.x IS NOT NULL AS near FROM rest r JOIN rgb c USING (page_id, y, x) "
    "LEFT JOIN rg n ON n.page_id = r.page_id AND n.region_id = r.region_id AND n.y = r.y AND n.x = r.x)",
    "us AS (SELECT * FROM px QUALIFY near OR 3 * count(*) FILTER (near) OVER (PARTITION BY page_id, region_id) < 30)",
    "mid AS (SELECT page_id, region_id, CAST(floor(median(r)) AS INT) AS mr, CAST(floor(median(g)) AS INT) AS mg, CAST(floor(median(b)) AS INT) AS mb FROM us GROUP BY ALL)",
    "dv AS (SELECT page_id, region_id, any_value(mr) AS bg_r, any_value(mg) AS bg_g, any_value(mb) AS bg_b, median(abs(r - mr)) * 14826e-4 AS sr, "
    "median(abs(g - mg)) * 14826e-4 AS sg, median(abs(b - mb)) * 14826e-4 AS sb FROM us JOIN mid USING (page_id, region_id) GROUP BY page_id, region_id)",
    "bgs AS (SELECT page_id, region_id, bg_r, bg_g, bg_b, CASE WHEN greatest(sr, sg, sb) < CASE WHEN stddev_pop(s) > 1 THEN 7 ELSE 10 END THEN greatest(sr, sg, sb) ELSE 999e0 END AS spread "
    "FROM (SELECT *, unnest([sr, sg, sb]) AS s FROM dv) GROUP BY page_id, region_id, bg_r, bg_g, bg_b, sr, sg, sb)",
]


@query("background_stats", with_(*BG) + "SELECT * FROM bgs", "ink rgb crops")
def _(c):
    return P.background_stats(ink(c), c.lines("rgb"), c.crops)


FILL = [
    S.dilate("fd", "ink", 5),
    "fp AS (SELECT f.page_id, f.region_id, c.r, c.g, c.b, n.x IS NULL AS free FROM fill f JOIN rgb c USING (page_id, y, x) "
    "LEFT JOIN fd n ON n.page_id = f.page_id AND n.region_id = f.region_id AND n.y = f.y AND n.x = f.x)",
    "fu AS (SELECT * FROM fp QUALIFY free OR 3 * count(*) FILTER (free) OVER (PARTITION BY page_id, region_id) < 30)",
    "fc AS (SELECT page_id, region_id, CAST(trunc(median(r)) AS INT) AS fill_r, CAST(trunc(median(g)) AS INT) AS fill_g, CAST(trunc(median(b)) AS INT) AS fill_b FROM fu GROUP BY ALL)",
]


@query("fill_colour", with_(*FILL) + "SELECT * FROM fc", "ink rgb fill")
def _(c):
    return P.fill_colour(fill(c), ink(c), c.lines("rgb"))


# Region 1 is routed without a fill mask here, so that all three routes are decided.
@query("route", with_(*BG, *FILL) + """
SELECT page_id, region_id, route, CASE WHEN route <> 'skip' THEN coalesce(fill_r, bg_r) END AS bg_r, CASE WHEN route <> 'skip' THEN coalesce(fill_g, bg_g) END AS bg_g,
  CASE WHEN route <> 'skip' THEN coalesce(fill_b, bg_b) END AS bg_b FROM (
SELECT c.page_id, c.region_id, CASE WHEN label = 'SFX' THEN 'skip' WHEN fill_r IS NOT NULL OR spread < 10 THEN 'flat' ELSE 'lama' END AS route, fill_r, fill_g, fill_b, bg_r, bg_g, bg_b
FROM crops c LEFT JOIN (SELECT * FROM fc WHERE region_id = 0) f ON c.page_id = f.page_id AND c.region_id = f.region_id
LEFT JOIN bgs b ON c.page_id = b.page_id AND c.region_id = b.region_id)""", "ink rgb fill crops")
def _(c):
    fills = P.fill_colour(c.runs("fill", 0), ink(c), c.lines("rgb"))  # the other region has no fill colour and goes by its background
    return P.route(c.crops, ink(c), fills, P.background_stats(ink(c), c.lines("rgb"), c.crops))


# No fill touches protected ink or a drawn outline.
KEPT = [
    "sk AS (SELECT DISTINCT i.page_id, i.y, i.x FROM ink i JOIN crops c ON c.page_id = i.page_id AND c.region_id = i.region_id WHERE label IN ('SFX', 'UNREADABLE'))",
    S.dilate("sd", "sk", 5, "page_id"), S.join("kept", "guard", "sd", "page_id"),
]


@query("apply_flat_fill", with_(*FILL, *GUARD, *KEPT) + """,
pt AS (SELECT f.page_id, f.y, f.x, fill_r, fill_g, fill_b FROM fill f JOIN fc USING (page_id, region_id) ANTI JOIN kept g ON g.page_id = f.page_id AND g.y = f.y AND g.x = f.x
  QUALIFY row_number() OVER (PARTITION BY f.page_id, f.y, f.x ORDER BY f.region_id DESC) = 1)
SELECT r.page_id, r.y, r.x, coalesce(fill_r, r) AS r, coalesce(fill_g, g) AS g, coalesce(fill_b, b) AS b, fill_r IS NOT NULL AS painted
FROM rgb r LEFT JOIN pt ON pt.page_id = r.page_id AND pt.y = r.y AND pt.x = r.x""", "ink rgb fill interior pix crops")
def _(c):
    kept = P.protected_guard(ink(c), c.crops, guard(c))
    return P.apply_flat_fill(c.rgb, fill(c), P.fill_colour(fill(c), ink(c), c.lines("rgb")), kept)


POLARITY = [
    CROP, S.otsu("ot", "crop", S.K), S.dilate("d", "ink", 9), S.minus("rg0", "d", "ink"), S.clip("rg", "rg0"),
    "tg AS (SELECT c.*, threshold, grey > threshold AS br, r.x IS NOT NULL AS near FROM crop c JOIN ot USING (page_id, region_id) "
    "LEFT JOIN rg r ON r.page_id = c.page_id AND r.region_id = c.region_id AND r.y = c.y AND r.x = c.x)",
    "pa AS (SELECT page_id, region_id, any_value(threshold) AS threshold, CAST(median(grey) FILTER (near) AS DOUBLE) AS bg, avg(CAST(br AS INT)) FILTER (near) AS share FROM tg GROUP BY page_id, region_id)",
    "pm AS (SELECT tg.page_id, tg.region_id, CAST(median(abs(grey - bg)) AS DOUBLE) AS mad FROM tg JOIN pa USING (page_id, region_id) WHERE near GROUP BY ALL)",
    "pol AS (SELECT page_id, region_id, threshold, share < 5e-1 AS inverted, bg, mad, CASE WHEN share < 5e-1 THEN bg - greatest(3e0 * mad, 20e0) END AS wall FROM pa JOIN pm USING (page_id, region_id))",
]


@query("polarity", with_(*POLARITY) + "SELECT * FROM pol", "ink pix crops")
def _(c):
    return P.polarity(c.lines("pix"), ink(c), c.crops)


BINV = "bv AS (SELECT page_id, region_id, y, x FROM tg JOIN pol USING (page_id, region_id) WHERE CASE WHEN inverted THEN NOT br AND (wall IS NULL OR grey > wall) ELSE br END)"


def binarised(c):
    pol = P.polarity(c.lines("pix"), ink(c), c.crops).drop("bg", "mad")
    px_ = P.values(R.box_runs(c.crops), c.lines("pix")).join(pol, RK)
    bright = F.col("grey") > F.col("threshold")
    return P.masked(px_, F.when(F.col("inverted"), ~bright & (F.col("wall").isNull() | (F.col("grey") > F.col("wall")))).otherwise(bright))


SEEDED = [*[p.replace("threshold, grey", "ot.threshold, grey") for p in POLARITY], BINV.replace("grey >", "tg.grey >"), S.labels("bl", "bv", conn=4), """
sd AS (SELECT page_id, region_id, CAST(x1 + floor(avg(x) - x1) AS INT) AS sx, CAST(y1 + floor(avg(y) - y1) AS INT) AS sy FROM ink JOIN crops USING (page_id, region_id) GROUP BY page_id, region_id, x1, y1),
pk AS (SELECT bl.page_id, bl.region_id, lab FROM bl JOIN sd USING (page_id, region_id)
  QUALIFY row_number() OVER (PARTITION BY bl.page_id, bl.region_id ORDER BY (x - sx) * (x - sx) + (y - sy) * (y - sy), y, x) = 1),
sz AS (SELECT p.page_id, p.region_id, p.lab, count(*) >= 5e-2 * any_value((x2 - x1) * (y2 - y1)) AS enough FROM bl JOIN pk p USING (page_id, region_id, lab) JOIN crops c USING (page_id, region_id) GROUP BY ALL),
kp AS (SELECT bl.page_id, bl.region_id, bl.y, bl.x FROM bl JOIN sz USING (page_id, region_id) WHERE bl.lab = sz.lab OR NOT enough)""", S.clip("ic", "ink"), S.join("res", "kp", "ic")]


@query("seeded_region", with_(*SEEDED) + ALL4 + "res", "ink pix crops")
def _(c):
    return px(P.seeded_region(binarised(c), P.ink_centre(ink(c), c.crops), ink(c), c.crops))


HOLES = "(SELECT page_id, region_id, y, x FROM {src} WHERE (x + y) % 5 > 0 OR x % 3 = 1)"


@query("fill_holes", with_(S.clip("ic", "interior"), "mk AS " + HOLES.replace("{src}", "ic"), S.box("bx"), S.minus("bk", "bx", "mk"), S.labels("bl", "bk", conn=4), S.stats("bs", "bl"), """
shut AS (SELECT bl.page_id, bl.region_id, bl.y, bl.x FROM bl JOIN bs USING (page_id, region_id, lab) JOIN crops c USING (page_id, region_id)
  WHERE bx1 > c.x1 AND by1 > c.y1 AND bx2 < c.x2 AND by2 < c.y2)""", S.join("res", "mk", "shut")) + ALL4 + "res", "interior crops")
def _(c):
    mask = R.to_runs(R.to_pixels(R.clip(inner(c), c.crops)).filter("(x + y) % 5 > 0 OR x % 3 = 1").select(*PXCOLS))
    return px(R.fill_holes(mask, c.crops))


# Seeded region, its holes filled, closed, kept to what was bright or inked, eroded; the crop's border does not erode.
@query("interior_masks", with_(*SEEDED, S.join("ib", "bv", "ic"), S.box("hb"), S.minus("hk", "hb", "res"), S.labels("hl", "hk", conn=4), S.stats("hs", "hl"), """
hf AS (SELECT hl.page_id, hl.region_id, hl.y, hl.x FROM hl JOIN hs USING (page_id, region_id, lab) JOIN crops c USING (page_id, region_id)
  WHERE bx1 > c.x1 AND by1 > c.y1 AND bx2 < c.x2 AND by2 < c.y2)""", S.join("ff", "res", "hf"),
    S.dilate("cd0", "ff", 7), S.clip("cd", "cd0"), S.minus("co", "hb", "cd"), S.dilate("c7", "co", 7), S.minus("cl", "cd", "c7"),
    S.join("fb", "ff", "ib"), S.meet("im", "cl", "fb"), S.minus("io", "hb", "im"), S.dilate("i3", "io", 3), S.minus("er", "im", "i3")) + ALL4 + "er", "ink pix crops")
def _(c):
    return px(P.interior_masks(c.lines("pix"), ink(c), c.crops))


@query("fill_masks", with_(S.labels("l", "fill"), """
hit AS (SELECT DISTINCT page_id, region_id, lab FROM l JOIN ink USING (page_id, region_id, y, x)),
np AS (SELECT page_id, region_id, count(DISTINCT lab) AS n FROM l GROUP BY ALL),
kp AS (SELECT l.* FROM l JOIN np USING (page_id, region_id) WHERE n = 1 OR (l.page_id, l.region_id, l.lab) IN (SELECT * FROM hit))""") + """
SELECT page_id, region_id, y, CAST(x AS INT) AS x FROM kp JOIN crops c USING (page_id, region_id) QUALIFY count(*) OVER (PARTITION BY page_id, region_id) <= 97e-2 * (x2 - x1) * (y2 - y1)""", "fill ink crops")
def _(c):
    return px(P.fill_masks(fill(c), ink(c), c.crops))


@query("discovered_parents", """
WITH b AS (SELECT page_id, region_id, min(x) AS bx1, min(y) AS by1, max(x) + 1 AS bx2, max(y) + 1 AS by2, count(*) AS px FROM interior GROUP BY ALL)
SELECT page_id, region_id, bx1, by1, bx2, by2 FROM b JOIN crops USING (page_id, region_id)
WHERE px / 900e0 BETWEEN 15e-2 AND 85e-2 AND bx1 <= x1 + 5 + greatest((x2 - x1 - 10) // 10, 2) AND by1 <= y1 + 5 + greatest((y2 - y1 - 10) // 10, 2)
  AND bx2 >= x2 - 5 - greatest((x2 - x1 - 10) // 10, 2) AND by2 >= y2 - 5 - greatest((y2 - y1 - 10) // 10, 2)""", "interior crops")
def _(c):
    windows = c.crops.select(*RK, F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(30).alias("x2"), F.lit(30).alias("y2"))
    texts = c.crops.select(*RK, *[(F.col(n) + (5 if n[1] == "1" else -5)).alias(n) for n in ("x1", "y1", "x2", "y2")])
    return P.discovered_parents(inner(c), windows, texts)


def disjoin_sql(src: str) -> str:
    return f"""ct AS (SELECT page_id, y, x FROM {src} GROUP BY ALL HAVING count(*) > 1),
cl AS (SELECT i.* FROM {src} i JOIN ct USING (page_id, y, x)),
nd AS (SELECT cl.page_id, cl.region_id, cl.y, cl.x, min((cl.y - k.y) * (cl.y - k.y) + (cl.x - k.x) * (cl.x - k.x)) AS d FROM cl LEFT JOIN ink k ON k.page_id = cl.page_id AND k.region_id = cl.region_id GROUP BY ALL),
ow AS (SELECT *, row_number() OVER (PARTITION BY page_id, y, x ORDER BY d, region_id) AS k FROM nd),
lo AS (SELECT page_id, region_id, y, x FROM ow WHERE k > 1)"""


DISJOIN = disjoin_sql("interior")


@query("disjoin", with_(DISJOIN, S.minus("res", "interior", "lo")) + ALL4 + "res", "interior ink")
def _(c):
    return px(P.disjoin(inner(c), ink(c)))


# On every other page regions 0 and 1 share a parent; on some its box holds no ink of region 1.
MEMBERS = """SELECT page_id, region_id, 7 AS parent_id, 0 AS px1, 0 AS py1, CASE WHEN page_id % 6 = 0 THEN 20 ELSE 46 END AS px2, 46 AS py2
FROM {crops} WHERE page_id % 2 = 0 AND region_id < 2"""
SHARE = f"""mem AS ({MEMBERS.format(crops="crops")}),
mg AS (SELECT DISTINCT page_id, parent_id, y, x FROM interior JOIN mem USING (page_id, region_id)),
si AS (SELECT page_id, region_id, y, x FROM ink JOIN mem USING (page_id, region_id) WHERE x >= px1 AND x < px2 AND y >= py1 AND y < py2),
cn AS (SELECT c.page_id, c.region_id, c.y1 + CAST(floor(avg(y) - any_value(c.y1)) AS INT) AS y, c.x1 + CAST(floor(avg(x) - any_value(c.x1)) AS INT) AS x
  FROM crops c JOIN ink USING (page_id, region_id) GROUP BY c.page_id, c.region_id, c.y1, c.x1),
sd AS (SELECT * FROM si UNION ALL SELECT page_id, region_id, greatest(least(y, py2 - 1), py1), greatest(least(x, px2 - 1), px1)
  FROM cn JOIN mem USING (page_id, region_id) ANTI JOIN si USING (page_id, region_id)),
sq AS (SELECT mg.page_id, mem.region_id, mg.y, mg.x, min((mg.y - sd.y) * (mg.y - sd.y) + (mg.x - sd.x) * (mg.x - sd.x)) AS d
  FROM mg JOIN mem USING (page_id, parent_id) JOIN sd ON sd.page_id = mem.page_id AND sd.region_id = mem.region_id GROUP BY ALL),
lobe AS (SELECT page_id, region_id, y, x FROM sq QUALIFY row_number() OVER (PARTITION BY page_id, y, x ORDER BY d, region_id) = 1)"""
SEPARATE = (SHARE, "dealt AS (SELECT * FROM lobe UNION ALL SELECT i.page_id, i.region_id, i.y, i.x FROM interior i ANTI JOIN lobe USING (page_id, region_id))",
            disjoin_sql("dealt"), S.minus("sep", "dealt", "lo"))


def members(c):
    return c.spark.sql(MEMBERS, crops=c.crops)


@query("share_interior", with_(SHARE) + ALL4 + "lobe", "interior ink crops")
def _(c):
    return px(P.share_interior(inner(c), ink(c), c.crops, members(c)))


@query("separate_interiors", with_(*SEPARATE) + ALL4 + "sep", "interior ink crops")
def _(c):
    return px(P.separate_interiors(inner(c), ink(c), c.crops, members(c))[0])


@query("separate_boxes", with_(*SEPARATE) + "SELECT page_id, region_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM sep GROUP BY ALL", "interior ink crops")
def _(c):
    return P.separate_interiors(inner(c), ink(c), c.crops, members(c))[1]


def residue_sql(dev: int) -> list[str]:
    return [
        S.box("rb"), S.clip("ro", "ink"), S.minus("rp", "rb", "ro"),
        "rbg AS (SELECT page_id, region_id, median(grey) AS bg FROM rp JOIN after USING (page_id, y, x) GROUP BY ALL)",
        S.dilate("rd0", "ro", 3), S.clip("rd", "rd0"), S.meet("rn", "rd", "interior"), S.join("rs0", "ro", "rn"), S.dilate("rw", "interior", 7), S.meet("rs", "rs0", "rw"),
        f"rh AS (SELECT page_id, region_id, y, x FROM rs JOIN after USING (page_id, y, x) JOIN rbg USING (page_id, region_id) WHERE abs(grey - bg) > {dev})",
        S.labels("rl", "rh"), "rz AS (SELECT page_id, region_id, lab, count(*) AS n FROM rl GROUP BY ALL)",
        "rt AS (SELECT page_id, region_id, CAST(sum(n) AS BIGINT) AS residue_px, max(n) AS blob FROM rz GROUP BY ALL)",
        """rv AS (SELECT c.page_id, c.region_id, coalesce(residue_px, 0) AS residue_px, coalesce(blob, 0) AS blob,
  (c.page_id % 10 = 0 AND c.region_id = 1) OR coalesce(residue_px, 0) > greatest(30, CAST(trunc(2e-3 * (x2 - x1) * (y2 - y1)) AS INT)) OR coalesce(blob, 0) > 12 AS failed
  FROM crops c LEFT JOIN rt USING (page_id, region_id) WHERE label <> 'SFX')""",
    ]


def verdict(c):
    again = c.crops.filter("page_id % 10 = 0 and region_id = 1")
    return P.residue(c.lines("after"), ink(c), inner(c), c.crops, again)


@query("residue", with_(*residue_sql(20)) + "SELECT * FROM rv", "ink interior after crops")
def _(c):
    return verdict(c)


@query("escalation_masks", with_(*residue_sql(20), "bad AS (SELECT page_id, region_id FROM rv WHERE failed)",
                                 *[x for k in (1, 2) for x in (
                                     "g0_%d AS (SELECT i.* FROM ink i JOIN bad USING (page_id, region_id))" % k, S.dilate(f"g1_{k}", f"g0_{k}", 3 + 2 * k), S.clip(f"g2_{k}", f"g1_{k}"),
                                     S.meet(f"g3_{k}", f"g2_{k}", "rw"))])
       + "SELECT 1 AS round, page_id, region_id, y, x FROM g3_1 UNION ALL SELECT 2, page_id, region_id, y, x FROM g3_2", "ink interior after crops")
def _(c):
    failed = verdict(c).filter("failed")
    each = [px(P.escalation_masks(failed, ink(c), inner(c), c.crops, k)).select(F.lit(k).alias("round"), *PXCOLS) for k in (1, 2)]
    return each[0].unionByName(each[1])


AUDIT = [
    "td AS (SELECT * FROM crops WHERE label <> 'SFX')", "ai AS (SELECT ink.* FROM ink JOIN td USING (page_id, region_id))", "an AS (SELECT i.* FROM interior i JOIN td USING (page_id, region_id))",
    S.dilate("ag", "ai", 5), S.minus("ar", "an", "ag"), S.box("ab", "td"), S.minus("as_", "ab", "ag"),
    "aq AS (SELECT page_id, region_id, count(*) AS n FROM ar GROUP BY ALL)",
    "ax AS (SELECT ar.* FROM ar JOIN aq USING (page_id, region_id) WHERE n >= 50 UNION ALL SELECT s.* FROM as_ s LEFT JOIN aq USING (page_id, region_id) WHERE coalesce(n, 0) < 50)",
    "abg AS (SELECT page_id, region_id, median(grey) AS bg FROM ax JOIN after USING (page_id, y, x) GROUP BY ALL)", S.meet("ac", "ag", "an"),
    "ah AS (SELECT page_id, region_id, y, x FROM ac JOIN after USING (page_id, y, x) JOIN abg USING (page_id, region_id) WHERE abs(grey - bg) > 16)",
    S.labels("al", "ah"), S.stats("az", "al"),
    "ap AS (SELECT page_id, region_id, area, CASE WHEN greatest(width, height) >= 12 OR greatest(width, height) / CAST(greatest(least(width, height), 1) AS DOUBLE) >= 3 THEN 'line' ELSE 'dot' END AS kind, "
    "CAST(bx1 AS INT) AS bx1, by1, CAST(bx2 AS INT) AS bx2, by2 FROM az)",
]


@query("clean_audit", with_(*AUDIT) + """
SELECT page_id, region_id, CAST(sum(area) AS BIGINT) AS bad_px, count(*) AS components, max(area) AS max_area, count(*) FILTER (kind = 'line') AS lines,
  grouping_id(page_id, region_id) AS level FROM ap GROUP BY ROLLUP (page_id, region_id)""", "ink interior after crops")
def _(c):
    return P.clean_audit(c.lines("after"), ink(c), inner(c), c.crops)[1]


@query("dirty_components", with_(*AUDIT) + """
SELECT page_id, region_id, kind, area, bx1, by1, bx2, by2, row_number() OVER (PARTITION BY page_id, kind ORDER BY area DESC, region_id, by1, bx1, bx2, by2) AS rank FROM ap QUALIFY rank <= 20""", "ink interior after crops")
def _(c):
    from pagelens.operators.grouping import top_k

    parts = P.clean_audit(c.lines("after"), ink(c), inner(c), c.crops)[0]
    order = [-F.col("area"), *[F.col(n) for n in ("region_id", "by1", "bx1", "bx2", "by2")]]
    return top_k(parts, ["page_id", "kind"], order, 20).drop("width", "height")


@query("lasting_ink", with_("""bg AS (SELECT page_id, region_id, median(grey) AS bg FROM interior JOIN after USING (page_id, y, x) GROUP BY ALL),
odd AS (SELECT page_id, region_id, y, x FROM interior JOIN bg USING (page_id, region_id) JOIN after USING (page_id, y, x) JOIN pix p USING (page_id, y, x) WHERE abs(after.grey - bg) > 16 AND abs(p.grey - bg) > 16)""",
    S.labels("l", "odd"), S.stats("s", "l")) + """
SELECT page_id, region_id, CASE WHEN greatest(width, height) >= 10 OR greatest(width, height) / CAST(least(width, height) AS DOUBLE) >= 3 THEN 'line' ELSE 'dot' END AS kind, area, bx1, by1, bx2, by2 FROM s WHERE area >= 2""", "interior after pix")
def _(c):
    return P.lasting_ink(c.lines("pix"), c.lines("after"), inner(c))


@query("dark_share", """
SELECT page_id, region_id, avg(CAST(grey < 110 AS INT)) AS dark FROM crops JOIN pix USING (page_id) WHERE y >= y1 AND y < y2 AND x >= x1 AND x < x2 GROUP BY ALL""", "crops pix")
def _(c):
    return P.dark_share(c.crops, c.lines("pix"), RK).select("page_id", "region_id", "dark")


@query("leakage", """
SELECT page_id, a, b, overlap_px, coalesce(outside_px, 0) AS outside_px FROM (
  SELECT a.page_id, a.region_id AS a, b.region_id AS b, count(*) AS overlap_px FROM interior a JOIN interior b USING (page_id, y, x) WHERE a.region_id < b.region_id GROUP BY ALL)
LEFT JOIN (SELECT k.page_id, count(DISTINCT k.y * 100 + k.x) AS outside_px FROM wide k ANTI JOIN interior i ON i.page_id = k.page_id AND i.y = k.y AND i.x = k.x GROUP BY 1) USING (page_id)""".replace("FROM wide k",
    "FROM (SELECT page_id, y + dy AS y, x + dx AS x FROM ink, (VALUES " + S.offsets(9) + ") o(dy, dx)) k"), "interior ink")
def _(c):
    over, out = P.leakage(inner(c), R.dilate(ink(c), 9))
    return over.join(out, "page_id", "left").select("page_id", "a", "b", "overlap_px", F.coalesce("outside_px", F.lit(0)).cast("bigint").alias("outside_px"))


@query("image_diff", """
SELECT page_id, avg(d) / 3 AS mae, count(*) FILTER (d > 120) AS changed_px, max(d) = 0 AS same FROM (
  SELECT page_id, abs(r - grey) + abs(g - grey) + abs(b - grey) AS d FROM rgb JOIN after USING (page_id, y, x)) GROUP BY page_id""", "rgb after")
def _(c):
    flat = c.after.select("page_id", "y", "x", *[F.col("grey").alias(ch) for ch in "rgb"])
    return P.image_diff(c.rgb, flat)


BAND = "band AS (SELECT page_id, region_id, y1 + 6 AS y0, y1 + 12 AS y1 FROM crops)"


@query("free_runs", with_(BAND, "fr AS (SELECT i.page_id, i.region_id, 0 AS y, i.x FROM interior i JOIN band b USING (page_id, region_id) WHERE i.y >= b.y0 AND i.y < b.y1 GROUP BY ALL HAVING count(*) = 6)",
                          S.runs("r", "fr")) + """
SELECT page_id, region_id, CAST(x0 AS INT) AS lo, CAST(x1 - 1 AS INT) AS hi FROM r QUALIFY row_number() OVER (PARTITION BY page_id, region_id ORDER BY x1 - x0 DESC, x0) = 1""", "interior crops")
def _(c):
    bands = c.crops.select(*RK, (F.col("y1") + 6).alias("band_y0"), (F.col("y1") + 12).alias("band_y1"))
    return P.free_runs(inner(c), bands)


def rooms_sql(name: str, sizes: str) -> str:
    """``page_id, region_id, z, lims``: widths of the lines in a shape for ``sizes`` (page_id, region_id, z)."""
    return f"""{name}_t AS (SELECT page_id, region_id, min(y) AS y0 FROM interior GROUP BY ALL),
{name}_p AS (SELECT page_id, region_id, z, (y - y0) // z AS y, x FROM interior JOIN {name}_t USING (page_id, region_id) JOIN {sizes} USING (page_id, region_id) GROUP BY ALL HAVING count(*) = any_value(z)),
{S.runs(name + "_r", name + "_p", "page_id, region_id, z")},
{name} AS (SELECT page_id, region_id, z, list(CAST(room AS BIGINT) * 1000 // z ORDER BY y) AS lims FROM (SELECT page_id, region_id, z, y, max(x1 - x0) AS room FROM {name}_r GROUP BY ALL) GROUP BY ALL)"""


def held_sql(widths: str, lims: str) -> str:
    """Words of ``widths`` that lines hold, one word at a time: line, room used, words so far."""
    line = f"coalesce(list_position(list_transform({lims}, lambda l, i: i >= s.line AND l >= w + CASE WHEN i = s.line AND s.used > 0 THEN s.used + 255 ELSE 0 END), true), 0)"
    return f"""list_reduce({widths}, lambda s, w: CASE WHEN NOT s.go OR {line} = 0 THEN {{'line': s.line, 'used': s.used, 'n': s.n, 'go': false}}
  WHEN {line} = s.line AND s.used > 0 THEN {{'line': s.line, 'used': CAST(s.used + 255 + w AS BIGINT), 'n': s.n + 1, 'go': true}}
  ELSE {{'line': CAST({line} AS BIGINT), 'used': CAST(w AS BIGINT), 'n': s.n + 1, 'go': true}} END, {{'line': CAST(1 AS BIGINT), 'used': CAST(0 AS BIGINT), 'n': 0, 'go': true}}).n"""


def _figures() -> str:
    words = X.FILLER.split()
    letters = [sum_width(X.LONG_WORD[:n]) for n in range(2, 25)]
    return f"""fd AS (SELECT DISTINCT lims FROM ro),
fg AS (SELECT lims, {held_sql(str([sum_width(w) for w in words]), "lims")} AS n, len(list_filter({letters}, lambda w: w <= list_max(lims))) AS l FROM fd),
fi AS (SELECT page_id, region_id, z, CASE WHEN n > 0 THEN list_sum({[len(w) for w in words]}[1:n]) + n - 1 ELSE 0 END AS ch, CASE WHEN l > 0 THEN l + 1 ELSE 0 END AS wo FROM ro JOIN fg USING (lims)),
fz AS (SELECT s.page_id, s.region_id, cap, CAST(coalesce(a.ch, 0) AS INT) AS soft, CAST(coalesce(b.ch, 0) AS INT) AS lo, CAST(coalesce(a.wo, 0) AS INT) AS word_soft, CAST(coalesce(b.wo, 0) AS INT) AS wlo FROM si s
  LEFT JOIN fi a ON a.page_id = s.page_id AND a.region_id = s.region_id AND a.z = s.cap LEFT JOIN fi b ON b.page_id = s.page_id AND b.region_id = s.region_id AND b.z = s.low)"""


@query("shape_budgets", with_("si AS (SELECT page_id, region_id, CAST(3 + (page_id + region_id) % 4 AS INT) AS cap, 2 AS low FROM crops)",
                              "sz AS (SELECT page_id, region_id, cap AS z FROM si UNION SELECT page_id, region_id, low FROM si)", rooms_sql("ro", "sz"), _figures()) + """
SELECT page_id, region_id, cap, soft, greatest(soft, lo) AS hard, word_soft, greatest(word_soft, wlo) AS word_hard FROM fz""", "interior crops")
def _(c):
    return capacity.shape_budgets(inner(c), c.crops, 3 + (F.col("page_id") + F.col("region_id")) % 4, F.lit(2))


SAID = "SELECT page_id, region_id, rtrim(substr('SO THE PREZ HAS ALL THE NOTES ', 1, CAST(3 + (page_id * 7 + region_id * 5) % 26 AS INT))) AS text FROM {crops}"


@query("shape_sizes", with_("sa AS (" + SAID.replace("{crops}", "crops") + ")", "sz AS (SELECT page_id, region_id, CAST(unnest(range(1, 9)) AS INT) AS z FROM crops)", rooms_sql("ro", "sz"),
                            "sw AS (SELECT page_id, region_id, list_transform(string_split(text, ' '), lambda w: CAST(85 * list_sum(list_transform(string_split(w, ''), lambda h: CASE WHEN h = 'I' THEN 3 WHEN h IN ('M', 'W') THEN 9 ELSE 6 END)) AS BIGINT)) AS wl FROM sa)") + f"""
SELECT page_id, region_id, CAST(coalesce(max(z) FILTER (n = len(wl)), 0) AS INT) AS best_size FROM (SELECT c.page_id, c.region_id, z, wl, {held_sql("wl", "lims")} AS n
  FROM sa c JOIN sw USING (page_id, region_id) LEFT JOIN ro USING (page_id, region_id)) GROUP BY ALL""", "interior crops")
def _(c):
    said = c.spark.sql(SAID, crops=c.crops)
    return capacity.shape_sizes(said, inner(c), 1, 8).select("page_id", "region_id", "best_size")


@query("block_slack", """
WITH bl AS (SELECT page_id, region_id, x1 + 5 AS bx0, x2 - 5 AS bx1, y1 + 10 AS a, y1 + 13 AS b, y1 AS top, y2 AS bottom FROM crops),
rw AS (SELECT page_id, region_id, i.y, a, b, top, bottom FROM interior i JOIN bl USING (page_id, region_id)
  GROUP BY page_id, region_id, i.y, a, b, top, bottom, bx0, bx1 HAVING bx1 > bx0 AND count(*) FILTER (i.x >= bx0 AND i.x < bx1) >= 2e-1 * (bx1 - bx0)),
isl AS (SELECT *, y - row_number() OVER (PARTITION BY page_id, region_id ORDER BY y) AS g FROM rw),
sp AS (SELECT page_id, region_id, a, b, top, bottom, min(y) AS lo, max(y) AS hi FROM isl GROUP BY page_id, region_id, a, b, top, bottom, g)
SELECT page_id, region_id, a - greatest(lo, top + 1) AS above, least(hi, bottom - 1) - b AS below FROM sp
QUALIFY row_number() OVER (PARTITION BY page_id, region_id ORDER BY least(hi, b) - greatest(lo, a) DESC, lo) = 1""", "interior crops")
def _(c):
    blocks = c.crops.select(*RK, (F.col("x1") + 5).alias("bx0"), (F.col("x2") - 5).alias("bx1"), (F.col("y1") + 10).alias("ink_a"), (F.col("y1") + 13).alias("ink_b"),
                            F.lit(1).alias("pad"), F.col("y1").alias("top"), F.col("y2").alias("bottom"))
    return P.block_slack(inner(c), blocks)


@query("mask_moments", """
SELECT c.page_id, c.region_id, coalesce(CAST(trunc(sx / px) AS INT), (x1 + x2) // 2) AS cx, coalesce(CAST(trunc(sy / px) AS INT), (y1 + y2) // 2) AS cy,
  CAST(coalesce(px, (x2 - x1) * (y2 - y1)) AS BIGINT) AS px, coalesce(px, (x2 - x1) * (y2 - y1)) / CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS fill_share,
  coalesce(mx1, x1) AS eff_x1, coalesce(my1, y1) AS eff_y1, coalesce(mx2, x2) AS eff_x2, coalesce(my2, y2) AS eff_y2
FROM crops c LEFT JOIN (SELECT page_id, region_id, count(*) AS px, sum(x) * 1e0 AS sx, sum(y) * 1e0 AS sy, min(x) AS mx1, min(y) AS my1, max(x) + 1 AS mx2, max(y) + 1 AS my2
  FROM fill GROUP BY ALL) m ON m.page_id = c.page_id AND m.region_id = c.region_id""", "fill crops")
def _(c):
    return P.mask_moments(fill(c), c.crops)


@query("ink_colour", """
SELECT c.page_id, c.region_id, coalesce(lum, 255e0) AS luminance, CASE WHEN coalesce(lum, 255) < 128 THEN 'white' ELSE 'black' END AS ink_colour FROM crops c LEFT JOIN
 (SELECT page_id, region_id, CAST(median(grey) AS DOUBLE) AS lum FROM interior JOIN pix USING (page_id, y, x) GROUP BY ALL) m ON m.page_id = c.page_id AND m.region_id = c.region_id""", "interior pix crops")
def _(c):
    return P.ink_colour(inner(c), c.lines("pix"), c.crops)


STATE = "SELECT page_id, region_id, CAST((page_id + region_id) % 3 AS INT) AS hyphens, CAST(page_id % 2 AS INT) AS overflow, CAST(20 - page_id % 4 AS INT) AS size FROM {crops}"


@query("reclaim_candidates", with_(DISJOIN, S.minus("dj", "interior", "lo"), "st AS (" + STATE.replace("{crops}", "crops") + ")", S.minus("fr", "fill", "dj"),
    "ca AS (SELECT f.* FROM fr f JOIN (SELECT DISTINCT page_id, y, x FROM dj) t USING (page_id, y, x) ANTI JOIN ink k ON k.page_id = f.page_id AND k.y = f.y AND k.x = f.x "
    "ANTI JOIN (SELECT * FROM dj WHERE region_id = 2) s ON s.page_id = f.page_id AND s.y = f.y AND s.x = f.x)",
    "cs AS (SELECT page_id, region_id, count(*) AS px FROM ca GROUP BY ALL)") + """
SELECT page_id, region_id, px, row_number() OVER (PARTITION BY page_id ORDER BY hyphens DESC, overflow DESC, size, region_id) AS turn
FROM cs JOIN st USING (page_id, region_id) WHERE hyphens > 0 OR overflow > 0""", "interior ink fill crops")
def _(c):
    return P.reclaim_candidates(fill(c), P.disjoin(inner(c), ink(c)), ink(c), c.crops, c.spark.sql(STATE, crops=c.crops))


@query("lettering_measures", with_("ik AS (SELECT page_id, region_id, y, x FROM interior JOIN pix USING (page_id, y, x) WHERE grey < 110)", S.labels("l", "ik"), S.stats("s", "l"), """
gl AS (SELECT page_id, region_id, median(height) AS cap, count(*) AS n, max(height) - min(height) AS hs FROM s WHERE height BETWEEN 4 AND 60 AND width BETWEEN 2 AND 60 AND area >= 6 GROUP BY ALL HAVING count(*) >= 4),
mo AS (SELECT page_id, region_id, CAST(height AS DOUBLE) AS mode FROM (SELECT page_id, region_id, height, count(*) AS n FROM s WHERE height BETWEEN 4 AND 60 AND width BETWEEN 2 AND 60 AND area >= 6 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY page_id, region_id ORDER BY n DESC, height) = 1),
bb AS (SELECT page_id, region_id, min(x) AS ix0, max(x) + 1 AS ix1, min(y) AS iy0, max(y) AS iy1 FROM ik GROUP BY ALL HAVING count(*) >= 40),
nn AS (SELECT page_id, region_id, min(x) AS b0, max(x) + 1 AS b1 FROM interior i JOIN bb USING (page_id, region_id) WHERE y BETWEEN iy0 AND iy1 GROUP BY ALL),
rw AS (SELECT page_id, region_id, y, lag(y) OVER (PARTITION BY page_id, region_id ORDER BY y) AS py FROM (SELECT DISTINCT page_id, region_id, y FROM ik)),
st AS (SELECT page_id, region_id, y - lag(y) OVER (PARTITION BY page_id, region_id ORDER BY y) AS gap FROM rw WHERE py IS NULL OR y - py > 1),
ln AS (SELECT page_id, region_id, count(*) AS lines, CAST(median(gap) AS DOUBLE) AS pitch FROM st GROUP BY ALL)""") + """
SELECT page_id, region_id, CAST(cap AS DOUBLE) AS cap, cap / least(x2 - x1, y2 - y1) AS cap_ratio, ((ix0 - b0) + (b1 - ix1)) / 2e0 / least(x2 - x1, y2 - y1) AS margin_ratio,
  (ix1 - ix0) / CAST(b1 - b0 AS DOUBLE) AS width_use, lines, pitch, pitch / cap AS pitch_per_cap, hs AS height_spread, mode
FROM bb JOIN gl USING (page_id, region_id) JOIN mo USING (page_id, region_id) JOIN nn USING (page_id, region_id) JOIN ln USING (page_id, region_id) JOIN crops USING (page_id, region_id)""", "interior pix crops")
def _(c):
    return P.lettering_measures(inner(c), c.lines("pix"), c.crops)


@query("compare_masks", """
WITH ar AS (SELECT page_id, region_id, (x2 - x1) * (y2 - y1) * 1e0 AS crop FROM crops),
k AS (SELECT page_id, region_id, count(*) * 1e0 AS n FROM ink GROUP BY ALL),
o AS (SELECT page_id, region_id, count(*) AS px, avg(CAST(grey <= 110 AS INT)) AS dk FROM interior JOIN pix USING (page_id, y, x) GROUP BY ALL),
w AS (SELECT page_id, region_id, count(*) AS px, avg(CAST(grey <= 110 AS INT)) AS dk FROM fill JOIN pix USING (page_id, y, x) GROUP BY ALL),
oh AS (SELECT page_id, region_id, count(*) AS n FROM interior JOIN ink USING (page_id, region_id, y, x) GROUP BY ALL),
wh AS (SELECT page_id, region_id, count(*) AS n FROM fill JOIN ink USING (page_id, region_id, y, x) GROUP BY ALL)
SELECT page_id, region_id, coalesce(o.px, 0) / crop AS old_cover, coalesce(oh.n, 0) / k.n AS old_ink, coalesce(o.dk, 0) AS old_dark,
  coalesce(w.px, 0) / crop AS new_cover, coalesce(wh.n, 0) / k.n AS new_ink, coalesce(w.dk, 0) AS new_dark, coalesce(w.dk, 0) - coalesce(o.dk, 0) AS dark_increase
FROM ar LEFT JOIN k USING (page_id, region_id) LEFT JOIN o USING (page_id, region_id) LEFT JOIN w USING (page_id, region_id) LEFT JOIN oh USING (page_id, region_id) LEFT JOIN wh USING (page_id, region_id)""", "interior fill ink pix crops")
def _(c):
    return P.compare_masks(inner(c), fill(c), ink(c), c.lines("pix"), c.crops)


def leak_sql(fill: str, *first: str) -> str:
    return with_(*first, S.dilate("wd", "ink", 13), S.dilate("tt", "ink", 5), S.meet("n0", fill, "wd"), S.minus("nr", "n0", "tt"), S.minus("fr", fill, "wd"), f"""
tn AS (SELECT page_id, region_id, count(*) AS px, avg(CAST(grey < 110 AS INT)) AS dk FROM {fill} JOIN pix USING (page_id, y, x) GROUP BY ALL),
hd AS (SELECT page_id, region_id, count(*) AS h FROM {fill} JOIN ink USING (page_id, region_id, y, x) GROUP BY ALL), ik AS (SELECT page_id, region_id, count(*) AS n FROM ink GROUP BY ALL),
nv AS (SELECT page_id, region_id, grey, CAST(median(grey) OVER (PARTITION BY page_id, region_id) AS DOUBLE) AS m FROM nr JOIN pix USING (page_id, y, x)),
fv AS (SELECT page_id, region_id, grey, CAST(median(grey) OVER (PARTITION BY page_id, region_id) AS DOUBLE) AS m FROM fr JOIN pix USING (page_id, y, x)),
nm AS (SELECT page_id, region_id, any_value(m) AS nm, median(abs(grey - m)) * 14826e-4 AS ns, count(*) AS np FROM nv GROUP BY ALL),
fm AS (SELECT page_id, region_id, any_value(m) AS fm, median(abs(grey - m)) * 14826e-4 AS fs, count(*) AS fp FROM fv GROUP BY ALL)""") + """
SELECT page_id, region_id, tn.px / ((x2 - x1) * (y2 - y1) * 1e0) AS box_share, coalesce(h, 0) / (n * 1e0) AS ink_held, dk AS dark_share, nm AS near_median, ns AS near_spread, fm AS far_median, fs AS far_spread,
  abs(nm - fm) AS median_gap, coalesce(np >= 30 AND fp >= 30, false) AS tested
FROM crops JOIN tn USING (page_id, region_id) LEFT JOIN ik USING (page_id, region_id) LEFT JOIN hd USING (page_id, region_id) LEFT JOIN nm USING (page_id, region_id) LEFT JOIN fm USING (page_id, region_id)"""


@query("fill_leak", leak_sql("fill"), "fill ink pix crops")
def _(c):
    return P.fill_leak(fill(c), ink(c), c.lines("pix"), c.crops)


@query("fill_controls", leak_sql("ct", S.box("fb", "crops"), S.minus("fo", "fb", "fill"), S.labels("el", "fo"), S.stats("es", "el"), """
et AS (SELECT es.* FROM es JOIN crops USING (page_id, region_id) WHERE (bx1 = x1 OR by1 = y1 OR bx2 = x2 OR by2 = y2)
  QUALIFY row_number() OVER (PARTITION BY page_id, region_id ORDER BY area DESC, lab DESC) <= 2),
ct AS (SELECT page_id, region_id, y, x FROM fill UNION SELECT el.page_id, el.region_id, el.y, el.x FROM el JOIN et USING (page_id, region_id, lab))"""), "fill ink pix crops")
def _(c):
    control = R.union(fill(c), P.edge_background(fill(c), c.crops))
    return P.fill_leak(control, ink(c), c.lines("pix"), c.crops)


@query("colour_marks", with_("rd AS (SELECT page_id, y, x FROM rgb WHERE r > 110 AND r - g > 50 AND r - b > 50)", S.labels("l", "rd", "page_id"), S.stats("s", "l", "page_id"), """
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, by1, bx1, lab) AS rank FROM s)""") + """
SELECT page_id, rank, area, CAST(bx1 - 6 AS INT) AS x1, by1 - 6 AS y1, CAST(bx2 + 6 AS INT) AS x2, by2 + 6 AS y2 FROM k WHERE rank <= 4 AND area >= 30""", "rgb")
def _(c):
    return P.colour_marks(c.lines("rgb"))


@query("lost_outline", with_(*GUARD, """
bo AS (SELECT p.page_id, p.y, p.x, p.grey < 110 AS was, a.grey > 170 AS gone FROM pix p JOIN after a USING (page_id, y, x)),
ln AS (SELECT page_id, region_id, count(*) FILTER (was) AS line_px, count(*) FILTER (was AND gone) AS lost_px FROM gb JOIN bo USING (page_id, y, x) GROUP BY ALL),
sy AS (SELECT page_id, region_id, count(*) FILTER (was AND NOT gone) AS stay_px FROM interior JOIN bo USING (page_id, y, x) GROUP BY ALL),
kp AS (SELECT page_id, region_id, count(*) AS k FROM gb JOIN guard USING (page_id, y, x) GROUP BY ALL)""") + """
SELECT page_id, region_id, line_px, lost_px, CASE WHEN line_px > 0 THEN 100e0 * lost_px / line_px ELSE 0 END AS lost_pct, coalesce(k, 0) AS kept_px, stay_px
FROM ln JOIN sy USING (page_id, region_id) LEFT JOIN kp USING (page_id, region_id)""", "interior pix after")
def _(c):
    return P.lost_outline(c.pix, c.after, inner(c), guard(c), frame(c))


@query("clearance", with_(S.dilate("wd", "ink", 7), S.minus("ot", "wd", "interior"), S.meet("ns", "wd", "interior"), S.dilate("rm0", "interior", 3), S.minus("rm", "rm0", "interior"), """
oc AS (SELECT page_id, region_id, count(*) AS n FROM ot GROUP BY ALL),
gp AS (SELECT a.page_id, a.region_id, sqrt(CAST(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS DOUBLE)) AS g FROM ns a JOIN rm b ON a.page_id = b.page_id AND a.region_id = b.region_id GROUP BY ALL)""") + """
SELECT DISTINCT page_id, region_id, coalesce(n, 0) AS outside_px, g AS least_gap FROM ink LEFT JOIN oc USING (page_id, region_id) LEFT JOIN gp USING (page_id, region_id)""", "interior ink")
def _(c):
    return P.clearance(R.dilate(ink(c), 7), inner(c))


# Which page each cleaned one comes from. The oracle compares all pairs of different images.
@query("nearest_image", """
WITH t AS (SELECT page_id, list(grey ORDER BY y, x) AS v FROM after GROUP BY page_id),
c AS (SELECT page_id, list(grey ORDER BY y, x) AS v FROM pix GROUP BY page_id),
tu AS (SELECT v, list(page_id) AS ids FROM t GROUP BY v), cu AS (SELECT v, min(page_id) AS id FROM c GROUP BY v),
p AS (SELECT ids, id, list_sum(list_transform(list_zip(tu.v, cu.v), lambda z: abs(z[1] - z[2]))) AS sad FROM tu, cu),
m AS (SELECT ids, min(sad) AS sad, arg_min(id, (sad, id)) AS id FROM p GROUP BY ids)
SELECT unnest(ids) AS target_id, id AS cand_id, sad / 2304e0 AS mae FROM m""", "after pix")
def _(c):
    return alike.nearest_image(c.after, c.pix)[0]

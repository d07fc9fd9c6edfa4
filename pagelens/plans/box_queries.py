"""Box and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.operators import boxes as B
from pagelens.operators import ordering as O
from pagelens.operators.grouping import top_k
from pagelens.plans.registry import query

TEXT = "cls <> 0"
GLYPH = "score / 1000e0 * 60"


@query("box_measures", """
SELECT page_id, det_id, x2 - x1 AS width, y2 - y1 AS height, CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS area,
       (x1 + x2) / 2e0 AS cx, (y1 + y2) / 2e0 AS cy FROM det""", "det")
def _(c):
    return B.with_box_measures(c.det).select("page_id", "det_id", "width", "height", "area", "cx", "cy")


RAW = """SELECT page_id, det_id, x1 - 30 + score % 8 / 8e0 AS x1, y1 - 30 + score % 4 / 4e0 AS y1,
       x1 - 30 + score % 8 / 8e0 + score % 300 AS x2, y2 + 0.5e0 AS y2 FROM {det}"""


@query("clip_boxes", """
WITH raw AS (""" + RAW.replace("{det}", "det") + """),
cl AS (SELECT page_id, det_id, least(greatest(x1, 0), w) AS x1, least(greatest(y1, 0), h) AS y1,
              least(greatest(x2, 0), w) AS x2, least(greatest(y2, 0), h) AS y2 FROM raw JOIN frames USING (page_id)),
tr AS (SELECT page_id, det_id, CAST(trunc(x1) AS INT) AS x1, CAST(trunc(y1) AS INT) AS y1,
              CAST(trunc(x2) AS INT) AS x2, CAST(trunc(y2) AS INT) AS y2 FROM cl)
SELECT * FROM tr WHERE x2 - x1 >= 4 AND y2 - y1 >= 4""", "det frames")
def _(c):
    raw = c.spark.sql(RAW, det=c.det)
    return B.truncate_boxes(B.clip_boxes(raw, c.frames))


PLAN_SQL = """plan AS (
SELECT page_id, t AS tile, (t % 2) * (w - tw) AS ox, (t // 2) * (h - th) AS oy, tw, th, w, h FROM (
  SELECT page_id, w, h, CAST(trunc(w * 65e-2) AS INT) AS tw, CAST(trunc(h * 65e-2) AS INT) AS th,
         unnest([0, 1, 2, 3]) AS t FROM frames WHERE greatest(w, h) > 900))"""
TILED_SQL = """dt AS (SELECT page_id, det_id, CAST(det_id % 4 AS INT) AS tile, x1 % 90 AS x1, y1 % 80 AS y1,
       x1 % 90 + score AS x2, y1 % 80 + score AS y2, score FROM det),
ok AS (SELECT d.*, p.ox, p.oy FROM dt d JOIN plan p USING (page_id, tile)
  WHERE NOT ((ox > 0 AND x1 <= 2) OR (oy > 0 AND y1 <= 2) OR (ox + tw < w AND x2 >= tw - 2) OR (oy + th < h AND y2 >= th - 2)))"""


def _tiled(c):
    d = c.det
    return d.select("page_id", "det_id", (F.col("det_id") % 4).cast("int").alias("tile"), (d.x1 % 90).alias("x1"), (d.y1 % 80).alias("y1"),
                    (d.x1 % 90 + d.score).alias("x2"), (d.y1 % 80 + d.score).alias("y2"), "score")


@query("tile_plan", "WITH " + PLAN_SQL + " SELECT * FROM plan", "frames")
def _(c):
    return B.tile_plan(c.frames)


@query("drop_cut_boxes", "WITH " + PLAN_SQL + "," + TILED_SQL + " SELECT page_id, det_id, tile, x1, y1, x2, y2 FROM ok", "det frames")
def _(c):
    return B.drop_cut_boxes(_tiled(c), B.tile_plan(c.frames)).select("page_id", "det_id", "tile", "x1", "y1", "x2", "y2")


@query("merge_passes", "WITH " + PLAN_SQL + "," + TILED_SQL + """
SELECT page_id, det_id, x1, y1, x2, y2, score FROM det UNION ALL
SELECT page_id, det_id, x1 + ox, y1 + oy, x2 + ox, y2 + oy, score FROM ok""", "det frames")
def _(c):
    full = c.det.select("page_id", "det_id", "x1", "y1", "x2", "y2", "score")
    return B.merge_passes(full, B.drop_cut_boxes(_tiled(c), B.tile_plan(c.frames)))


@query("font_bounds", """
WITH f AS (SELECT det.*, w, least(x2 - x1, y2 - y1) AS side,
  CASE WHEN w <= 0 OR w >= 1134 THEN 11 ELSE least(greatest(CAST(round_even(11 * w / 1134e0, 0) AS INT), 6), 11) END AS lo
  FROM det JOIN frames USING (page_id))
SELECT page_id, det_id, lo AS font_floor,
  least(greatest(CAST(round_even(side * 117e-3 / 844e-3, 0) AS INT), lo), 96) AS font_cap, greatest(lo - 2, 6) AS emergency_floor FROM f""", "det frames")
def _(c):
    return B.with_font_bounds(c.det, c.frames).select("page_id", "det_id", "font_floor", "font_cap", "emergency_floor")


@query("stroke_params", """
WITH g AS (SELECT *, score / 1000e0 * 60 AS gl FROM det)
SELECT page_id, det_id, (y2 - y1) > (x2 - x1) * 16e-1 AS is_vertical,
  least(greatest(CAST(round_even(gl * 6e-2, 0) AS INT), 1), 4) AS stroke,
  CAST(least(greatest(CAST(trunc((gl + 30) * 3e-1) AS INT) // 2 * 2 + 1, 3), 31) AS INT) AS kernel FROM g""", "det")
def _(c):
    return B.with_stroke_params(c.det, F.expr(GLYPH)).select("page_id", "det_id", "is_vertical", "stroke", "kernel")


@query("grow_boxes", """
WITH a AS (SELECT page_id, det_id, x1 - 6 AS x1, y1 - 6 AS y1, x2 + 6 AS x2, y2 + 6 AS y2, w, h FROM det JOIN frames USING (page_id)),
a1 AS (SELECT *, greatest(192 - (x2 - x1), 0) AS dw, greatest(192 - (y2 - y1), 0) AS dh FROM a),
b AS (SELECT page_id, det_id, w, h, greatest(x1 - dw // 2, 0) AS x1, greatest(y1 - dh // 2, 0) AS y1,
        least(x2 + dw - dw // 2, w) AS x2, least(y2 + dh - dh // 2, h) AS y2 FROM a1),
b1 AS (SELECT *, greatest(192 - (x2 - x1), 0) AS dw, greatest(192 - (y2 - y1), 0) AS dh FROM b)
SELECT page_id, det_id, greatest(x1 - dw // 2, 0) AS x1, greatest(y1 - dh // 2, 0) AS y1,
        least(x2 + dw - dw // 2, w) AS x2, least(y2 + dh - dh // 2, h) AS y2 FROM b1""", "det frames")
def _(c):
    return B.grow_boxes(c.det.select("page_id", "det_id", "x1", "y1", "x2", "y2"), c.frames, pad=6)


@query("search_windows", """
SELECT page_id, det_id, greatest(x1 - CAST(trunc((x2 - x1) * 4e-1) AS INT), 0) AS wx1, greatest(y1 - CAST(trunc((y2 - y1) * 4e-1) AS INT), 0) AS wy1,
  least(x2 + CAST(trunc((x2 - x1) * 4e-1) AS INT), w) AS wx2, least(y2 + CAST(trunc((y2 - y1) * 4e-1) AS INT), h) AS wy2
FROM det JOIN frames USING (page_id)""", "det frames")
def _(c):
    return B.search_windows(c.det, c.frames).select("page_id", "det_id", "wx1", "wy1", "wx2", "wy2")


INTER = ("CAST(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) AS BIGINT) * "
         "greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)")
AREA = "CAST(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1) AS BIGINT)"
AA, AB = AREA.format("a"), AREA.format("b")


@query("box_pairs", f"""
WITH p AS (SELECT a.page_id, a.det_id AS a_id, b.det_id AS b_id, {INTER} AS i, {AA} AS sa, {AB} AS sb
  FROM det a JOIN det b ON a.page_id = b.page_id AND a.det_id < b.det_id)
SELECT page_id, a_id, b_id, i AS "inter", i / CAST(sa + sb - i AS DOUBLE) AS iou, i / CAST(least(sa, sb) AS DOUBLE) AS contain
FROM p WHERE i >= 1""", "det")
def _(c):
    d = c.det.select("page_id", F.col("det_id").alias("id"), "x1", "y1", "x2", "y2")
    return B.box_pairs(d, d).filter("a_id < b_id").select("page_id", "a_id", "b_id", "inter", "iou", "contain")


SUPPRESS_SQL = f"""l AS (SELECT page_id, cls = 0 AS par, CASE WHEN cls = 0 THEN 65e-2 ELSE 45e-2 END AS t, CASE WHEN cls = 0 THEN 8e-1 ELSE 0e0 END AS c,
  list({{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'cls': cls, 'score': score}} ORDER BY score DESC, det_id) AS bx
  FROM det GROUP BY page_id, par, t, c),
k AS (SELECT page_id, list_reduce(bx, lambda acc, b: CASE WHEN len(list_filter(acc, lambda a:
    ({INTER}) / ({AA} + {AB} - ({INTER}) + 1e-9) > t AND ({INTER}) / (least({AA}, {AB}) + 1e-9) >= c)) > 0
    THEN acc ELSE list_append(acc, b) END, bx[1:0]) AS kept FROM l),
sup AS (SELECT page_id, u.det_id AS det_id, u.x1 AS x1, u.y1 AS y1, u.x2 AS x2, u.y2 AS y2, u.cls AS cls, u.score AS score
  FROM (SELECT page_id, unnest(kept) AS u FROM k))"""


@query("suppress", "WITH " + SUPPRESS_SQL + " SELECT * FROM sup", "det")
def _(c):
    return B.suppress(c.det)


MERGE_SQL = f"""nest AS (SELECT a.page_id, a.det_id AS i, b.det_id AS j FROM sup a JOIN sup b ON a.page_id = b.page_id AND a.det_id <> b.det_id
    AND a.cls <> 0 AND b.cls <> 0 AND {AA} <= {AB} AND ({INTER}) > 0 AND ({INTER}) / CAST({AA} AS DOUBLE) >= 8e-1),
one AS (SELECT page_id, min(i) AS i, j FROM nest GROUP BY page_id, j HAVING count(*) = 1),
ol AS (SELECT page_id, list({{'i': i, 'j': j}} ORDER BY i, j) AS p FROM one GROUP BY page_id),
acc AS (SELECT page_id, list_reduce(p, lambda acc, e: CASE WHEN len(list_filter(acc, lambda x: x.i = e.i OR x.i = e.j)) > 0
    THEN acc ELSE list_append(acc, e) END, p[1:0]) AS ok FROM ol),
lk AS (SELECT page_id, u.i AS i, u.j AS j FROM (SELECT page_id, unnest(ok) AS u FROM acc)),
up AS (SELECT page_id, i, j FROM lk UNION SELECT u.page_id, u.i, l.j FROM up u JOIN lk l ON u.page_id = l.page_id AND u.j = l.i),
root AS (SELECT u.page_id, u.i, u.j FROM up u ANTI JOIN lk l ON u.page_id = l.page_id AND u.j = l.i),
mem AS (SELECT s.*, coalesce(r.j, s.det_id) AS home FROM sup s LEFT JOIN root r ON s.page_id = r.page_id AND s.det_id = r.i WHERE cls <> 0),
mrg AS (SELECT page_id, home AS det_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) - 1 AS absorbed FROM mem GROUP BY page_id, home)"""


@query("merge_nested", "WITH " + SUPPRESS_SQL + "," + MERGE_SQL + " SELECT * FROM mrg", "det")
def _(c):
    return B.merge_nested(B.suppress(c.det).filter(TEXT)).select("page_id", "det_id", "x1", "y1", "x2", "y2", "absorbed")


ASSIGN_SQL = f"""cand AS (SELECT a.page_id, a.det_id, ({INTER}) / CAST({AA} AS DOUBLE) AS cover, {AB} AS size, b.det_id AS ord,
    b.x1 AS px1, b.y1 AS py1, b.x2 AS px2, b.y2 AS py2
  FROM det a JOIN det b ON a.page_id = b.page_id AND a.cls <> 0 AND b.cls = 0 WHERE ({INTER}) / CAST({AA} AS DOUBLE) >= 65e-2),
near AS (SELECT * FROM cand QUALIFY cover >= max(cover) OVER (PARTITION BY page_id, det_id) - 5e-2),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY page_id, det_id ORDER BY size, ord) = 1),
asg AS (SELECT d.page_id, d.det_id, d.x1, d.y1, d.x2, d.y2, CASE WHEN cls = 2 AND px1 IS NOT NULL THEN 1 ELSE cls END AS cls,
    px1 AS parent_x1, py1 AS parent_y1, px2 AS parent_x2, py2 AS parent_y2
  FROM det d LEFT JOIN best b ON d.page_id = b.page_id AND d.det_id = b.det_id WHERE d.cls <> 0)"""


def _assigned(c):
    text = c.det.filter(TEXT).drop("score")
    return B.assign_parents(text, c.det.filter("cls = 0").withColumn("ord", F.col("det_id")))


@query("assign_parents", "WITH " + ASSIGN_SQL + " SELECT * FROM asg", "det")
def _(c):
    return _assigned(c)


@query("redetected", f"""
SELECT page_id, det_id FROM det a WHERE EXISTS (SELECT 1 FROM redet b WHERE a.page_id = b.page_id
  AND ({INTER}) / CAST(greatest({AA} + {AB} - ({INTER}), 1) AS DOUBLE) > 25e-2)""", "det redet")
def _(c):
    return B.redetected(c.det, c.redet).select("page_id", "det_id")


@query("orphan_parents", "WITH " + ASSIGN_SQL + """
SELECT page_id, det_id, x1, y1, x2, y2 FROM det d WHERE cls = 0 AND NOT EXISTS (SELECT 1 FROM asg
  WHERE asg.page_id = d.page_id AND parent_x1 = d.x1 AND parent_y1 = d.y1 AND parent_x2 = d.x2 AND parent_y2 = d.y2)""", "det")
def _(c):
    return B.orphan_parents(c.det.filter("cls = 0"), _assigned(c)).select("page_id", "det_id", "x1", "y1", "x2", "y2")


@query("nearest", """
SELECT page_id, target_id, min(cost) AS cost, arg_min(cand_id, CAST(cost AS BIGINT) * 1000000000 + cand_id) AS cand_id FROM (
  SELECT t.page_id, t.det_id AS target_id, c.det_id AS cand_id, CAST(abs(t.x1 - c.x1) + 2 * abs(t.y1 - c.y1) AS INT) AS cost
  FROM det t JOIN det c ON t.page_id = c.page_id AND t.cls <> 0 AND c.cls = 0) GROUP BY ALL""", "det")
def _(c):
    t = c.det.filter(TEXT).select("page_id", F.col("det_id").alias("target_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    p = c.det.filter("cls = 0").select("page_id", F.col("det_id").alias("cand_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return B.nearest(t, p)


def order_sql(src: str, name: str) -> str:
    return f"""{name}_b AS (SELECT page_id, greatest(CAST(trunc(median(y2 - y1) * 13e-1) AS INT), 20) AS band, list(DISTINCT y1) AS ys FROM {src} GROUP BY page_id),
{name}_a AS (SELECT page_id, list_reduce(list_sort(ys), lambda acc, y: CASE WHEN len(acc) > 0 AND y - acc[-1] < band THEN acc ELSE list_append(acc, y) END, ys[1:0]) AS an FROM {name}_b),
{name} AS (SELECT s.*, CAST(len(list_filter(an, lambda a: a <= y1)) - 1 AS INT) AS row_no FROM {src} s JOIN {name}_a USING (page_id)),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY row_no, x1 DESC, y1, det_id) - 1 AS idx FROM {name})"""


@query("reading_order", "WITH tx AS (SELECT * FROM det WHERE cls <> 0)," + order_sql("tx", "ro") + " SELECT page_id, det_id, row_no, idx FROM ro_o", "det")
def _(c):
    return O.reading_order(c.det.filter(TEXT)).select("page_id", "det_id", "row_no", "idx")


@query("pair_frames", "WITH fa AS (SELECT * FROM det WHERE cls = 1), fb AS (SELECT * FROM det WHERE cls = 2)," + order_sql("fa", "pa") + "," + order_sql("fb", "pb") + """
SELECT a.page_id, a.idx, a.det_id AS a_id, b.det_id AS b_id, h / 1000e0 AS scale,
  least(a.x2 - a.x1, a.y2 - a.y1) - least(b.x2 - b.x1, b.y2 - b.y1) * (h / 1000e0) AS side_diff
FROM pa_o a JOIN pb_o b ON a.page_id = b.page_id AND a.idx = b.idx JOIN frames f ON f.page_id = a.page_id""", "det frames")
def _(c):
    a = O.reading_order(c.det.filter("cls = 1"))
    b = O.reading_order(c.det.filter("cls = 2"))
    heights = c.frames.select("page_id", F.col("h").alias("ha"), F.lit(1000).alias("hb"))
    return O.pair_frames(a, b, heights)


@query("panels", """
WITH tx AS (SELECT * FROM det WHERE cls <> 0),
g AS (SELECT page_id, greatest(CAST(trunc(median(y2 - y1) * 6e-1) AS INT), 20) AS gap FROM tx GROUP BY page_id),
s AS (SELECT *, max(y2) OVER (PARTITION BY page_id ORDER BY y1, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bot FROM tx),
f AS (SELECT s.*, CASE WHEN bot IS NOT NULL AND y1 - bot > gap THEN 1 ELSE 0 END AS st FROM s JOIN g USING (page_id))
SELECT page_id, det_id, CAST(sum(st) OVER (PARTITION BY page_id ORDER BY y1, det_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS panel FROM f""", "det")
def _(c):
    return O.panels(c.det.filter(TEXT)).select("page_id", "det_id", "panel")


# Tighter boxes, so that pages hold several groups.
SMALL = "SELECT page_id, det_id, x1, y1, x1 + 20 + score % 60 AS x2, y1 + 20 + score % 40 AS y2 FROM {det}"
MEETS = "least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)"


@query("overlap_groups", f"""
WITH e AS (SELECT a.page_id, a.det_id AS a, b.det_id AS b FROM det a JOIN det b ON a.page_id = b.page_id AND a.det_id <> b.det_id AND {MEETS}),
r AS (SELECT page_id, a AS node, a AS lab FROM e UNION SELECT r.page_id, e.b, r.lab FROM r JOIN e ON r.page_id = e.page_id AND r.node = e.a)
SELECT page_id, node AS det_id, min(lab) AS grp FROM r GROUP BY page_id, node""", "det")
def _(c):
    return O.overlap_groups(c.det.select("page_id", "det_id", "x1", "y1", "x2", "y2"))


@query("merge_boxes", "WITH sm AS (" + SMALL.replace("{det}", "det") + """),
mb AS (SELECT 0 AS k, page_id, det_id, x1 - 4 AS x1, y1 - 4 AS y1, x2 + 4 AS x2, y2 + 4 AS y2 FROM sm
  UNION ALL SELECT k + 1, page_id, t, min(x1), min(y1), max(x2), max(y2) FROM (
    SELECT * FROM (SELECT a.k, a.page_id, a.det_id, a.x1, a.y1, a.x2, a.y2, min(b.det_id) AS t, count(*) > 1 AS hit
      FROM mb a JOIN mb b ON a.page_id = b.page_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 GROUP BY ALL)
    QUALIFY bool_or(hit) OVER (PARTITION BY page_id)) GROUP BY k, page_id, t)
SELECT page_id, det_id, x1, y1, x2, y2 FROM mb QUALIFY k = max(k) OVER (PARTITION BY page_id)""", "det")
def _(c):
    return O.merge_boxes(c.spark.sql(SMALL, det=c.det), pad=4)


@query("split_parents", "WITH " + ASSIGN_SQL + """,
sh AS (SELECT *, (x1 + x2) / 2e0 AS cx, (y1 + y2) / 2e0 AS cy, count(*) OVER w AS n FROM asg WHERE parent_x1 IS NOT NULL
  WINDOW w AS (PARTITION BY page_id, parent_x1, parent_y1, parent_x2, parent_y2)),
ax AS (SELECT *, max(cx) OVER w - min(cx) OVER w >= max(cy) OVER w - min(cy) OVER w AS hz FROM sh WHERE n >= 2
  WINDOW w AS (PARTITION BY page_id, parent_x1, parent_y1, parent_x2, parent_y2)),
bx AS (SELECT *, CASE WHEN hz THEN x1 ELSE y1 END AS lo, CASE WHEN hz THEN x2 ELSE y2 END AS hi, CASE WHEN hz THEN cx ELSE cy END AS mid,
  CASE WHEN hz THEN parent_x1 ELSE parent_y1 END AS base FROM ax),
gl AS (SELECT page_id, parent_x1, parent_y1, parent_x2, parent_y2, any_value(base) AS base, any_value(hz) AS hz,
  list({'id': det_id, 'lo': lo, 'hi': hi, 'mid': mid} ORDER BY mid, det_id) AS g FROM bx GROUP BY 1, 2, 3, 4, 5),
cu AS (SELECT *, list_reduce(range(1, len(g)), lambda acc, i: list_append(acc, greatest(
   CASE WHEN g[i].hi < g[i + 1].lo THEN (g[i].hi + g[i + 1].lo) // 2 ELSE CAST(trunc((g[i].mid + g[i + 1].mid) / 2) AS INT) END, acc[-1] + 4)), [base]) AS cuts FROM gl),
un AS (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM cu),
sp AS (SELECT page_id, g[i].id AS det_id, CASE WHEN hz THEN cuts[i] ELSE parent_x1 END AS sx1, CASE WHEN hz THEN parent_y1 ELSE cuts[i] END AS sy1,
  CASE WHEN hz AND i < len(g) THEN cuts[i + 1] ELSE parent_x2 END AS sx2, CASE WHEN NOT hz AND i < len(g) THEN cuts[i + 1] ELSE parent_y2 END AS sy2 FROM un)
SELECT a.page_id, a.det_id, sx1 IS NOT NULL AS shared, coalesce(sx1, parent_x1) AS parent_x1, coalesce(sy1, parent_y1) AS parent_y1,
  coalesce(sx2, parent_x2) AS parent_x2, coalesce(sy2, parent_y2) AS parent_y2 FROM asg a LEFT JOIN sp ON a.page_id = sp.page_id AND a.det_id = sp.det_id""", "det")
def _(c):
    return O.split_shared_parents(_assigned(c)).select("page_id", "det_id", "shared", "parent_x1", "parent_y1", "parent_x2", "parent_y2")


@query("top_k", """
SELECT page_id, det_id, row_number() OVER (PARTITION BY page_id ORDER BY (x2 - x1) * (y2 - y1) DESC, det_id) AS rank FROM det QUALIFY rank <= 5""", "det")
def _(c):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return top_k(c.det, ["page_id"], [-area, F.col("det_id")], 5).select("page_id", "det_id", "rank")


GLYPHS = """SELECT page_id, det_id, x1 % 130 AS x1, y1 % 200 AS y1, x1 % 130 + 4 + score % 12 AS x2, y1 % 200 + 6 + score % 14 AS y2 FROM {det}"""


@query("glyph_lines", "WITH gl AS (" + GLYPHS.replace("{det}", "det") + """),
l AS (SELECT page_id, list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det_id': det_id} ORDER BY y1, x1, det_id) AS g FROM gl GROUP BY page_id),
s AS (SELECT page_id, list_transform(g, lambda b: {'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'hs': [b.y2 - b.y1], 'line_id': b.det_id}) AS g FROM l),
f AS (SELECT page_id, list_reduce(g, lambda acc, b: CASE WHEN len(list_filter(acc, lambda n: least(b.y2, n.y2) - greatest(b.y1, n.y1) > 45e-2 * least(b.y2 - b.y1, n.y2 - n.y1) AND b.x1 >= n.x1 - 26 AND b.x1 <= n.x2 + 26)) = 0
    THEN list_append(acc, b)
    ELSE list_transform(acc, lambda n, k: CASE WHEN k = list_position(list_transform(acc, lambda n: least(b.y2, n.y2) - greatest(b.y1, n.y1) > 45e-2 * least(b.y2 - b.y1, n.y2 - n.y1) AND b.x1 >= n.x1 - 26 AND b.x1 <= n.x2 + 26), true)
       THEN {'x1': least(n.x1, b.x1), 'y1': least(n.y1, b.y1), 'x2': greatest(n.x2, b.x2), 'y2': greatest(n.y2, b.y2), 'hs': list_append(n.hs, b.hs[1]), 'line_id': n.line_id} ELSE n END) END, g[1:0]) AS lines FROM s),
u AS (SELECT page_id, unnest(lines) AS n FROM f)
SELECT page_id, n.line_id AS line_id, n.x1 AS x1, n.y1 AS y1, n.x2 AS x2, n.y2 AS y2, CAST(len(n.hs) AS BIGINT) AS glyphs,
  CAST(list_aggregate(list_sort(n.hs)[len(n.hs) - greatest(2, len(n.hs) // 3) + 1:], 'median') AS DOUBLE) AS cap_height FROM u WHERE len(n.hs) >= 3""", "det")
def _(c):
    return O.glyph_lines(c.spark.sql(GLYPHS, det=c.det))


@query("frame_offset", """
WITH ea AS (SELECT * FROM pix WHERE grey = 30),
eb AS (SELECT page_id, y + 1 AS y, x - CAST(page_id % 3 AS INT) AS x FROM after WHERE grey = 30),
sh AS (SELECT dx, dy FROM (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy)),
q AS (SELECT *, unnest(['all', CASE WHEN y < 24 THEN 'top' ELSE 'bottom' END || CASE WHEN x < 24 THEN '-left' ELSE '-right' END]) AS part FROM ea),
v AS (SELECT q.page_id, part, dx, dy, count(*) AS votes FROM q CROSS JOIN sh JOIN eb ON eb.page_id = q.page_id AND eb.y = q.y + dy AND eb.x = q.x + dx GROUP BY ALL),
n AS (SELECT page_id, part, count(*) AS n FROM q GROUP BY ALL)
SELECT page_id, part, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, votes, votes / CAST(n AS DOUBLE) AS confidence FROM v JOIN n USING (page_id, part)
QUALIFY row_number() OVER (PARTITION BY page_id, part ORDER BY votes DESC, abs(dx) + abs(dy), dy, dx) = 1""", "pix after")
def _(c):
    moved = c.after.filter("grey = 30").select("page_id", (F.col("y") + 1).alias("y"), (F.col("x") - (F.col("page_id") % 3).cast("int")).alias("x"))
    return B.frame_offset(c.pix.filter("grey = 30"), moved)

"""Distances, shared parents and histograms against dense numpy arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.operators import distance as D
from pagelens.operators import raster as P
from pagelens.operators import runs as R
from pagelens.operators import tones as T
from tests.test_raster import MASK, rows_of

RUNS = "page_id bigint, region_id int, y int, x0 int, x1 int"


def brute(target, seed):
    ty, tx = np.nonzero(target)
    sy, sx = np.nonzero(seed)
    if not len(sy):
        return {(int(y), int(x)): D.NOWHERE for y, x in zip(ty, tx)}
    d = ((ty[:, None] - sy) ** 2 + (tx[:, None] - sx) ** 2).min(axis=1)
    return {(int(y), int(x)): int(v) for y, x, v in zip(ty, tx, d)}


@pytest.mark.parametrize("few", [1, 40])
def test_distances_equal_brute_force(spark, few):
    rng = np.random.default_rng(few)
    targets, seeds, want = [], [], {}
    shapes = [(20, 30), (1, 200), (90, 3), (40, 140), (25, 25), (12, 12)]
    for region, shape in enumerate(shapes):
        t, s = rng.random(shape) < 0.4, np.zeros(shape, bool)
        if region != 4:  # one region without seeds
            s.flat[rng.choice(s.size, min(few, s.size), replace=False)] = True
        targets += rows_of(t, region % 2, region)
        seeds += rows_of(s, region % 2, region)
        want |= {(region, *k): v for k, v in brute(t, s).items()}
    to = lambda rows: R.to_runs(spark.createDataFrame(rows, MASK))
    got = {(r.region_id, r.y, r.x): r.d for r in D.squared_distance(to(targets), to(seeds)).collect()}
    assert got == want


def test_far_apart_and_negative_places(spark):
    t = spark.createDataFrame([(1, 0, -100, -70, -60), (1, 0, 3000, 9000, 9003)], RUNS)
    s = spark.createDataFrame([(1, 0, -90, -300, -299), (1, 0, -90, 8000, 8001), (1, 1, 0, 0, 5)], RUNS)
    got = {(r.y, r.x): r.d for r in D.squared_distance(t, s).collect()}
    want = {(y, x): min((y + 90) ** 2 + (x - c) ** 2 for c in (-300, 8000)) for y, a, b in ((-100, -70, -60), (3000, 9000, 9003)) for x in range(a, b)}
    assert got == want
    assert D.squared_distance(t.limit(0), s).collect() == []
    with pytest.raises(Exception, match="outside of the coordinates"):
        D.squared_distance(spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 1 << 21, 0, 1)], RUNS), s).collect()


def test_lowest_parabolas_of_wide_rows():
    rng = np.random.default_rng(2)
    row, x = np.repeat([0, 1, 3], 500), np.tile(np.sort(rng.choice(5000, 500, replace=False)), 3)
    of, c = np.repeat([0, 3], 300), np.tile(np.sort(rng.choice(5000, 300, replace=False)), 2)
    up = rng.integers(0, 400, 600) ** 2
    got = D.lowest(row, x, of, c, up)
    for r in (0, 1, 3):
        mine = of == r
        want = ((x[row == r][:, None] - c[mine]) ** 2 + up[mine]).min(axis=1) if mine.any() else np.full(500, D.NOWHERE)
        assert (got[row == r] == want).all()


def ellipse(shape, cy, cx, ry, rx):
    y, x = np.ogrid[:shape[0], :shape[1]]
    return ((y - cy) / ry) ** 2 + ((x - cx) / rx) ** 2 <= 1


def test_shared_parents_are_dealt_out(spark):
    shape = (60, 90)
    lobes = {0: ellipse(shape, 30, 30, 20, 25), 1: ellipse(shape, 30, 60, 20, 25), 2: ellipse(shape, 12, 80, 8, 8)}
    ink = {0: ellipse(shape, 28, 25, 4, 6), 1: ellipse(shape, 32, 64, 4, 6), 2: ellipse(shape, 12, 80, 2, 2), 3: np.zeros(shape, bool)}
    frame = (1, 7, 0, 0, 90, 60)
    df = lambda masks: R.to_runs(spark.createDataFrame([r for i, m in masks.items() for r in rows_of(m, 1, i)], MASK))
    boxes = spark.createDataFrame([(1, 0, 15, 20, 36, 36), (1, 1, 50, 20, 75, 40), (1, 2, 75, 8, 85, 16), (1, 3, 40, 5, 50, 9)], "page_id bigint, region_id int, x1 int, y1 int, x2 int, y2 int")
    members = spark.createDataFrame([(1, r, *frame[1:]) for r in (0, 1, 3)], "page_id bigint, region_id int, parent_id int, px1 int, py1 int, px2 int, py2 int")
    merged = lobes[0] | lobes[1]
    seeds = {0: ink[0], 1: ink[1], 3: np.zeros(shape, bool)}
    seeds[3][7, 45] = True  # no ink: the middle of its box
    far = {i: brute(merged, s) for i, s in seeds.items()}
    owner = {p: min(far, key=lambda i: (far[i][p], i)) for p in far[0]}  # noqa: B023
    got = R.to_pixels(P.share_interior(df(lobes), df(ink), boxes, members)).collect()
    assert {(r.y, r.x): r.region_id for r in got} == owner and len(got) == int(merged.sum())
    assert set(owner.values()) == {0, 1, 3}
    # the whole chain: lobes, then overlaps with regions of other parents, and new boxes
    out, new = P.separate_interiors(df(lobes), df(ink), boxes, members)
    pixels = R.to_pixels(out).collect()
    assert len({(r.y, r.x) for r in pixels}) == len(pixels)
    for b in new.collect():
        ys, xs = zip(*[(r.y, r.x) for r in pixels if r.region_id == b.region_id])
        assert (b.x1, b.y1, b.x2, b.y2) == (min(xs), min(ys), max(xs) + 1, max(ys) + 1)


def test_histograms_of_a_large_raster(spark):
    """4 000 x 3 000 pixels: what leaves the tasks are counts, and figures equal those of all pixels."""
    w, h = 4000, 3000
    values = "SELECT 1L AS page_id, CAST(id DIV {w} AS INT) AS y, CAST(id % {w} AS INT) AS x, CAST(pmod(xxhash64(id), 97) * 2 AS INT) AS grey FROM range({n})".format(w=w, n=w * h)
    px = spark.sql(values).withColumn("region_id", (F.col("x") >= 1000).cast("int"))
    out = T.tones(px, ["page_id", "region_id"])
    m = T.median(F.col("h_grey"))
    cut = T.otsu(F.col("h_grey"))
    got = {r.region_id: r for r in out.select("region_id", "n", F.size("h_grey").alias("bins"), m.alias("m"), T.mad(F.col("h_grey"), m).alias("mad"),
                                             T.total(T.above(F.col("h_grey"), cut["threshold"])).alias("over"), cut.alias("cut")).collect()}
    want = px.groupBy("region_id").agg(F.median("grey").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    dev = px.join(spark.createDataFrame([(r.region_id, r.m) for r in want], "region_id int, m double"), "region_id").groupBy("region_id").agg(F.median(F.abs(F.col("grey") - F.col("m"))).alias("mad"))
    mad = dict(dev.collect())
    for r in want:
        g = got[r.region_id]
        assert (g.n, g.m, g.mad, g.bins) == (r.n, r.m, mad[r.region_id], 97)
    split = P.otsu(px, ["page_id", "region_id"]).collect()
    assert {(r.region_id, r.threshold) for r in split} == {(k, g.cut.threshold) for k, g in got.items()}
    over = px.filter(F.col("grey") > got[0].cut.threshold).filter("region_id = 0").count()
    assert got[0].over == over


def test_histograms_of_even_odd_and_missing_counts(spark):
    rows = [(1, v) for v in (3, 9, 9, 40)] + [(2, v) for v in (7, 8, 200)] + [(3, None), (3, 5)] + [(4, None)]
    out = T.tones(spark.createDataFrame(rows, "k int, grey int"), ["k"])
    m = T.median(F.col("h_grey"))
    got = {r.k: (r.n, r.m, r.d) for r in out.select("k", "n", m.alias("m"), T.mad(F.col("h_grey"), m).alias("d")).collect()}
    assert got == {1: (4, 9.0, 3.0), 2: (3, 8.0, 1.0), 3: (1, 5.0, 0.0)}
    none = out.filter("k = 1").select(T.median(T.above(F.col("h_grey"), F.lit(40))).alias("x"), T.otsu(T.upto(F.col("h_grey"), F.lit(3)))["threshold"].alias("t")).first()
    assert (none.x, none.t) == (None, None)


def test_scanlines_cut_at_gaps(spark):
    rows = [(1, 0, x, x * 2) for x in (0, 1, 2, 5, 6, 9)] + [(1, 1, x, 7) for x in range(-2, 3)] + [(2, 0, 4, 1)]
    lines = P.scanlines(spark.createDataFrame(rows, "page_id bigint, y int, x int, grey int")).collect()
    got = sorted((r.page_id, r.y, r.x0, r.x1, [p.grey for p in r.px]) for r in lines)
    assert got == [(1, 0, 0, 3, [0, 2, 4]), (1, 0, 5, 7, [10, 12]), (1, 0, 9, 10, [18]), (1, 1, -2, 3, [7] * 5), (2, 0, 4, 5, [1])]

"""Run operators against dense numpy masks."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagelens.functions.kernels import ellipse
from pagelens.operators import raster as P
from pagelens.operators import runs as R
from pagelens.plans import corpus
from pagelens.sources import images
from tests.oracle_check import compare, connect

MASK = "page_id bigint, region_id int, y int, x int"


def rows_of(mask, page=0, region=0):
    return [(page, region, int(y), int(x)) for y, x in zip(*np.nonzero(mask))]


def runs(spark, mask):
    return R.to_runs(spark.createDataFrame(rows_of(mask), MASK))


def dense(df, shape):
    out = np.zeros(shape, bool)
    for r in R.to_pixels(df).collect():
        out[r.y, r.x] = True
    return out


def frame(spark, shape):
    return spark.createDataFrame([(0, 0, 0, 0, shape[1], shape[0])], "page_id bigint, region_id int, x1 int, y1 int, x2 int, y2 int")


def grow(mask, k):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        for dy, hw in ellipse(k):
            if 0 <= y + dy < h:
                out[y + dy, max(x - hw, 0):min(x + hw + 1, w)] = True
    return out


def flood(mask, conn):
    lab, n = np.zeros(mask.shape, int), 0
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if conn == 8 else [])
    for y, x in zip(*np.nonzero(mask)):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        lab[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy, dx in steps:
                p, q = a + dy, b + dx
                if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not lab[p, q]:
                    lab[p, q] = n
                    todo.append((p, q))
    return lab


MASKS = [np.random.default_rng(s).random((20, 30)) < d for s, d in ((1, 0.45), (2, 0.7))]


def test_dilate_erode_close(spark):
    for m in MASKS:
        box = frame(spark, m.shape)
        assert (dense(R.clip(R.dilate(runs(spark, m), 5), box), m.shape) == grow(m, 5)).all()
        assert (dense(R.erode(runs(spark, m), 3, box), m.shape) == ~grow(~m, 3)).all()
        assert (dense(R.close(runs(spark, m), 5, box), m.shape) == ~grow(~grow(m, 5), 5)).all()


def test_components_both_paths(spark):
    for m in MASKS:
        for conn in (4, 8):
            want = sorted(np.bincount(flood(m, conn).ravel())[1:])
            for limit in (10_000, 1):
                got = R.component_stats(R.label_runs(runs(spark, m), conn=conn, limit=limit)).collect()
                assert sorted(r.area for r in got) == want


def test_fill_holes(spark):
    m = MASKS[1]
    lab = flood(~m, 4)
    edge = set(lab[0]) | set(lab[-1]) | set(lab[:, 0]) | set(lab[:, -1])
    want = m | (~np.isin(lab, sorted(edge | {0})) & ~m)
    assert (dense(R.fill_holes(runs(spark, m), frame(spark, m.shape)), m.shape) == want).all()


def test_algebra_on_lazy_inputs_used_twice(spark):
    a, b = runs(spark, MASKS[0]), runs(spark, MASKS[1])
    wide, tight = R.dilate(a, 7), R.dilate(a, 3)
    near = R.combine({"m": b, "w": wide, "t": tight}, lambda c: (c["m"] > 0) & (c["w"] > 0) & (c["t"] == 0))
    px = R.to_pixels(near)
    assert px.join(px.groupBy("page_id", "region_id").count(), ["page_id", "region_id"]).count() == px.count() > 0


def test_disjoin_is_disjoint_and_loses_no_pixel(spark):
    yy, xx = np.mgrid[0:40, 0:40]
    a, b = (yy - 20) ** 2 + (xx - 14) ** 2 < 144, (yy - 20) ** 2 + (xx - 26) ** 2 < 144
    both = R.to_runs(spark.createDataFrame(rows_of(a) + rows_of(b, region=1), MASK))
    ink = R.to_runs(spark.createDataFrame([(0, 0, 20, 10), (0, 1, 20, 30)], MASK))
    out = R.to_pixels(P.disjoin(both, ink)).collect()
    assert len(out) == len({(r.y, r.x) for r in out}) == int((a | b).sum())
    for r in out:
        d = [(r.y - 20) ** 2 + (r.x - c) ** 2 for c in (10, 30)]
        if a[r.y, r.x] and b[r.y, r.x]:
            assert r.region_id == int(d[1] < d[0])


def test_interior_of_a_drawn_balloon(spark):
    yy, xx = np.mgrid[0:48, 0:48]
    d = (yy - 24) ** 2 + (xx - 24) ** 2
    grey = np.where(d < 260, 245, np.where(d < 340, 20, 150))
    ink = (abs(yy - 24) < 3) & (abs(xx - 24) < 8) & (xx % 4 < 2)
    grey[ink] = 15
    px = spark.createDataFrame([(0, int(y), int(x), int(grey[y, x])) for y in range(48) for x in range(48)], "page_id bigint, y int, x int, grey int")
    got = dense(P.interior_masks(px, runs(spark, ink), frame(spark, grey.shape)), grey.shape)
    assert got[d < 200].all() and not got[d > 260].any()


def png(path, rgb):
    h, w, _ = rgb.shape
    part = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_read_pages_and_rejects(spark, tmp_path):
    rgb = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    png(tmp_path / "a.png", rgb)
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "c.webp").write_bytes(b"other")
    pages = images.read_pages(spark, str(tmp_path))
    assert pages.count() == 1
    assert sorted(r.path.rsplit("/", 1)[-1] for r in images.read_rejects(spark, str(tmp_path)).collect()) == ["b.png", "c.webp"]
    for r in images.explode_pixels(pages.withColumn("page_id", F.lit(1)), "page_id").collect():
        assert (r.r, r.g, r.b) == tuple(int(v) for v in rgb[r.y, r.x])


def test_colour_marks_from_scanlines_and_from_pixels(spark):
    """Both forms give the same boxes; over scanlines the condition is not moved into what makes the channels."""
    import __spark_entry__ as entry
    from pagelens.plans.corpus import Corpus

    c = Corpus(spark, "/root/testdata/sf0.001")
    lines = P.scanlines(c.rgb)
    found = P.pixels_of(lines).filter("r > 110 AND r - g > 50 AND r - b > 50")
    cols = ["page_id", "y", "x", "r", "g", "b"]
    plain = [tuple(r) for r in c.rgb.select(*cols).collect() if r.r > 110 and r.r - r.g > 50 and r.r - r.b > 50]
    assert sorted(map(tuple, found.select(*cols).collect())) == sorted(plain)
    assert "%" not in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    few = c.rgb.filter("page_id < 4")
    one = sorted(map(tuple, P.colour_marks(few).collect()))
    assert one == sorted(map(tuple, entry.queries()["colour_marks"](spark, c.folder).filter("page_id < 4").collect())) and one


def test_flat_fill_leaves_protected_ink_and_its_margin(spark, monkeypatch):
    folder, at, to = "/root/testdata/sf0.001", "x BETWEEN 3 AND 9 AND y BETWEEN 39 AND 44", "x BETWEEN 15 AND 20 AND y BETWEEN 16 AND 21"
    monkeypatch.setitem(corpus.VIEWS, "ink", corpus.VIEWS["ink"].replace(at, to))  # protected ink inside of a fill
    shut = corpus.Corpus(spark, folder).ink.filter("region_id = 2 and page_id = 0").collect()
    mask = np.zeros((48, 48), bool)
    mask[[r.y for r in shut], [r.x for r in shut]] = True
    fill = entry.queries()["apply_flat_fill"]
    painted = np.zeros((48, 48), bool)
    for r in fill(spark, folder).filter("page_id = 0 and painted").collect():
        painted[r.y, r.x] = True
    assert mask.sum() == 12 and not painted[grow(mask, 5)].any() and painted[grow(mask, 9) & ~grow(mask, 5)].all()
    sql = entry.oracle_sql()["apply_flat_fill"].replace("2, y, x FROM canvas WHERE " + at, "2, y, x FROM canvas WHERE " + to)
    ok, detail = compare(spark, connect(folder), folder, fill, sql)
    assert ok, detail

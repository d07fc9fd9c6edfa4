"""The hierarchical grid join against a plain comparison of all pairs."""

import random

import pytest

from pagelens.operators import boxes as B

BOX = "page_id bigint, det_id bigint, x1 int, y1 int, x2 int, y2 int"


def meets(a, b):
    return a[0] == b[0] and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3])


def plain(left, right):
    return sorted((a[0], a[1], b[1]) for a in left for b in right if meets(a, b))


def met(spark, left, right, **options):
    a, b = spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX)
    rows = B.overlap_join(a, b, **options).collect()
    inter = {(r.page_id, r.a_det_id, r.b_det_id): r.inter for r in rows}
    for r in rows:
        assert r.inter == (min(r.a_x2, r.b_x2) - max(r.a_x1, r.b_x1)) * (min(r.a_y2, r.b_y2) - max(r.a_y1, r.b_y1))
    assert len(inter) == len(rows)  # every pair once
    return sorted(inter)


def drawn(n, seed, pages=2, spread=3000):
    """Boxes of all sizes, some without area, some left of or above the page."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        side = rnd.choice([0, 1, 3, 4, 5, 16, 60, 64, 65, 256, 300, 1025, 2500])
        x, y = rnd.randrange(-200, spread), rnd.randrange(-200, spread)
        out.append((rnd.randrange(pages), i, x, y, x + side, y + (side if rnd.random() < 0.5 else rnd.choice([1, 7, 64, 700]))))
    return out


@pytest.mark.parametrize("few", [0, 10**9])
@pytest.mark.parametrize("part", [7, 10**9])
def test_levels_and_parts_leave_pairs_alike(monkeypatch, spark, few, part):
    monkeypatch.setattr(B, "FEW", few)
    left, right = drawn(220, 1), drawn(180, 2)
    assert met(spark, left, right, part=part) == plain(left, right)


def test_a_side_without_boxes(spark):
    rows = drawn(20, 3)
    assert met(spark, rows, []) == met(spark, [], rows) == met(spark, [], []) == []


def test_a_table_joined_with_itself(monkeypatch, spark):
    monkeypatch.setattr(B, "FEW", 0)
    rows = drawn(150, 4)
    df = spark.createDataFrame(rows, BOX)
    got = sorted((r.page_id, r.a_det_id, r.b_det_id) for r in B.overlap_join(df, df, part=11).collect())
    assert got == plain(rows, rows)


def test_fifty_thousand_boxes_in_one_coarse_cell(spark):
    """Small boxes side by side in a square that holds one large box: no cell meets all with all."""
    n = 50_000
    tiny = spark.range(n).selectExpr("1L AS page_id", "id AS det_id", "CAST(id % 250 AS INT) AS x1", "CAST(id / 250 AS INT) AS y1", "CAST(id % 250 + 1 AS INT) AS x2", "CAST(id / 250 AS INT) + 1 AS y2")
    big = spark.createDataFrame([(1, n, 0, 0, 256, 256)], BOX)
    both = tiny.unionByName(big)
    out = B.overlap_join(tiny, both).groupBy((B.F.col("b_det_id") == n).alias("large")).count().collect()
    assert {r["large"]: r["count"] for r in out} == {True: n, False: n}


def test_fifty_thousand_boxes_stacked_in_one_cell_are_dealt(spark):
    """All boxes touch one corner's cell but only neighbours overlap; parts of the cell meet in tasks of their own."""
    n = 50_000
    stack = spark.range(n).selectExpr("1L AS page_id", "id AS det_id", "CAST(id AS DOUBLE) / 1e5 AS x1", "0e0 AS y1", "(CAST(id AS DOUBLE) + 1) / 1e5 AS x2", "1e0 AS y2")
    thin = stack.filter("det_id % 500 = 0")
    joined = B.overlap_join(thin, stack, part=4000)
    pairs = joined.select("a_det_id", "b_det_id").collect()
    assert sorted((r.a_det_id, r.b_det_id) for r in pairs) == [(i, i) for i in range(0, n, 500)]
    cells = B._listed(stack.selectExpr("page_id", "det_id AS a_det_id", "x1 AS a_x1", "y1 AS a_y1", "x2 AS a_x2", "y2 AS a_y2"), "a_", 0, [0], [0])
    where = ["page_id", "role", "wide", "cell_x", "cell_y"]
    assert cells.groupBy(*where).count().first()["count"] == n
    dealt, _ = B._dealt(cells, cells.limit(10), where, 4000)
    assert dealt.groupBy(*where, "lp", "rp").count().agg({"count": "max"}).first()[0] < 2 * 4000

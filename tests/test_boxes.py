"""Golden rows, and the paths for oversized groups against brute force."""

import random

from pyspark.sql import functions as F

from pagelens.operators import boxes as B
from pagelens.operators import ordering as O
from pagelens.operators.graph import components
from pagelens.operators.grouping import Scan, scan

BOX = "page_id bigint, det_id bigint, x1 int, y1 int, x2 int, y2 int"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], BOX)


def coords(df):
    return sorted(tuple(r) for r in df.select("x1", "y1", "x2", "y2").collect())


def random_boxes(n, seed, side=300, pages=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.randrange(side), rnd.randrange(side)
        out.append((rnd.randrange(pages), i, x, y, x + rnd.randrange(10, 90), y + rnd.randrange(10, 90)))
    return out


def test_merge_nested_golden(spark):
    merged = B.merge_nested(boxes(spark, [(944, 130, 1024, 321), (832, 135, 1027, 405)]))
    assert coords(merged) == [(832, 130, 1027, 405)]
    for rows in ([(100, 100, 300, 400), (110, 110, 190, 390), (210, 110, 290, 390)], [(100, 100, 205, 400), (195, 100, 300, 400)]):
        assert coords(B.merge_nested(boxes(spark, rows))) == sorted(rows)


def test_merge_nested_large_page_path_agrees(spark):
    df = spark.createDataFrame(random_boxes(120, 3, side=140), BOX)
    a = B.merge_nested(df).collect()
    b = B.merge_nested(df, fold_limit=1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) < 120


def test_assign_parents_golden(spark):
    for region, parents, want in (
        ((832, 130, 1027, 405), [(800, 117, 964, 440), (800, 96, 1046, 442)], (800, 96, 1046, 442)),
        ((10, 10, 110, 110), [(10, 10, 107, 110), (0, 0, 200, 200)], (10, 10, 107, 110)),
    ):
        got = B.assign_parents(boxes(spark, [region]), boxes(spark, parents).withColumn("ord", F.col("det_id"))).first()
        assert (got.parent_x1, got.parent_y1, got.parent_x2, got.parent_y2) == want


def test_split_shared_parent_golden(spark):
    df = boxes(spark, [(140, 360, 360, 420), (440, 360, 660, 420)])
    df = df.withColumns({f"parent_{k}": F.lit(v) for k, v in zip(("x1", "y1", "x2", "y2"), (100, 300, 700, 620))})
    got = sorted((r.det_id, r.parent_x1, r.parent_x2) for r in O.split_shared_parents(df).collect())
    assert got == [(0, 100, 400), (1, 400, 700)]


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        t, c = (0.65, 0.80) if r[7] == 0 else (0.45, 0.0)
        for k in kept:
            if k[0] != r[0] or (k[7] == 0) != (r[7] == 0):
                continue
            i = max(min(k[4], r[4]) - max(k[2], r[2]), 0) * max(min(k[5], r[5]) - max(k[3], r[3]), 0)
            a, b = ((q[4] - q[2]) * (q[5] - q[3]) for q in (k, r))
            if i / (a + b - i + 1e-9) > t and i / (min(a, b) + 1e-9) >= c:
                break
        else:
            kept.append(r)
    return sorted(r[1] for r in kept)


def test_suppress_matches_brute_force_on_both_paths(spark):
    rnd = random.Random(5)
    rows = [(*r, rnd.randrange(50), rnd.randrange(3)) for r in random_boxes(400, 7, side=120, pages=3)]
    rows += [(*r[:1], r[1] + 1000, *r[2:]) for r in rows[:60]]  # exact copies
    df = spark.createDataFrame(rows, BOX + ", score int, cls int")
    want = greedy(rows)
    for limit in (10_000, 20):
        assert sorted(r.det_id for r in B.suppress(df, limit).collect()) == want


def test_boxes_without_area_survive_on_both_paths(spark):
    rows = [(1, 1, 50, 10, 50, 40, 9, 1), (1, 2, 50, 10, 50, 40, 8, 1), (1, 3, 0, 0, 30, 30, 7, 1), (1, 4, 0, 0, 30, 30, 7, 1), (1, 5, 1, 1, 31, 31, 9, 1)]
    df = spark.createDataFrame(rows, BOX + ", score int, cls int")
    for limit in (10_000, 1):
        assert sorted(r.det_id for r in B.suppress(df, limit).collect()) == greedy(rows) == [1, 2, 5]


def test_chain_merges_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = O.overlap_groups
    monkeypatch.setattr(O, "overlap_groups", lambda *a: rounds.append(1) or real(*a))
    df = boxes(spark, [(i * 8, 0, i * 8 + 10, 10) for i in range(1000)])
    assert coords(O.merge_boxes(df)) == [(0, 0, 999 * 8 + 10, 10)] and len(rounds) <= 3


def test_overlap_groups_sweep_agrees_with_pairs(spark):
    df = spark.createDataFrame(random_boxes(150, 11, side=900, pages=2), BOX)
    a = sorted(map(tuple, O.overlap_groups(df).collect()))
    assert a == sorted(map(tuple, O.overlap_groups(df, limit=1).collect())) and len(a) > 50


def test_components_contraction_agrees(spark):
    rnd = random.Random(2)
    edges = [(0, rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1, i, i + 1) for i in range(90)]
    e = spark.createDataFrame(edges, "page_id bigint, a bigint, b bigint")
    nodes = spark.createDataFrame([(p, i) for p in (0, 1) for i in range(300)], "page_id bigint, node bigint")
    a = sorted(map(tuple, components(nodes, e, ["page_id"]).collect()))
    b = sorted(map(tuple, components(nodes, e, ["page_id"], limit=1).collect()))
    assert a == b and (1, 90, 0) in a


def test_merge_boxes_leaves_no_overlap_and_covers_input(spark):
    rows = random_boxes(60, 4, side=500)
    got = [tuple(r) for r in O.merge_boxes(spark.createDataFrame(rows, BOX), pad=3).select("x1", "y1", "x2", "y2").collect()]
    for i, a in enumerate(got):
        assert not any(a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3] for b in got[i + 1:])
    assert all(any(g[0] <= r[2] - 3 and g[1] <= r[3] - 3 and g[2] >= r[4] + 3 and g[3] >= r[5] + 3 for g in got) for r in rows)


def test_scan_in_blocks_agrees_with_windows(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(i % 3 == 0, rnd.randrange(40), i, rnd.choice([None, rnd.randrange(9)])) for i in range(300)], "k boolean, o int, id int, v int")
    scans = [Scan("rn", "row_number"), Scan("s", "sum", "v"), Scan("m", "max_before", "v"), Scan("l", "last", "v"), Scan("n", "lead", "v")]
    order = [F.col("o"), F.col("id")]
    a = sorted(map(repr, scan(df, ["k"], order, scans).collect()))
    assert a == sorted(map(repr, scan(df, ["k"], order, scans, limit=10, block_rows=40).collect()))


def test_reading_order_is_a_permutation(spark):
    df = spark.createDataFrame(random_boxes(200, 6, side=800, pages=4), BOX)
    for limit in (10_000, 10):
        by_page = {}
        for r in O.reading_order(df, limit=limit).collect():
            by_page.setdefault(r.page_id, []).append(r.idx)
        assert all(sorted(v) == list(range(len(v))) for v in by_page.values())


def test_nearest_matches_brute_force(spark):
    rnd = random.Random(1)
    t = [(0, i, rnd.randrange(3000), rnd.randrange(3000)) for i in range(60)]
    c = [(0, i, rnd.randrange(3000), rnd.randrange(3000)) for i in range(15)]
    got = {r.target_id: (r.cost, r.cand_id) for r in B.nearest(
        spark.createDataFrame(t, "page_id int, target_id int, x int, y int"), spark.createDataFrame(c, "page_id int, cand_id int, x int, y int")).collect()}
    assert got == {i: min((abs(x - u) + 2 * abs(y - v), j) for _, j, u, v in c) for _, i, x, y in t}


def test_nearest_finds_far_candidates(spark):
    target = spark.createDataFrame([(0, 1, 0, 0), (1, 1, 0, 0)], "page_id int, target_id int, x int, y int")
    cands = spark.createDataFrame([(0, 1, 393_213, 0), (0, 2, 0, 98_304), (1, 7, 400_000, 0)], "page_id int, cand_id int, x int, y int")
    assert {(r.page_id, r.cost, r.cand_id) for r in B.nearest(target, cands).collect()} == {(0, 196_608, 2), (1, 400_000, 7)}

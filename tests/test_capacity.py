"""Capacity of shapes against plain filling, and against boxes."""

import random

from pyspark.sql import functions as F

from pagelens.functions import fixed as X
from pagelens.operators import capacity
from pagelens.operators import texts as J

RUNS = "page_id long, region_id long, y int, x0 int, x1 int"


def plain_rooms(runs, size):
    rows = {}
    for y, a, b in runs:
        rows.setdefault(y, set()).update(range(a, b))
    top, out = min(rows), []
    for line in range((max(rows) - top + 1) // size):
        free = set.intersection(*(rows.get(top + line * size + k, set()) for k in range(size)))
        best = now = 0
        for x in range(min(free, default=0), max(free, default=-1) + 2):
            now = now + 1 if x in free else 0
            best = max(best, now)
        out.append(best)
    return out


def plain_held(widths, rooms, size):
    n = 0
    for room in rooms:
        left = room * 1000 // size
        used = 0
        while n < len(widths) and (used + J.SPACE_W if used else 0) + widths[n] <= left:
            used = (used + J.SPACE_W if used else 0) + widths[n]
            n += 1
    return n


def shapes():
    r = random.Random(5)
    oval = [(y, 100 - int((40**2 - (y - 40) ** 2) ** 0.5), 100 + int((40**2 - (y - 40) ** 2) ** 0.5)) for y in range(1, 80)]
    torn = [(y, a, a + r.randint(5, 60)) for y in range(70) if y % 23 for a in (r.randint(0, 20), r.randint(90, 120))]
    return {1: oval, 2: torn, 3: [(y, 10, 130) for y in range(5, 65)], 4: [(9, 0, 400)], 5: [(y, 0, 3) for y in range(90)]}


def test_shapes_hold_what_plain_filling_finds(spark):
    runs = shapes()
    mask = spark.createDataFrame([(1, i, *run) for i, s in runs.items() for run in s], RUNS)
    regions = spark.createDataFrame([(1, i, 14, 7) for i in (*runs, 6)], "page_id long, region_id long, cap int, low int")
    got = {r.region_id: r for r in capacity.shape_budgets(mask, regions, F.col("cap"), F.col("low")).collect()}
    words = X.FILLER.split()
    for i, s in runs.items():
        want = []
        for size in (14, 7):
            rooms = plain_rooms(s, size)
            n = plain_held([J.sum_width(w) for w in words], rooms, size)
            widest = max(rooms, default=0) * 1000 // size
            want += [len(" ".join(words[:n])), max((k for k in range(2, 25) if J.sum_width(X.LONG_WORD[:k]) <= widest), default=0)]
        assert (got[i].soft, got[i].word_soft) == tuple(want[:2])
        assert (got[i].hard, got[i].word_hard) == (max(want[0], want[2]), max(want[1], want[3]))
    assert got[1].hard > got[1].soft > 0 and got[4].hard == 0
    assert tuple(got[6]) == (1, 6, 14, 0, 0, 0, 0)  # no mask


def test_a_rectangle_holds_what_its_box_holds(spark):
    mask = spark.createDataFrame([(1, i, y, 7, 7 + w) for i, w in enumerate((60, 115, 240)) for y in range(30 + 41 * i)], RUNS)
    boxes = spark.createDataFrame([(1, i, w, 30 + 41 * i) for i, w in enumerate((60, 115, 240))], "page_id long, region_id long, box_w int, box_h int")
    shape = capacity.shape_budgets(mask, boxes, F.lit(13), F.lit(6)).collect()
    box = {r.region_id: r for r in J.region_budgets(boxes, F.lit(13), F.lit(6)).collect()}
    for r in shape:
        b = box[r.region_id]
        assert (r.soft, r.hard, r.word_soft, r.word_hard) == (b.soft, b.hard, b.word_soft, b.word_hard)


def test_largest_size_in_a_shape(spark):
    runs, r = shapes(), random.Random(6)
    mask = spark.createDataFrame([(1, i, *run) for i, s in runs.items() for run in s], RUNS)
    said = [(1, i, " ".join(r.choice(["AM", "ILL", "WINDOW", "to", "be"]) for _ in range(n))) for i in runs for n in (0, 1, 4, 9, 30)] + [(1, 6, "ON"), (2, 1, "ON"), (1, 1, None)]
    texts = spark.createDataFrame(said, "page_id long, region_id long, text string")
    got = {(t.page_id, t.region_id, t.text): t.best_size for t in capacity.shape_sizes(texts, mask, 5, 20).collect()}
    for key in said:
        page, i, text = key
        if page == 2 or i == 6 or text is None:
            assert got[key] == 0
            continue
        widths = [J.sum_width(w) for w in text.split()]
        fits = [z for z in range(5, 21) if any(rooms := plain_rooms(runs[i], z)) and plain_held(widths, rooms, z) == len(widths)]
        assert got[key] == max(fits, default=0)

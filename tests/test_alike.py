"""The most similar image against all pairs of pixels."""

import numpy as np

from pagelens.operators import alike

PIXELS = "page_id bigint, y int, x int, grey int"


def table(spark, images):
    rows = [(i, y, x, int(v)) for i, m in images.items() for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, PIXELS)


def plain(targets, cands):
    out = {}
    for t, a in targets.items():
        same = [(np.abs(a.astype(int) - b).mean(), c) for c, b in cands.items() if a.shape == b.shape]
        if same:
            out[t] = min(same)[::-1]
    return out


def test_equal_to_all_pairs_and_few_are_compared(spark):
    rng = np.random.default_rng(0)
    cands = {i: np.clip(rng.integers(0, 256, (20, 1)) + rng.integers(-20, 21, (20, 28)), 0, 255) for i in range(60)}
    cands |= {100: cands[3], 101: cands[3], 102: rng.integers(0, 256, (28, 20)), 103: np.full((20, 28), 9), 104: rng.integers(0, 256, (1, 3))}
    targets = {i: np.clip(cands[i] + rng.integers(-6, 7, cands[i].shape), 0, 255) for i in range(0, 60, 3)}
    targets |= {200: cands[101], 201: cands[102], 202: np.full((20, 28), 0), 203: np.full((5, 5), 1), 204: cands[104], 205: targets[0]}
    out, tally = alike.nearest_image(table(spark, targets), table(spark, cands))
    got = {r.target_id: (r.cand_id, r.mae) for r in out.collect()}
    want = plain(targets, cands)
    assert {t: c for t, (c, _) in got.items()} == {t: c for t, (c, _) in want.items()} and 203 not in got
    assert all(abs(got[t][1] - want[t][1]) < 1e-9 for t in want)
    n = {r.what: r.n for r in tally.collect()}
    assert (n["targets"], n["cands"]) == (25, 63) and n["pairs"] < 0.1 * n["targets"] * n["cands"]


def test_no_candidates(spark):
    some = table(spark, {1: np.zeros((2, 2))})
    none = some.limit(0)
    assert alike.nearest_image(some, none)[0].collect() == [] and alike.nearest_image(none, some)[0].collect() == []

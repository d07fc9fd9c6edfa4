"""Exact squared distances between masks, as two keyed passes over runs.

The first pass goes down columns: strips of columns of a region tell for every row asked for how far the nearest
seed above or below is. The second goes along rows: a seed column ``c`` with vertical distance ``g`` is a parabola
``(x - c)**2 + g**2``, and the lowest parabola at ``x`` is the answer. As the lowest one only moves to the right with
``x``, the middle pixel of a stretch splits the columns for both halves, and all stretches of a level are searched at
once. A strip is as high as a page and a row as wide, so no task holds a region, and no pixel is compared with all
seeds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.graph import map_groups
from pagelens.operators.runs import RK, checked

#: Columns of a strip.
STRIP = 64
#: Distance where a region has no seed.
NOWHERE = 1 << 40
_BITS, _OFFSET = 21, 1 << 14


def squared_distance(targets: DataFrame, seeds: DataFrame, keys: Sequence[str] = RK) -> DataFrame:
    """``keys, y, x, d`` for every pixel of ``targets``: squared Euclidean distance to the nearest seed of the same ``keys``.

    Both are runs. Pixels of a group without seeds get :data:`NOWHERE`. Targets that overlap give repeated rows.
    """
    keys = list(keys)
    spots = _ranged(targets, keys)
    rows = spots.groupBy(*keys).agg(F.collect_set("y").alias("ys"))  # no more than a page has rows
    strip = lambda c: F.floor(F.col(c) / STRIP).cast("int")
    cut = _ranged(seeds, keys).select("*", F.explode(F.sequence(strip("x0"), F.floor((F.col("x1") - 1) / STRIP).cast("int"))).alias("strip"))
    lo, hi = F.greatest("x0", F.col("strip") * STRIP), F.least("x1", (F.col("strip") + 1) * STRIP)
    none = F.lit(None).cast("array<int>")
    cut = cut.select(*keys, "strip", "y", lo.alias("x0"), hi.alias("x1"), none.alias("ys"))
    zero = F.lit(0)
    asked = cut.select(*keys, "strip").distinct().join(rows, keys).select(*keys, "strip", zero.alias("y"), zero.alias("x0"), zero.alias("x1"), "ys")
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in targets.select(*keys).schema.fields)
    down = map_groups(cut.unionByName(asked), [*keys, "strip"], lambda pdf, code: _columns(pdf, code, keys), f"{named}, y int, xs array<int>, gs array<int>")
    along = down.select(*keys, "y", zero.alias("x0"), zero.alias("x1"), "xs", "gs").unionByName(
        spots.select(*keys, "y", "x0", "x1", none.alias("xs"), none.alias("gs")))
    return map_groups(along, [*keys, "y"], lambda pdf, code: _rows(pdf, code, keys), f"{named}, y int, x int, d long")


def _ranged(runs: DataFrame, keys: list[str]) -> DataFrame:
    at = {c: checked(c).cast("int").alias(c) for c in ("y", "x0", "x1")}
    return runs.filter("x1 > x0").select(*keys, *at.values())


def _repeat(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and all whole numbers from ``lo`` up to ``hi`` of each row."""
    n = np.maximum(hi - lo, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _columns(pdf: pd.DataFrame, code: np.ndarray, keys: list[str]) -> pd.DataFrame:
    """For every strip and row asked for: its columns with seeds, and how far the nearest one is up or down."""
    asks = pdf["ys"].notna().to_numpy()
    y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    at, x = _repeat(np.where(asks, 0, x0), np.where(asks, 0, x1))
    column = (code[at] << 32) + x + _OFFSET  # one number for a column of a strip
    seed = np.unique(np.stack([column, y[at]], axis=1), axis=0)
    names, first = np.unique(seed[:, 0], return_index=True)
    stops = np.r_[first[1:], len(seed)]
    spot = (np.searchsorted(names, seed[:, 0]) << _BITS) + seed[:, 1] + _OFFSET  # ascending
    mine = np.nonzero(asks)[0]
    ys = [np.sort(v) for v in pdf["ys"].to_numpy()[mine]]
    a, b = np.searchsorted(names, code[mine] << 32), np.searchsorted(names, (code[mine] + 1) << 32)
    rows, names_of, wanted = [], [], []
    for i, (lo, hi, v) in enumerate(zip(a, b, ys)):
        rows.append(np.full(len(v), mine[i]))
        wanted.append(np.asarray(v, dtype=np.int64))
        names_of.append((lo, hi))
    out_row = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    out_y = np.concatenate(wanted) if wanted else np.zeros(0, dtype=np.int64)
    lo, hi = (np.repeat([n[k] for n in names_of], [len(w) for w in wanted]).astype(np.int64) for k in (0, 1))
    q, col = _repeat(lo, hi)
    key = (col << _BITS) + out_y[q] + _OFFSET
    after = np.searchsorted(spot, key)
    far = np.int64(1 << 20)
    below = np.where(after < stops[col], spot[np.minimum(after, len(spot) - 1)] - key, far)
    above = np.where(after > first[col], key - spot[np.maximum(after - 1, 0)], far)
    ends = np.cumsum(hi - lo)[:-1]
    frame = pdf[keys].iloc[out_row].reset_index(drop=True)
    split = lambda v: pd.Series(np.split(v.astype(np.int32), ends) if len(out_y) else [], dtype=object)
    return frame.assign(y=out_y.astype(np.int32), xs=split((names[col] & ((1 << 32) - 1)) - _OFFSET), gs=split(np.minimum(below, above)))


def _rows(pdf: pd.DataFrame, code: np.ndarray, keys: list[str]) -> pd.DataFrame:
    """The lowest parabola at every target pixel of a row."""
    column = pdf["xs"].notna().to_numpy()
    x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("x0", "x1"))
    at, x = _repeat(np.where(column, 0, x0), np.where(column, 0, x1))
    order = np.lexsort((x, code[at]))
    at, x = at[order], x[order]
    given = np.nonzero(column)[0]
    if len(given):
        c = np.concatenate(list(pdf["xs"].to_numpy()[given])).astype(np.int64)
        g = np.concatenate(list(pdf["gs"].to_numpy()[given])).astype(np.int64)
        of = np.repeat(code[given], [len(v) for v in pdf["xs"].to_numpy()[given]])
        order = np.lexsort((c, of))
        c, g, of = c[order], g[order], of[order]
        d = lowest(code[at], x, of, c, g * g)
    else:
        d = np.full(len(x), NOWHERE)
    out = pdf[[*keys, "y"]].iloc[at].reset_index(drop=True)
    return out.assign(x=x.astype(np.int32), d=d)


def lowest(row: np.ndarray, x: np.ndarray, of: np.ndarray, c: np.ndarray, up: np.ndarray) -> np.ndarray:
    """``min((x - c)**2 + up)`` over the columns of the same row; both sides sorted by row, then by place."""
    out = np.full(len(x), NOWHERE, dtype=np.int64)
    rows, ta = np.unique(row, return_index=True)
    tb = np.r_[ta[1:], len(row)]
    ca, cb = np.searchsorted(of, rows, side="left"), np.searchsorted(of, rows, side="right")
    some = cb > ca
    ta, tb, ca, cb = ta[some], tb[some], ca[some], cb[some]
    while len(ta):
        mid = (ta + tb) // 2
        _, j = _repeat(ca, cb)
        n = cb - ca
        first = np.cumsum(n) - n
        value = (np.repeat(x[mid], n) - c[j]) ** 2 + up[j]
        least = np.minimum.reduceat(value, first)
        hit = np.nonzero(value == np.repeat(least, n))[0]
        best = j[hit[np.searchsorted(hit, first)]]  # the leftmost of equally low ones
        out[mid] = least
        ta, tb, ca, cb = np.r_[ta, mid + 1], np.r_[mid, tb], np.r_[ca, best], np.r_[best + 1, cb]
        some = tb > ta
        ta, tb, ca, cb = ta[some], tb[some], ca[some], cb[some]
    return out

"""Masks as horizontal runs ``keys, y, x0, x1`` (half-open), and set algebra on them.

A run table is about a stroke-width smaller than its pixel table, and every operator here is one
shuffle of runs by the first key, the page: what they grow or open into stays in the task that
holds the page. A row of a page is the largest group a window ever sees, and the page width bounds it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.kernels import ellipse, spans
from pagelens.operators.graph import components, map_groups, min_labels
from pagelens.operators.grouping import split_hot
from pagelens.session import dealt, materialize, prepare

RK = ("page_id", "region_id")
LABEL_LIMIT = 200_000
_SHIFT, _WIDTH, _CODE_BITS = 4096, 1 << 20, 40


def checked(name: str) -> Column:
    """A coordinate, or an error where one number could not hold it together with another one."""
    c = F.col(name)
    return F.when((c >= -_SHIFT) & (c < _WIDTH - _SHIFT), c).otherwise(F.raise_error(F.lit("a mask lies outside of the coordinates that labels and distances can hold")))


def to_runs(pixels: DataFrame, keys: Sequence[str] = RK) -> DataFrame:
    w = Window.partitionBy(*keys, "y").orderBy("x")
    isle = pixels.select(*keys, "y", "x", (F.col("x") - F.row_number().over(w)).alias("isle"))
    return isle.groupBy(*keys, "y", "isle").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("isle")


def to_pixels(runs: DataFrame) -> DataFrame:
    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select(*rest, F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))


def merge_runs(runs: DataFrame, keys: Sequence[str] = RK) -> DataFrame:
    """Union of overlapping or touching runs of a row."""
    prepare(runs.sparkSession)
    return _merged(dealt(runs.select(*keys, "y", "x0", "x1"), keys[0]), keys)


def _merged(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = runs.select(*keys, "y", "x0", "x1", F.when(F.col("x0") <= reach, 0).otherwise(1).alias("cut"))
    isle = cut.withColumn("isle", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return isle.groupBy(*keys, "y", "isle").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("isle")


def combine(layers: dict[str, DataFrame], keep: Callable[[dict[str, Column]], Column], keys: Sequence[str] = RK) -> DataFrame:
    """Set algebra over any number of masks in one sweep per pixel row.

    ``keep`` gets how many runs of each layer cover a stretch and says whether it stays.
    """
    keys, names = list(keys), list(layers)
    prepare(next(iter(layers.values())).sparkSession)
    # runs are dealt as they are; they grow and fall into their ends in the task that holds the page
    sources = [getattr(runs, "_grown", (runs, None)) for runs in layers.values()]
    flat = [runs.select(*keys, "y", "x0", "x1", F.lit(i).alias("layer")) for i, (runs, _) in enumerate(sources)]
    rows = dealt(reduce(DataFrame.unionByName, flat), keys[0])
    if any(k for _, k in sources):
        rows = _widened(rows, F.element_at(F.array(*[spans(k or 1) for _, k in sources]), F.col("layer") + 1))
    ends = F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))
    events = rows.select(*[c for c in rows.columns if c not in ("x0", "x1")], F.explode(ends).alias("e")).select(*keys, "y", "layer", "e.x", "e.d")
    w = Window.partitionBy(*keys, "y").orderBy("x")
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.select(
        *keys, "y", F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"),
        *[F.sum(F.when(F.col("layer") == i, F.col("d")).otherwise(0)).over(upto).alias(n) for i, n in enumerate(names)]
    )
    parts = swept.filter(F.col("x1") > F.col("x0")).filter(keep({n: F.col(n) for n in names}))
    return _merged(parts.select(*keys, "y", "x0", "x1"), keys)


def union(a, b, keys=RK):
    return merge_runs(a.select(*keys, "y", "x0", "x1").unionByName(b.select(*keys, "y", "x0", "x1")), keys)


def intersect(a, b, keys=RK):
    return combine({"a": a, "b": b}, lambda c: (c["a"] > 0) & (c["b"] > 0), keys)


def subtract(a, b, keys=RK):
    return combine({"a": a, "b": b}, lambda c: (c["a"] > 0) & (c["b"] == 0), keys)


def box_runs(boxes: DataFrame, keys: Sequence[str] = RK) -> DataFrame:
    """Full rectangles as runs."""
    solid = boxes.filter("x2 > x1 and y2 > y1")
    return solid.select(*keys, F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"), F.col("x1").alias("x0"), F.col("x2").alias("x1"))


def clip(runs: DataFrame, boxes: DataFrame, keys: Sequence[str] = RK) -> DataFrame:
    box = boxes.select(*keys, *[F.col(c).alias("b" + c) for c in ("x1", "y1", "x2", "y2")])
    j = runs.join(box, list(keys)).filter((F.col("y") >= F.col("by1")) & (F.col("y") < F.col("by2")))
    cut = j.select(*keys, "y", F.greatest("x0", "bx1").alias("x0"), F.least("x1", "bx2").alias("x1"))
    return cut.filter("x1 > x0")


def _widened(runs: DataFrame, rows: Column) -> DataFrame:
    """Each run turned into one run for every ``dy, hw`` of a kernel's rows."""
    rest = [c for c in runs.columns if c not in ("y", "x0", "x1")]
    return runs.select(*rest, "y", "x0", "x1", F.explode(rows).alias("s")).select(
        *rest, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x0") - F.col("s.hw")).alias("x0"), (F.col("x1") + F.col("s.hw")).alias("x1")
    )


def grow(runs: DataFrame, k: int, keys: Sequence[str] = RK) -> DataFrame:
    """Each run turned into one widened run per kernel row; they may overlap, which :func:`combine` doesn't mind.

    :func:`combine` takes the runs before they grow, so that only those are shuffled.
    """
    runs = runs.select(*keys, "y", "x0", "x1")
    out = _widened(runs, spans(k))
    out._grown = (runs, k)
    return out


def dilate(runs: DataFrame, k: int, keys: Sequence[str] = RK) -> DataFrame:
    prepare(runs.sparkSession)
    return _merged(_widened(dealt(runs.select(*keys, "y", "x0", "x1"), keys[0]), spans(k)), keys)


def dilate_times(runs: DataFrame, times: int, keys: Sequence[str] = RK) -> DataFrame:
    """``times`` dilations by the 3x3 cross at once: a diamond."""
    prepare(runs.sparkSession)
    rows = F.array(*[F.struct(F.lit(d).alias("dy"), F.lit(times - abs(d)).alias("hw")) for d in range(-times, times + 1)])
    return _merged(_widened(dealt(runs.select(*keys, "y", "x0", "x1"), keys[0]), rows), keys)


def erode(runs: DataFrame, k: int, boxes: DataFrame | None = None, keys: Sequence[str] = RK) -> DataFrame:
    """Pixels whose whole kernel lies in the mask; outside ``boxes`` everything counts as mask.

    Every kernel row shrinks the runs by its half-width, and a pixel stays where all rows meet.
    Expects disjoint, non-touching runs.
    """
    r, keys = k // 2, list(keys)
    if boxes is not None:
        frame = boxes.select(*keys, (F.col("x1") - r).alias("x1"), (F.col("y1") - r).alias("y1"), (F.col("x2") + r).alias("x2"), (F.col("y2") + r).alias("y2"))
        border = subtract(box_runs(frame, keys), box_runs(boxes, keys), keys)
        runs = union(clip(runs, boxes, keys), border, keys)
    need = len(ellipse(k))
    shrunk = runs.select(*keys, "y", "x0", "x1", F.explode(spans(k)).alias("s")).select(
        *keys, (F.col("y") - F.col("s.dy")).alias("y"), (F.col("x0") + F.col("s.hw")).alias("x0"), (F.col("x1") - F.col("s.hw")).alias("x1")
    ).filter("x1 > x0")
    out = combine({"m": shrunk}, lambda c: c["m"] >= need, keys)
    return out if boxes is None else clip(out, boxes, keys)


def close(runs: DataFrame, k: int, boxes: DataFrame, keys: Sequence[str] = RK) -> DataFrame:
    return erode(clip(dilate(runs, k, keys), boxes, keys), k, boxes, keys)


def ring(runs: DataFrame, k: int, keys: Sequence[str] = RK) -> DataFrame:
    return subtract(grow(runs, k, keys), runs, keys)


# ---------------------------------------------------------------- connected components


def label_runs(runs: DataFrame, keys: Sequence[str] = RK, conn: int = 8, limit: int = LABEL_LIMIT) -> DataFrame:
    """Adds ``label``: the same number for all runs of one connected component.

    Mask and labels are written once, because callers read both several times. A mask of up to ``limit`` runs is labelled inside Arrow batches of whole groups; larger masks
    become an edge table between neighbouring rows and go through the distributed components.
    """
    keys = list(keys)
    base = runs.select(*keys, checked("y").cast("int").alias("y"), checked("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))
    base = materialize(base, "mask")
    cold, hot = split_hot(base, keys, limit)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields) + ", label long"
    slack = 0 if conn == 8 else 1
    out = map_groups(cold, keys, lambda pdf, code: _label_groups(pdf, code, slack), schema)
    if hot is not None:
        out = out.unionByName(_label_large(hot, keys, slack))
    return materialize(out, "labels")


def _run_id() -> Column:
    return (F.col("y") + _SHIFT).cast("bigint") * _WIDTH + F.col("x0") + _SHIFT


def _label_groups(pdf: pd.DataFrame, code: np.ndarray, slack: int) -> pd.DataFrame:
    at = np.lexsort((pdf["x0"].to_numpy(), pdf["y"].to_numpy(), code))
    pdf, code = pdf.iloc[at].reset_index(drop=True), code[at]
    y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    own = (y + _SHIFT) * _WIDTH + _SHIFT
    row = (code << _CODE_BITS) + own
    below = row + _WIDTH
    lo = np.searchsorted(row + x1, below + x0 + slack, side="left")
    hi = np.searchsorted(row + x0, below + x1 - slack, side="right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    lab = min_labels(len(y), a, b)
    return pdf.assign(label=own[lab] + x0[lab])


def _label_large(runs: DataFrame, keys: list[str], slack: int) -> DataFrame:
    node = runs.select(*keys, "y", "x0", "x1", _run_id().alias("node"))
    up = node.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("ux0"), F.col("x1").alias("ux1"), F.col("node").alias("a"))
    edges = node.join(up, [*keys, "y"]).filter(
        (F.col("ux1") >= F.col("x0") + slack) & (F.col("ux0") <= F.col("x1") - slack)
    ).select(*keys, "a", F.col("node").alias("b"))
    return components(node, edges, keys).select(*keys, "y", "x0", "x1", "label")


def component_stats(labelled: DataFrame, keys: Sequence[str] = RK) -> DataFrame:
    """Area, box, sides, span and fill ratio per component."""
    s = labelled.groupBy(*keys, "label").agg(
        F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("bx1"), F.min("y").alias("by1"),
        F.max("x1").alias("bx2"), (F.max("y") + 1).alias("by2"),
    )
    w, h = F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")
    return s.withColumns({
        "width": w, "height": h, "long_side": F.greatest(w, h), "short_side": F.greatest(F.least(w, h), F.lit(1)),
        "fill_ratio": F.col("area") / (w * h),
    })


def keep_components(labelled: DataFrame, wanted: DataFrame, keys: Sequence[str] = RK) -> DataFrame:
    return labelled.join(wanted.select(*keys, "label").distinct(), [*keys, "label"], "left_semi").drop("label")


def touching(labelled: DataFrame, other: DataFrame, keys: Sequence[str] = RK) -> DataFrame:
    """Labels of components sharing a pixel with ``other``."""
    o = other.select(*keys, "y", F.col("x0").alias("o0"), F.col("x1").alias("o1"))
    hit = labelled.join(o, [*keys, "y"]).filter((F.col("x0") < F.col("o1")) & (F.col("o0") < F.col("x1")))
    return hit.select(*keys, "label").distinct()


def fill_holes(runs: DataFrame, boxes: DataFrame, keys: Sequence[str] = RK) -> DataFrame:
    """Add background components (4-neighbour) that do not reach the box border."""
    keys = list(keys)
    back = label_runs(subtract(box_runs(boxes, keys), runs, keys), keys, conn=4)
    stats = component_stats(back, keys).join(boxes.select(*keys, "x1", "y1", "x2", "y2"), keys)
    shut = stats.filter("bx1 > x1 and by1 > y1 and bx2 < x2 and by2 < y2")
    return union(runs, keep_components(back, shut, keys), keys)

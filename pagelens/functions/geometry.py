"""Column expressions over half-open xyxy boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.settings import SETTINGS


def area(x1, y1, x2, y2) -> Column:
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0)).cast("bigint")
    return side(x1, x2) * side(y1, y2)


def inter(a, b) -> Column:
    """Intersection area of two structs (or dotted columns) with x1..y2 fields."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    zero = F.lit(0)
    return F.greatest(w, zero).cast("bigint") * F.greatest(h, zero).cast("bigint")


def box_area(b) -> Column:
    return area(b["x1"], b["y1"], b["x2"], b["y2"])


def suppresses(a, b, iou, contain) -> Column:
    """Whether surviving box ``a`` removes ``b``: overlap above ``iou`` and containment reaching ``contain``."""
    i = inter(a, b)
    sa, sb = box_area(a), box_area(b)
    return (i / (sa + sb - i + F.lit(1e-9)) > iou) & (i / (F.least(sa, sb) + F.lit(1e-9)) >= contain)


def sides(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")}


def clamp(value, lo, hi) -> Column:
    return F.least(F.greatest(value, lo), hi)


def min_font(page_w) -> Column:
    s = SETTINGS
    scaled = F.bround(F.lit(s.min_font) * page_w / F.lit(s.min_font_ref_width)).cast("int")
    return F.when((page_w <= 0) | (page_w >= s.min_font_ref_width), F.lit(s.min_font)).otherwise(
        clamp(scaled, F.lit(s.min_font_abs), F.lit(s.min_font))
    )


def emergency_floor(page_w) -> Column:
    """Two sizes under the page minimum, never below the absolute one."""
    return F.greatest(min_font(page_w) - F.lit(max(SETTINGS.min_font - 9, 0)), F.lit(SETTINGS.min_font_abs))


def font_cap(min_side, page_w) -> Column:
    s = SETTINGS
    size = F.bround(min_side * F.lit(s.cap_per_side) / F.lit(s.cap_per_size)).cast("int")
    return clamp(size, min_font(page_w), F.lit(s.max_font))


def stroke_px(glyph) -> Column:
    return clamp(F.bround(glyph * F.lit(0.06)).cast("int"), F.lit(1), F.lit(4))


def kernel_px(glyph) -> Column:
    """Odd dilation kernel for a glyph size, between 3 and 31."""
    half = F.floor(((glyph + 30) * F.lit(SETTINGS.dilate_ratio)).cast("int") / 2)
    return F.least(F.greatest(half * 2 + 1, F.lit(3)), F.lit(31)).cast("int")

"""Elliptic structuring elements as half-widths per row offset."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ellipse(k: int) -> list[tuple[int, int]]:
    """``(dy, half_width)`` rows of the k x k ellipse, k odd."""
    r = k // 2
    return [(dy, round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0) for dy in range(-r, r + 1)]


def spans(k: int) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(hw).alias("hw")) for dy, hw in ellipse(k)])

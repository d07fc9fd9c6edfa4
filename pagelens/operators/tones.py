"""Histograms of channel values: counts by region and value, merged by adding.

Pixels are counted where they are read; at most 256 counts for each region and channel leave a task, however
large the raster is. Medians, spreads, shares and thresholds are then read from the counts of a region, which
stand in one sorted array, without looking at the pixels again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tones(px: DataFrame, keys: Sequence[str], channels: Sequence[str] = ("grey",)) -> DataFrame:
    """``keys, n``, and ``h_<channel>`` for every channel: an array of ``v, n`` in ascending ``v``.

    ``n`` counts the pixels of a group. Values are whole numbers; nulls are not counted.
    """
    keys = list(keys)
    if len(channels) == 1:
        each = px.select(*keys, F.lit(channels[0]).alias("channel"), F.col(channels[0]).alias("v"))
    else:
        each = px.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])).alias("t"))
        each = each.select(*keys, "t.channel", "t.v")
    counts = each.filter("v IS NOT NULL").groupBy(*keys, "channel", "v").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: F.col("channel") == c
    bins = [F.sort_array(F.collect_list(F.when(of(c), F.struct("v", "n")))).alias(f"h_{c}") for c in channels]
    return counts.groupBy(*keys).agg(F.sum(F.when(of(channels[0]), F.col("n"))).alias("n"), *bins)


def total(h: Column) -> Column:
    return F.aggregate(h, F.lit(0).cast("bigint"), lambda a, e: a + e["n"])


def beside(h: Column, given: Column) -> Column:
    """``h`` with ``given`` in every bin as ``m``; inside of a lambda it would be worked out for each bin."""
    return F.zip_with(h, F.array_repeat(given, F.size(h)), lambda e, m: F.struct(e["v"].alias("v"), e["n"].alias("n"), m.alias("m")))


def above(h: Column, cut: Column) -> Column:
    """The bins over ``cut``."""
    return F.transform(F.filter(beside(h, cut), lambda e: e["v"] > e["m"]), lambda e: F.struct(e["v"].alias("v"), e["n"].alias("n")))


def upto(h: Column, cut: Column) -> Column:
    """The bins that are not over ``cut``."""
    return F.transform(F.filter(beside(h, cut), lambda e: e["v"] <= e["m"]), lambda e: F.struct(e["v"].alias("v"), e["n"].alias("n")))


def median(h: Column, n: Column | None = None) -> Column:
    """Exact median: the mean of the two middle values, null for no pixels. ``n``, the number of pixels, saves a count."""
    none = F.lit(None).cast("double")
    n = total(h) if n is None else n
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)

    def step(a: Column, e: Column) -> Column:
        upto, v = a["upto"] + e["n"], e["v"].cast("double")
        return F.struct(
            upto.alias("upto"), a["low"].alias("low"), a["high"].alias("high"),
            F.coalesce(a["lower"], F.when(upto > a["low"], v)).alias("lower"), F.coalesce(a["upper"], F.when(upto > a["high"], v)).alias("upper"))

    start = F.struct(F.lit(0).cast("bigint").alias("upto"), low.alias("low"), high.alias("high"), none.alias("lower"), none.alias("upper"))
    return F.aggregate(h, start, step, lambda a: (a["lower"] + a["upper"]) / 2)


def deviations(h: Column, middle: Column) -> Column:
    """The histogram of distances to ``middle``."""
    return F.sort_array(F.transform(beside(h, middle), lambda e: F.struct(F.abs(e["v"] - e["m"]).alias("v"), e["n"].alias("n"))))


def mad(h: Column, middle: Column) -> Column:
    """Median distance to ``middle``."""
    return median(deviations(h, middle), total(h))


def otsu(h: Column) -> Column:
    """``threshold, variance`` of maximum between-class variance (ties: lowest); null where all pixels are alike."""
    n = total(h)
    mass = F.aggregate(h, F.lit(0).cast("bigint"), lambda a, e: a + e["n"] * e["v"])
    none = F.lit(None)

    def step(a: Column, e: Column) -> Column:
        w0, s0 = a["w0"] + e["n"], a["s0"] + e["n"] * e["v"]
        d = (s0 * a["n"] - w0 * a["mass"]).cast("double")
        var = d * d / (w0 * (a["n"] - w0)).cast("double")
        better = (w0 < a["n"]) & (a["variance"].isNull() | (var > a["variance"]))
        return F.struct(
            w0.alias("w0"), s0.alias("s0"), a["n"].alias("n"), a["mass"].alias("mass"),
            F.when(better, e["v"]).otherwise(a["threshold"]).cast("int").alias("threshold"), F.when(better, var).otherwise(a["variance"]).alias("variance"))

    zero = F.lit(0).cast("bigint")
    start = F.struct(
        zero.alias("w0"), zero.alias("s0"), n.alias("n"), mass.alias("mass"), none.cast("int").alias("threshold"), none.cast("double").alias("variance"))
    return F.aggregate(h, start, step, lambda a: F.struct(a["threshold"].alias("threshold"), a["variance"].alias("variance")))

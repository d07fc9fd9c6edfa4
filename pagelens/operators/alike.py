"""The most similar image by pixel error, by successive elimination.

The sum of absolute differences of two images is never less than that of their block sums, for blocks of any size. So a
pyramid of block sums bounds the error from below, coarse levels first: whole images, then 4 x 4 and 16 x 16 blocks. The
neighbours in order of brightness give each target a first error; candidates are met by equal buckets of brightness
no further away than that, thinned out level by level, and only what is left is compared pixel by pixel, row
against row. Images with equal pixels are one image throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.grouping import Scan, scan
from pagelens.session import materialize

LEVELS = (4, 16)


def _rows(raster: DataFrame) -> DataFrame:
    """``page_id, y, w, px``: the grey levels of whole pixel rows."""
    row = raster.groupBy("page_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", "grey"))).alias("p"))
    return row.select("page_id", "y", F.size("p").alias("w"), F.transform("p", lambda p: p["grey"]).alias("px"))


def _images(rows: DataFrame) -> DataFrame:
    """``page_id, h, w, mark, total``: size, a number for the content, and the sum of all pixels."""
    mark = F.xxhash64("y", "px")
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return rows.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("h"), F.max("w").alias("w"), F.struct(F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).cast("string").alias("mark"), F.sum(total).alias("total"))


def _blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``image`` and ``b<n>`` for every level: sums of its n x n blocks, row by row."""
    j = rows.join(sizes.select("image", F.col("h").alias("_h")), rows["page_id"] == F.col("image"))
    out = None
    for n in LEVELS:
        cut = lambda i: F.floor(i * F.col("w") / n).cast("int")  # noqa: B023, E731
        part = lambda i: F.aggregate(F.slice("px", cut(i) + 1, cut(i + 1) - cut(i)), F.lit(0).cast("bigint"), lambda a, v: a + v)  # noqa: B023, E731
        sums = j.select("image", F.floor(F.col("y") * n / F.col("_h")).alias("by"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), part)).alias("bx", "s"))
        sums = sums.groupBy("image", "by", "bx").agg(F.sum("s").alias("s"))
        level = sums.groupBy("image").agg(F.transform(F.sort_array(F.collect_list(F.struct("by", "bx", "s"))), lambda b: b["s"]).alias(f"b{n}"))
        out = level if out is None else out.join(level, "image")
    return out


def _apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, d: s + d)


def _errors(pairs: DataFrame, targets: DataFrame, cands: DataFrame) -> DataFrame:
    """``t, c, error`` of pairs: rows of pixels meet, and only their sums are shuffled."""
    left = targets.select(F.col("page_id").alias("t"), "y", F.col("px").alias("a"))
    right = cands.select(F.col("page_id").alias("c"), "y", F.col("px").alias("b"))
    return pairs.select("t", "c").join(left, "t").join(right, ["c", "y"]).groupBy("t", "c").agg(F.sum(_apart("a", "b")).alias("error"))


def nearest_image(targets: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``target_id, cand_id, mae`` from pixel tables ``page_id, y, x, grey`` (y from 0, no gaps), and ``what, n``.

    The candidate of equal size with the least mean absolute error; ties go to the lowest ``page_id``. A target
    without a candidate of its size has no row. The second table counts different images (``targets``, ``cands``) and
    the ``pairs`` that were compared in full.
    """
    t_rows, c_rows = materialize(_rows(targets), "target-rows"), materialize(_rows(cands), "cand-rows")
    kind = ["h", "w"]
    t_all, c_all = materialize(_images(t_rows), "targets"), _images(c_rows)
    one = lambda df: df.groupBy(*kind, "mark", "total").agg(F.min("page_id").alias("image"))
    t, c = materialize(one(t_all), "images"), materialize(one(c_all), "images")
    t, c = (materialize(d.join(_blocks(r, d), "image"), "pyramid") for d, r in ((t, t_rows), (c, c_rows)))
    # the candidates next in brightness give a first error
    line = t.select(*kind, "total", F.lit(0).alias("side"), F.col("image").alias("t"), F.lit(None).cast("bigint").alias("c")).unionByName(
        c.select(*kind, "total", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("t"), F.col("image").alias("c")))
    id_ = F.coalesce("t", "c")
    darker = scan(line.withColumn("id", id_), kind, [F.col("total"), F.col("side"), F.col("id")], [Scan("near", "last", "c")])
    lighter = scan(line.withColumn("id", id_).withColumn("total", -F.col("total")), kind, [F.col("total"), -F.col("side"), F.col("id")], [Scan("near", "last", "c")])
    guess = lambda d: d.filter("side = 0 AND near IS NOT NULL").select("t", F.col("near").alias("c"))
    first = materialize(_errors(guess(darker).union(guess(lighter)).distinct(), t_rows, c_rows), "first-errors")
    bound = first.groupBy("t").agg(F.min("error").alias("most"))
    # candidates no further away in brightness, by buckets as wide as the usual error
    asks = materialize(t.select(F.col("image").alias("t"), *kind, F.col("total").alias("tt"), F.col("b4").alias("t4"), F.col("b16").alias("t16")).join(bound, "t"), "asks")
    wide = int(asks.agg(F.percentile_approx("most", 0.5)).first()[0] or 0) + 1
    asks = asks.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("tt") - F.col("most")) / wide), F.floor((F.col("tt") + F.col("most")) / wide))))
    pool = c.select(F.col("image").alias("c"), *kind, F.col("total").alias("ct"), F.col("b4").alias("c4"), F.col("b16").alias("c16"), F.floor(F.col("total") / wide).alias("bucket"))
    met = asks.join(pool, [*kind, "bucket"]).filter(F.abs(F.col("tt") - F.col("ct")) <= F.col("most"))
    met = met.filter(_apart("t4", "c4") <= F.col("most")).withColumn("low", _apart("t16", "c16")).filter(F.col("low") <= F.col("most"))
    met = materialize(met.select("t", "c", "low", "most"), "survivors")
    # the most promising one gives a better error before all others are compared
    best = _errors(met.groupBy("t").agg(F.min_by("c", F.struct("low", "c")).alias("c")), t_rows, c_rows).select("t", F.col("error").alias("better"))
    left = materialize(met.join(best, "t").filter("low <= better").select("t", "c"), "compared")
    found = _errors(left, t_rows, c_rows).groupBy("t").agg(F.min(F.struct("error", "c")).alias("m"))
    named = t_all.join(t.select(*kind, "mark", F.col("image").alias("t")), [*kind, "mark"]).join(found, "t")
    out = named.select(F.col("page_id").alias("target_id"), F.col("m.c").alias("cand_id"), (F.col("m.error") / (F.col("h") * F.col("w"))).alias("mae"))
    tally = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, d in (("targets", t), ("cands", c), ("pairs", left))]
    return out, reduce(DataFrame.unionByName, tally)

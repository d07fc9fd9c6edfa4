"""Rule evaluation, parameter sweeps, calibration and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.boxes import grid
from pagelens.operators.ordering import panels
from pagelens.settings import SETTINGS


def evaluate_rules(cases: DataFrame, variants: dict[str, Column], truth: str = "want", positive: str = "SFX") -> DataFrame:
    """Errors per rule variant, case set and direction, with the first missed case.

    ``cases`` has ``case_set, case, want``; a variant is a column predicting the label.
    """
    tries = F.array(*[F.struct(F.lit(n).alias("variant"), rule.alias("got")) for n, rule in variants.items()])
    t = cases.select("*", F.explode(tries).alias("t")).select("case_set", "case", truth, "t.variant", "t.got")
    wrong = F.col("got") != F.col(truth)
    return t.groupBy("variant", "case_set").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(wrong).alias("errors"), F.count_if(wrong & (F.col("got") == positive)).alias("false_positive"),
        F.count_if(wrong & (F.col(truth) == positive)).alias("missed"), F.min(F.when(wrong, F.col("case"))).alias("first_miss"))


def sweep(sides: DataFrame, spacings: list[float], pads: list[float], lo: int = SETTINGS.min_font, hi: int = SETTINGS.max_font) -> DataFrame:
    """Score each grid point over all boxes: unfit boxes, p35 size, spread and mean deviation; ``best`` marks the pick.

    Boxes collapse to a histogram of their short side before the grid multiplies them.
    """
    hist = sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    g = grid(hist, spacing=spacings, pad=pads)
    raw = ((F.col("side") - 2 * (F.col("side") * F.col("pad")).cast("int")) / (F.col("spacing") * 4)).cast("int")
    g = g.withColumn("feas", F.when(raw < lo, 0).otherwise(F.least(raw, F.lit(hi))))
    keys = ["spacing", "pad"]
    target = g.filter("feas > 0").groupBy(*keys).agg(F.percentile("feas", F.lit(0.35), F.col("n")).alias("p")).select(
        *keys, F.least(F.greatest(F.bround("p").cast("int"), F.lit(lo)), F.lit(hi)).alias("target"))
    used = F.least("feas", "target")
    want = F.col("side") * SETTINGS.cap_per_side / SETTINGS.cap_per_size
    fit = F.col("feas") > 0
    s = g.join(target, keys).groupBy(*keys, "target").agg(
        F.sum(F.when(fit, 0).otherwise(F.col("n"))).cast("bigint").alias("zeros"),
        (F.max(F.when(fit, used)) / F.min(F.when(fit, used))).alias("spread"),
        (F.sum(F.when(fit, F.col("n") * F.abs(used - want))) / F.sum(F.when(fit, F.col("n")))).alias("deviation"))
    s = s.withColumns({"spread": F.round("spread", 2), "deviation": F.round("deviation", 2)})
    pick = s.agg(F.min(F.struct("zeros", "spread", "deviation", "spacing", "pad")).alias("m"))
    return s.join(pick.select("m.spacing", "m.pad", F.lit(True).alias("best")), keys, "left").withColumn("best", F.coalesce("best", F.lit(False)))


def calibrate(df: DataFrame, group: str, value: Column) -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.10, 0.25, 0.5, 0.75, 0.90)])).alias("q")
    names = ("p10", "p25", "median", "p75", "p90")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), q).select(group, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def size_models(regions: DataFrame) -> DataFrame:
    """Mean absolute error of five size models against a reference size, per page.

    ``regions`` has ``page_id, det_id, x1..y2, feas, ideal, ref``. uniform = p35 of the page,
    proportional = ideal, panel = median of the panel, fill = feasible, scaled = best factor k.
    """
    r = panels(regions.filter("feas > 0 and ref > 0"))
    p35 = r.groupBy("page_id").agg(F.percentile("feas", F.lit(0.35)).cast("int").alias("p35"))
    mid = r.groupBy("page_id", "panel").agg(F.bround(F.median(F.least("ideal", "feas"))).cast("int").alias("mid"))
    r = r.join(p35, "page_id").join(mid, ["page_id", "panel"])
    err = lambda size: F.abs(F.least(size, F.col("feas")) - F.col("ref"))
    base = {"uniform": F.col("p35"), "proportional": F.bround("ideal").cast("int"), "panel": F.col("mid"), "fill": F.col("feas")}
    ks = [1.0 + i * 0.05 for i in range(21)]
    aggs = [F.avg(err(c)).alias(n) for n, c in base.items()] + [F.avg(err(F.bround(F.col("ideal") * k).cast("int"))).alias(f"k{i}") for i, k in enumerate(ks)]
    e = r.groupBy("page_id").agg(*aggs)
    best = F.array_min(F.array(*[F.struct(F.round(f"k{i}", 9).alias("e"), F.lit(k).alias("k")) for i, k in enumerate(ks)]))
    e = e.withColumn("b", best)
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("error"), F.lit(None).cast("double").alias("k")) for n in base],
                   F.struct(F.lit("scaled").alias("model"), F.col("b.e").alias("error"), F.col("b.k").alias("k")))
    return e.select("page_id", F.inline(rows))


def check(df: DataFrame, expectations: dict[str, Column]) -> DataFrame:
    """PASS/FAIL per named predicate over all rows and for all together, from a single aggregate.

    No rows at all is a failure of its own: every count below it would be zero without proving anything.
    """
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(p, F.lit(False))).alias(f"bad{i}") for i, p in enumerate(expectations.values())])
    fails = [F.col(f"bad{i}") for i in range(len(expectations))]
    items = [("has_rows", F.when(F.col("rows") > 0, 0).otherwise(1))] + list(zip(expectations, fails))
    items.append(("all", sum((F.when(c > 0, 1).otherwise(0) for _, c in items), F.lit(0))))
    made = F.array(*[F.struct(F.lit(n).alias("name"), F.when(c > 0, "FAIL").otherwise("PASS").alias("status"), c.cast("bigint").alias("failures")) for n, c in items])
    return one.select(F.inline(made))

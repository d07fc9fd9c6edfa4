"""Quality rules whose thresholds follow each language and source.

Every text is measured once. The measures of a group go into mergeable quantile sketches: counts of
buckets that grow by a constant factor, so that any quantile is right to a fixed relative error, two
sketches merge by adding counts, and the result does not depend on the order of merging. A source with
few documents borrows the sketch of its language, that of the whole table at last. Thresholds are
fences above the median, with the spread of the lower half, so that junk in under half of a group can't raise
them, and the documents are judged after a join with the thresholds.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import map_rows
from pagelens.llm.textstats import NAMES, measure
from pagelens.session import materialize

#: Relative error of a sketch's quantiles.
ERROR = 0.01
#: Documents a group needs for thresholds of its own.
SUPPORT = 200
#: Fences lie this many spreads (median less first decile) above the median.
FENCE = 3.0
#: Measure, expression, and the least spread that its fence assumes (it keeps a constant measure from rejecting at the first difference).
MEASURES = (
    ("symbol_share", "n_symbols / greatest(word_chars, 1)", 0.015),
    ("dup_line_share", "n_dup_lines / greatest(n_lines, 1)", 0.15),
    ("repeat_share", "n_repeat_words / greatest(n_words, 1)", 0.1),
    ("word_echo", "1 - ln(greatest(n_distinct, 1)) / ln(greatest(n_words, 2))", 0.05),
    ("upper_share", "n_upper / greatest(n_letters, 1)", 0.08),
    ("bang_share", "n_bangs / greatest(n_words, 1)", 0.05),
    ("word_length", "word_chars / greatest(n_words, 1)", 1.0),
)


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` with the counts of every whole text."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} long" for n in NAMES)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in batch.column(len(keep)).to_pylist()]
        made = [pa.array(x, type=pa.int64()) for x in zip(*rows)] if rows else [pa.array([], type=pa.int64())] * len(NAMES)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *NAMES])

    return map_rows(docs.select(*keep, "text"), run, schema)


def bucket(value: Column, error: float = ERROR) -> Column:
    """Sketch bucket of a value: -1 below 1e-6, else the power of the growth factor above 1e-6."""
    growth = math.log((1 + error) / (1 - error))
    return F.when(value < 1e-6, F.lit(-1)).otherwise(F.floor(F.log(value / 1e-6) / growth)).cast("int")


def bucket_value(b: Column, error: float = ERROR) -> Column:
    """Middle of a bucket, within the relative error of all its values."""
    growth = math.log((1 + error) / (1 - error))
    return F.when(b < 0, F.lit(0.0)).otherwise(1e-6 * F.exp((b + 0.5) * growth))


def sketches(values: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``keys, measure, bucket, n``; merging sketches is adding ``n``."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in measures])).alias("c")
    return values.select(*keys, cells).groupBy(*keys, "c.measure", "c.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """``keys, measure, total`` and one column for each share; a window holds the buckets of one sketch."""
    w = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = sketch.select("*", upto.alias("upto"), F.sum("n").over(w).alias("total"))
    picks = [bucket_value(F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bucket")))).alias(name) for name, q in shares.items()]
    return t.groupBy(*keys, "measure").agg(F.max("total").alias("total"), *picks)


def thresholds(values: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``lang, source`` with one fence for each measure, for every pair that occurs."""
    names = [m for m, _, _ in MEASURES]
    slack = F.element_at(F.create_map(*[F.lit(x) for m, _, s in MEASURES for x in (m, s)]), F.col("measure"))
    own = materialize(sketches(values, ["lang", "source"], names), "sketches")
    shares = {"low": 0.1, "mid": 0.5}
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = own.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        q = quantiles(merged, keys, shares).withColumn("fence", F.col("mid") + FENCE * F.greatest(F.col("mid") - F.col("low"), slack))
        wide = q.groupBy(*keys).pivot("measure", names).agg(F.first(F.struct("total", "fence")))
        levels.append(wide.select(*[F.col(k).alias(f"{k}{level}") for k in keys], *[F.col(m).alias(f"{m}{level}") for m in names]))
    pairs = own.select("lang", "source").distinct()
    j = pairs.join(levels[0], F.col("lang").eqNullSafe(F.col("lang0")) & F.col("source").eqNullSafe(F.col("source0")))
    j = j.join(levels[1], F.col("lang").eqNullSafe(F.col("lang1"))).join(F.broadcast(levels[2]))  # the last is a single row
    enough = lambda m, level: F.col(f"{m}{level}.total") >= support
    pick = lambda m: F.when(enough(m, 0), F.col(f"{m}0.fence")).when(enough(m, 1), F.col(f"{m}1.fence")).otherwise(F.col(f"{m}2.fence"))
    return j.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[pick(m).alias(f"_{m}") for m in names])


def judged(docs: DataFrame) -> DataFrame:
    """Every document with its counts, ``base_failed`` and ``kept``.

    Null and empty texts count nothing and fail the base rule. Null languages and sources are groups
    like any other. Repeated rows are judged alike; an empty table gives an empty result. Columns beside
    ``doc_id, lang, source, text`` are not read.
    """
    counts = materialize(measured(docs), "measures")
    values = counts.select("*", *[F.expr(e).cast("double").alias(m) for m, e, _ in MEASURES])
    limit = thresholds(values)
    j = values.join(limit, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    over = [F.coalesce(F.col(m) > F.col(f"_{m}"), F.lit(False)) for m, _, _ in MEASURES]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return j.withColumn("base_failed", failed).withColumn("kept", ~failed & ~reduce(lambda a, b: a | b, over))


def rule_report(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """DuckDB text of :func:`rule_report`."""
    growth = repr(math.log((1 + ERROR) / (1 - ERROR)))
    measures = {m: e.replace("/", "/ 1e0 /", 1).replace("/ 1e0 /", "* 1e0 /") for m, e, _ in MEASURES}
    cells = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, CASE WHEN {m} < 1e-6 THEN -1 ELSE CAST(floor(ln({m} / 1e-6) / {growth}) AS INT) END AS bucket FROM v" for m in measures)
    slack = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s}" for m, _, s in MEASURES) + " END"
    value = lambda q: f"min(CASE WHEN upto >= total * {q} THEN CASE WHEN bucket < 0 THEN 0e0 ELSE 1e-6 * exp((bucket + 5e-1) * {growth}) END END)"

    def level(name: str, keys: str) -> str:
        part = f"{keys}, measure" if keys else "measure"
        return f"""{name}_u AS (SELECT {part}, bucket, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {part}) AS total
  FROM (SELECT {part}, bucket, count(*) AS n FROM cells GROUP BY ALL)),
{name} AS (SELECT {part}, max(total) AS total, {value(0.5)} AS mid, {value(0.1)} AS lo FROM {name}_u GROUP BY {part})"""

    over = " OR ".join(f"coalesce({m} > (SELECT fence FROM fences f WHERE f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source AND measure = '{m}'), false)" for m in measures)
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{blank.replace("[", "[^", 1)}+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{blank.replace("[", "[^", 1)}')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM again) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(list_distinct(words)) AS n_distinct,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs
  FROM w LEFT JOIN rep USING (rid)),
v AS (SELECT *, {", ".join(f"{e} AS {m}" for m, e in measures.items())} FROM m),
cells AS ({cells}),
{level("a", "lang, source")}, {level("b", "lang")}, {level("c", "")},
fences AS (SELECT a.lang, a.source, measure, mid + {FENCE} * greatest(mid - lo, {slack}) AS fence FROM (
  SELECT a.lang, a.source, a.measure, CASE WHEN a.total >= {SUPPORT} THEN a.mid WHEN b.total >= {SUPPORT} THEN b.mid ELSE c.mid END AS mid,
    CASE WHEN a.total >= {SUPPORT} THEN a.lo WHEN b.total >= {SUPPORT} THEN b.lo ELSE c.lo END AS lo
  FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN c ON c.measure = a.measure) a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {over} AS over FROM v)
"""

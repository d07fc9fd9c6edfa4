"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a key by hashing its identifier. Within a source the keys are sorted by equal
ranges of the hash, word counts are summed for each range and carried forward, and inside a range a
window adds the rest: a prefix sum in which no task ever sees more than one range of one source.
A source's words are taken in that order: whole epochs first, then up to the exact budget, where the
document at the cut gives only its first words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import WORD, columns, fresh, numbered, set_aside
from pagelens.session import materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all words, and the most that one source may give.
SHARE, MOST = 1.5, 2
SEED = "mix-1"
#: Aim for rows of one range of one source.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size`` to the same with ``target``, as double.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all words. A
    target stops at ``most`` times its source's size and the excess goes to the others by weight. The
    common level of the others is found by aggregates over the table, so it never leaves the executors.
    """
    ranked = numbered(sizes, [F.col("source").isNull(), F.col("source")], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = materialize(ranked.select("source", "source_size", weight.alias("_w")), "sources")
    cap = F.col("source_size") * float(most)
    total = share * (t.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = cap <= level * F.col("_w")
        n, held, left = t.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_w")))).first()
        if n == stopped or not left:
            break
        stopped, level = n, (total - (held or 0.0)) / left
    return t.select("source", "source_size", F.least(cap, level * F.col("_w")).alias("target"))


def hash_key(doc_id: Column, seed: str) -> Column:
    """The key that orders a source's documents."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def hash_range(key: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(key, 1, 5), 16, 10).cast("int"), 20 - bits)


def laid_out(units: DataFrame, seed: str, weights: tuple[int, ...], share: float, most: int, range_rows: int) -> tuple[DataFrame, str, DataFrame, int]:
    """Equal ``units`` counted, with their key, words and range; the name of that count; each range of a source with what lies before it
    and what its source gives (``_epochs`` whole, then ``_quota`` words); and the bits of a range."""
    n = fresh(units, "n")
    grouped = units.groupBy(*columns(units)).agg(F.count(F.lit(1)).alias(n))
    d = materialize(grouped.withColumn("_key", hash_key(F.col("doc_id"), seed)).withColumn("_words", F.col("size") * F.col(n)), "units")
    rows = d.count()
    bits = 8
    while bits < 20 and rows >> bits > range_rows:
        bits += 1
    d = d.withColumn("_range", hash_range(F.col("_key"), bits))
    ranges = materialize(d.groupBy("source", "_range").agg(F.sum("_words").alias("_sum")), "range-sums")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    past = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_sum", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_past"))
    carried = carried.join(targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    quota = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    carried = carried.withColumn("_epochs", epochs).withColumn("_quota", quota - F.col("_epochs") * F.col("source_size"))
    return d, n, carried, bits


def taken_words(d: DataFrame, n: str, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, source_size, target, taken`` of the units of whole ranges, a row for each repeat."""
    inner = Window.partitionBy("source", "_range").orderBy("_key", "size", *[F.col(f"`{c}`") for c in keys if c not in ("source", "size")])
    before = F.sum("_words").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_words")
    d = d.withColumn("_before", before)
    j = d.join(carried, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    j = j.withColumn("_rest", F.col("_quota") - F.col("_past") - F.col("_before"))
    j = j.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_copy") * F.col("size")))
    return j.select(*[F.col(f"`{c}`") for c in keys], "source_size", "target", (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"))


def mix(units: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
        range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, source, size`` (any further columns are part of a unit's identity) to those columns with ``source_size, target, taken``.

    One row for each input row. Equal rows are counted before anything is shuffled and laid out one
    after another, so that repeated rows neither tie nor heap up; which of them the cut meets cannot be
    told apart. An empty table gives an empty result; a null source is a source, a null doc_id hashes
    like an empty one; a source of size 0 has target 0.
    """
    d, n, carried, _ = laid_out(units, seed, weights, share, most, range_rows)
    return taken_words(d, n, carried.drop("_sum"), units.columns)


def mix_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document. A null text has size 0."""
    units = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(units).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    A document taken twice gives two rows; the one at its source's cut gives a row with its first words
    only (and its ``n_chars`` follows). A document of which nothing is taken is gone, and so are those
    without a word. Equal rows are told apart by a number inside their group.

    Of a source's ranges those before the one with its cut are taken once more, those after it are not: what their documents
    give follows from their hashes, where the texts are. Only the texts of the ranges with cuts are shuffled.
    """
    slim, back = set_aside(docs, ("doc_id", "text", "source", "n_chars"))
    text = F.col("text")
    units = docs.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(text).alias("_h"))
    d, n, carried, bits = laid_out(units, SEED, WEIGHTS, SHARE, MOST, RANGE_ROWS)
    carried = materialize(carried, "carried")
    beyond = F.when(F.col("_past") + F.col("_sum") > F.col("_quota"), F.col("_r"))
    cuts = materialize(carried.groupBy("_s").agg(F.min(beyond).alias("_cut"), F.first("_epochs").alias("_epochs")), "cuts")
    placed = slim.select(*columns(slim), hash_range(hash_key(F.col("doc_id"), SEED), bits).alias("_range"))
    placed = placed.join(cuts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    once_more = F.when(F.col("_range") < F.col("_cut"), 1).otherwise(0)
    whole = placed.filter((F.col("_range") != F.col("_cut")) & F.regexp_like(text, F.lit(WORD)))
    whole = whole.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), (F.col("_epochs") + once_more).cast("int"))))
    group = Window.partitionBy("_hash", "doc_id", "source", "_size").orderBy(F.lit(1))
    edge = placed.filter("_range = _cut").withColumn("_size", word_count(text)).withColumn("_hash", F.xxhash64(text)).withColumn("_nth", F.row_number().over(group))
    edges = carried.drop("_sum").join(cuts.select(F.col("_s").alias("_t"), "_cut"), F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_r") == F.col("_cut"))).drop("_t", "_cut")
    met = d.join(edges.select("_s", "_r"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")), "left_semi")
    taken = taken_words(met, n, edges, units.columns)
    order = Window.partitionBy("_h", "doc_id", "source", "size").orderBy(F.desc("taken"))
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_h", "taken", F.row_number().over(order).alias("_i"))
    on = ((F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s"))
          & (F.col("_size") == F.col("_z")) & (F.col("_nth") == F.col("_i")))
    j = edge.join(taken.filter("taken > 0"), on)
    full = F.floor(F.col("taken") / F.col("_size"))
    rest = F.col("taken") - full * F.col("_size")
    copies = F.array_repeat(F.col("_size"), full.cast("int"))
    j = j.withColumn("_words", F.explode(F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)))
    short = F.col("_words") < F.col("_size")
    j = j.withColumn("_text", F.when(short, first_words(text, F.col("_words"))).otherwise(text))
    if "n_chars" in slim.columns:
        j = j.withColumn("n_chars", F.when(short, F.char_length("_text").cast(slim.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(whole.select(*columns(slim)).unionByName(j.withColumn("text", F.col("_text")).select(*columns(slim))))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word, white space inside kept as it is."""
    space = r"[\x20\x09-\x0D]+"
    led = F.regexp_like(text, F.lit("^" + space)).cast("int")
    rest = F.element_at(F.split(text, F.lit(space), (n + 1 + led).cast("int")), -1)
    upto = F.substring(text, F.lit(1), (F.char_length(text) - F.char_length(rest)).cast("int"))
    return F.regexp_replace(upto, space + "$", "")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((rk - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
o AS (SELECT *, {MOST}.0 * n / w AS full_at, coalesce(sum({MOST}.0::DOUBLE * n) OVER (ORDER BY {MOST}.0 * n / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(w) OVER (ORDER BY {MOST}.0 * n / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w),
c AS (SELECT *, ({SHARE} * (SELECT sum(n) FROM s) - held) / open_w AS level FROM o),
l AS (SELECT arg_min(level, (full_at, rk)) FILTER (WHERE level <= full_at) AS level FROM c),
t AS (SELECT source, n, least({MOST}.0::DOUBLE * n, w * level) AS target FROM w, l),
p AS (SELECT d.doc_id, d.size, t.n, t.target, round(t.target)::BIGINT AS quota,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '') || ':{SEED}'), d.size, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
  (CASE WHEN n > 0 THEN quota // n * size + greatest(0, least(size, quota % n - before)) ELSE 0 END)::BIGINT AS taken FROM p
"""

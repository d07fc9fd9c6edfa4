"""Per-group ordered work that stays safe when one group holds a large share of all rows.

Every helper measures group sizes first. Groups up to ``limit`` rows go through an ordinary
window or fold. Larger groups are cut into ordered blocks by a range shuffle, each block is
worked on by itself, and one small row per block carries the running state across blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.session import materialize, written

GROUP_LIMIT = 200_000
BLOCK_ROWS = 500_000


def split_hot(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups with at most ``limit`` rows, and the rest (``None`` when there is none).

    The input is written first unless it is a written table: it is read for the counts and for both parts.
    """
    df = written(df, "sized")
    big = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    if big.isEmpty():
        return df, None
    big = materialize(big, "hot-keys")
    return df.join(big, list(keys), "left_anti"), df.join(big, list(keys), "left_semi")


@dataclass(frozen=True)
class Scan:
    """One running column: ``kind`` is row_number, sum, max_before, last or lead."""

    name: str
    kind: str
    col: str | None = None


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    scans: Sequence[Scan],
    limit: int = GROUP_LIMIT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running columns over ``keys`` in ``order``.

    ``order`` holds ascending, comparable columns (descending numbers through :func:`down`)
    and must be a total order inside each group.
    """
    cold, hot = split_hot(df, keys, limit)
    plain = Window.partitionBy(*keys).orderBy(*order)
    out = cold.select("*", *[_running(s, plain).alias(s.name) for s in scans])
    if hot is None:
        return out
    return out.unionByName(_scan_blocks(hot, list(keys), list(order), list(scans), block_rows))


def _running(s: Scan, w: Window) -> Column:
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    if s.kind == "row_number":
        return F.row_number().over(w).cast("bigint")
    if s.kind == "sum":
        return F.sum(s.col).over(upto)
    if s.kind == "max_before":
        return F.max(s.col).over(before)
    if s.kind == "last":
        return F.last(s.col, ignorenulls=True).over(upto)
    if s.kind == "lead":
        return F.lead(s.col).over(w)
    raise ValueError(s.kind)


def _scan_blocks(df, keys, order, scans, block_rows):
    blocks = max(2, -(-df.count() // block_rows))
    ranged = df.repartitionByRange(blocks, *[F.col(k) for k in keys], *order)
    tagged = materialize(ranged.withColumn("_blk", F.spark_partition_id()), "ordered-blocks")
    inner = Window.partitionBy(*keys, "_blk").orderBy(*order)
    edge = {
        "row_number": lambda s: F.count(F.lit(1)),
        "sum": lambda s: F.sum(s.col),
        "max_before": lambda s: F.max(s.col),
        "last": lambda s: F.max_by(F.col(s.col), F.when(F.col(s.col).isNotNull(), F.struct(*order))),
        "lead": lambda s: F.min_by(F.struct(F.col(s.col).alias("v")), F.struct(*order)),
    }
    heads = tagged.groupBy(*keys, "_blk").agg(*[edge[s.kind](s).alias(s.name) for s in scans])
    outer = Window.partitionBy(*keys).orderBy("_blk")
    past = outer.rowsBetween(Window.unboundedPreceding, -1)
    carry = {
        "row_number": lambda s: F.coalesce(F.sum(s.name).over(past), F.lit(0)),
        "sum": lambda s: F.sum(s.name).over(past),
        "max_before": lambda s: F.max(s.name).over(past),
        "last": lambda s: F.last(s.name, ignorenulls=True).over(past),
        "lead": lambda s: F.lead(s.name).over(outer),
    }
    carried = heads.select(*keys, "_blk", *[carry[s.kind](s).alias(f"_in_{s.name}") for s in scans])
    tail = F.lead(F.lit(1)).over(inner).isNull().alias("_tail")
    joined = tagged.select("*", tail, *[_running(s, inner).alias(s.name) for s in scans]).join(
        carried, [*keys, "_blk"]
    )
    final = []
    for s in scans:
        own, came = F.col(s.name), F.col(f"_in_{s.name}")
        if s.kind == "row_number":
            value = own + came
        elif s.kind == "sum":
            value = F.when(own.isNull() & came.isNull(), None).otherwise(
                F.coalesce(own, F.lit(0)) + F.coalesce(came, F.lit(0))
            )
        elif s.kind == "max_before":
            value = F.greatest(own, came)
        elif s.kind == "last":
            value = F.coalesce(own, came)
        else:
            value = F.when(F.col("_tail"), came["v"]).otherwise(own)
        final.append(value.alias(s.name))
    return joined.select(*df.columns, *final)


def down(col: Column) -> Column:
    """Descending numeric order written as an ascending expression."""
    return -col


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, limit: int = GROUP_LIMIT
) -> DataFrame:
    """1-based rank per group."""
    return scan(df, keys, order, [Scan(name, "row_number")], limit)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark trims each task to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= k)

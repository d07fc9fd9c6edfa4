"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelens.session import materialize

#: A word is a run of anything but ASCII white space (Java and DuckDB pattern).
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the identifier as text, modulo ``mod``; null for a null identifier."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def give_back() -> None:
    """Hands memory that a finished task has freed back to the machine; a worker is kept for the next task, its free memory need not be."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over a task's batches, with memory given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``fn`` over every Arrow batch; it keeps no state, so a lost task can run again anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(lean(run), schema)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 1 in ``order`` (a total order) without sorting them in one task.

    A range shuffle sorts; only one count for each range meets in a single task.
    """
    blk = fresh(df, "blk")
    ranged = materialize(df.repartitionByRange(shuffle_width(df), *order).withColumn(blk, F.spark_partition_id()), "ranges")
    past = Window.orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    heads = ranged.groupBy(blk).agg(F.count(F.lit(1)).alias(f"{blk}n"))
    heads = heads.select(blk, F.coalesce(F.sum(f"{blk}n").over(past), F.lit(0)).alias(f"{blk}before"))
    inner = Window.partitionBy(blk).orderBy(*order)
    out = ranged.join(heads, blk).withColumn(name, F.row_number().over(inner) + F.col(f"{blk}before"))
    return out.select(*columns(df), F.col(name).cast("long"))


def columns(df: DataFrame) -> list[Column]:
    """All columns, quoted so that dots in names do no harm."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def set_aside(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``keep`` in one struct, so that no name of theirs clashes, and the way back."""
    keep = tuple(c for c in keep if c in docs.columns)
    rest = [c for c in docs.columns if c not in keep]
    slim = docs.select(*keep, *([F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rest]).alias("_rest")] if rest else []))
    return slim, lambda out: out.select(*[F.col(c) if c in keep else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while any(t.startswith(name.lower()) for t in taken):
        name = f"_{name}"
    return name

"""Approximate nearest neighbours by cosine, with multiprobe p-stable hashing.

On unit vectors cosine and Euclidean order agree, so a vector is hashed by rounding random Gaussian
projections of its direction. Each table concatenates several of them. A query visits its own bucket and
then perturbed ones: moving a projection one step costs the square of the distance to that border, and
buckets are visited in order of total cost, which is the estimated order of success. Inside a bucket
queries meet vectors as matrices; only each query's best leave it. The candidates of all tables are
merged and ranked by the exact measure on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import map_rows, numbered, shuffle_width
from pagelens.session import materialize

#: Tables, projections of a key, width of a step, buckets a query visits in each table, steps that a perturbation may take.
TABLES, PROJECTIONS, STEP, PROBES, MOVES = 6, 6, 2.0, 48, 4
NEAREST = 5
EVERY = 50
SEED = 5
#: Vectors and queries of one bucket that one task compares; fuller buckets are dealt over tasks, every part against every part.
PART_VECTORS, PART_QUERIES = 50_000, 2_000
#: Candidates that leave a bucket, above what is asked for, so that rounding in the matrices decides nothing.
SPARE = 3


@cache
def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(TABLES, dim, PROJECTIONS)), rng.uniform(0, STEP, size=(TABLES, PROJECTIONS))


@cache
def perturbations() -> tuple[np.ndarray, np.ndarray]:
    """Steps of every perturbation, and which of the 2 * PROJECTIONS borders it crosses."""
    borders = [(i, s) for i in range(PROJECTIONS) for s in (-1, 1)]
    chosen = [c for r in range(MOVES + 1) for c in combinations(borders, r) if len({i for i, _ in c}) == r]
    steps, crossed = np.zeros((len(chosen), PROJECTIONS), dtype=np.int64), np.zeros((len(chosen), 2 * PROJECTIONS))
    for row, c in enumerate(chosen):
        for i, s in c:
            steps[row, i], crossed[row, 2 * i + (s > 0)] = s, 1
    return steps, crossed


def keys(cells: np.ndarray, table: int, dim: int) -> np.ndarray:
    """One number for the cells (last axis) of a table; an accidental clash only adds candidates."""
    h = np.full(cells.shape[:-1], table, dtype=np.uint64)
    for part in (np.int64(dim), *np.moveaxis(cells, -1, 0)):
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors of each length in a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    out = []
    for d in np.unique(sizes):
        rows = np.nonzero(sizes == d)[0]
        out.append((rows, values[(ends[rows] - d)[:, None] + np.arange(d)]))
    return out


def directions(v: np.ndarray) -> np.ndarray:
    """Unit vectors; dividing by the largest component first keeps squares in range."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def addressed(vectors: DataFrame, probing: bool) -> DataFrame:
    """``at, unit, vec``: the buckets that hold a vector, or those that it visits as a query."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        key, row = [], []
        for rows, v in matrix(batch.column("vec")):
            u = directions(v)
            a, b = projections(v.shape[1])
            steps, crossed = perturbations()
            for t in range(TABLES):
                x = (u @ a[t] + b[t]) / STEP
                cell = np.floor(x).astype(np.int64)
                if probing:
                    low = x - cell
                    cost = np.stack([low ** 2, (1 - low) ** 2], axis=2).reshape(len(u), -1) @ crossed.T
                    order = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
                    key.append(keys(cell[:, None, :] + steps[order], t, v.shape[1]).ravel())
                    row.append(np.repeat(rows, order.shape[1]))
                else:
                    key.append(keys(cell, t, v.shape[1]))
                    row.append(rows)
        if not key:
            return None
        take = pa.array(np.concatenate(row))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), batch.column("unit").take(take), batch.column("vec").take(take)], ["at", "unit", "vec"])

    return map_rows(vectors.select("unit", "vec"), run, f"at long, unit long, vec {vectors.schema['vec'].dataType.simpleString()}")


def met(index: DataFrame, probes: DataFrame, most: int, part_vectors: int = PART_VECTORS, part_queries: int = PART_QUERIES) -> DataFrame:
    """``query, unit``: the ``most`` best of every bucket that a query visits."""
    full = index.groupBy("at").agg(F.count(F.lit(1)).alias("n")).join(probes.groupBy("at").agg(F.count(F.lit(1)).alias("m")), "at")
    parts = full.select(F.col("at").alias("_at"), F.ceil(F.col("n") / part_vectors).cast("int").alias("_v"), F.ceil(F.col("m") / part_queries).cast("int").alias("_q"))
    dealt = materialize(parts.filter("_v > 1 OR _q > 1"), "full-buckets")
    v, q = F.coalesce("_v", F.lit(1)), F.coalesce("_q", F.lit(1))

    def spread(rows: DataFrame, own: Column, other: Column, vector: bool) -> DataFrame:
        mine, all_ = F.pmod(F.xxhash64("unit"), own).cast("int"), F.explode(F.sequence(F.lit(0), other - 1))
        j = rows.join(dealt, F.col("at") == F.col("_at"), "left")
        return j.select("at", F.size("vec").alias("dim"), (mine if vector else all_).alias("vp"), (all_ if vector else mine).alias("qp"), F.lit(vector).alias("is_vector"), "unit", "vec")

    rows = spread(index, v, q, True).unionByName(spread(probes, q, v, False))
    where = ["at", "dim", "vp", "qp"]
    rows = rows.repartition(shuffle_width(index), *where).sortWithinPartitions(*where, "is_vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(most)
        for batch in batches:
            yield from bucket.add(batch)
        yield from bucket.close()

    return rows.mapInArrow(run, "query long, unit long, score double")


class Bucket:
    """The queries of the bucket that is read just now, and their best so far; vectors stream past."""

    def __init__(self, most: int):
        self.most, self.where = most, None
        self.clear()

    def clear(self) -> None:
        self.query, self.q = np.zeros(0, dtype=np.int64), None
        self.score, self.unit = np.zeros((0, self.most)), np.zeros((0, self.most), dtype=np.int64)

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        where = np.stack([batch.column(i).to_numpy() for i in range(4)] + [batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
        first = np.r_[0, np.nonzero((where[1:] != where[:-1]).any(axis=1))[0] + 1, len(where)]
        unit = batch.column("unit").to_numpy()
        for a, b in zip(first[:-1], first[1:]):
            if self.where != tuple(where[a, :4]):
                yield from self.close()
                self.where = tuple(where[a, :4])
            if where[a, 4] and not len(self.query):
                continue
            for rows, v in matrix(batch.column("vec").slice(a, b - a)):
                u = directions(v)
                if not where[a, 4]:
                    self.query = np.r_[self.query, unit[a + rows]]
                    self.q = u if self.q is None else np.concatenate([self.q, u])
                    more = len(self.query) - len(self.score)
                    self.score = np.concatenate([self.score, np.full((more, self.most), -np.inf)])
                    self.unit = np.concatenate([self.unit, np.full((more, self.most), -1)])
                else:
                    for at in range(0, len(u), 2048):
                        self.meet(u[at:at + 2048], unit[a + rows[at:at + 2048]])

    def meet(self, u: np.ndarray, unit: np.ndarray) -> None:
        score = np.concatenate([self.score, self.q @ u.T], axis=1)
        names = np.concatenate([self.unit, np.broadcast_to(unit, (len(self.query), len(unit)))], axis=1)
        rough = -np.round(score, 12)  # what differs by rounding only is a tie, and goes to the smaller unit
        best = np.argpartition(rough, self.most - 1, axis=1)[:, : self.most]
        edge = np.take_along_axis(rough, best, axis=1).max(axis=1, keepdims=True)
        for row in np.nonzero(((rough <= edge).sum(axis=1) > self.most) & (edge[:, 0] < np.inf))[0]:
            best[row] = np.lexsort((names[row], rough[row]))[: self.most]
        self.score, self.unit = np.take_along_axis(score, best, axis=1), np.take_along_axis(names, best, axis=1)

    def close(self) -> Iterator[pa.RecordBatch]:
        there = self.unit >= 0
        if there.any():
            query = np.broadcast_to(self.query[:, None], there.shape)[there]
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(self.unit[there]), pa.array(self.score[there])], ["query", "unit", "score"])
        self.clear()


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``vec_id, embedding``.

    Equal vectors are one unit, numbered by its smallest identifier, so that repeats cost nothing; a unit keeps one
    identifier more than is asked for, because a query may not find itself. Null, empty and zero vectors,
    those with null or non-finite components and rows without identifier take no part; vectors of other
    lengths are no candidates. Rows repeating an identifier are candidates for others, never for it. Ties go
    to the smaller identifier. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).distinct()
    alike = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= nearest + 1)
    units = materialize(few.groupBy("vec").agg(F.min("vec_id").alias("first"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "alike")
    units = materialize(numbered(units, [F.col("first"), F.xxhash64("vec")], "unit").select("vec", "ids", "unit"), "units")
    asking = rows.filter("asks").select("vec_id", "vec").join(units.select("vec", "unit"), "vec").select(F.col("vec_id").alias("query_id"), "unit")
    asking = materialize(asking, "queries")
    queries = units.join(asking.select("unit").distinct(), "unit", "left_semi")
    found = met(materialize(addressed(units, False), "index"), materialize(addressed(queries, True), "probes"), nearest + 1 + SPARE)
    found = found.groupBy("query", "unit").agg(F.max("score").alias("near"))
    best = Window.partitionBy("query").orderBy(F.desc(F.round("near", 12)), "unit")
    short = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= nearest + 1 + SPARE).select("query", "unit")
    pairs = short.join(units.select("unit", "ids", F.col("vec").alias("b")), "unit").join(units.select(F.col("unit").alias("query"), F.col("vec").alias("a")), "query")
    scored = map_rows(pairs.select("query", "ids", "a", "b"), exact, "query long, ids array<long>, score double")
    each = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    front = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    each = materialize(each.withColumn("nth", F.row_number().over(front)).filter(F.col("nth") <= nearest + 1).drop("nth"), "candidates")
    j = asking.join(each, asking["unit"] == each["query"]).filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return j.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Cosine in double precision; vectors are scaled by their largest component first, so no square overflows."""
    score = np.empty(batch.num_rows)
    for (rows, a), (_, b) in zip(matrix(batch.column("a")), matrix(batch.column("b"))):
        a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
        norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
        score[rows] = (a * b).sum(axis=1) / norms
    return pa.RecordBatch.from_arrays([batch.column("query"), batch.column("ids"), pa.array(score)], ["query", "ids", "score"])


def nearest_vectors(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0)

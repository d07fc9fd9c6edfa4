"""Centroid clustering on bit planes.

A vector's components become integers in two's complement. Bit ``p`` of all 64 components is one unsigned 64-bit
word, its plane ``p``, and a vector is stored as its few planes. As a number is the sum of its bits by their
weights (the highest one negative), a dot product is the sum over pairs of planes of both weights times the
number of set bits in the AND of the two words. Norms and squared distances follow from dot products, all of
them exact integers. Column sums of a cluster are weighted counts of bits as well.

Vectors never leave their tasks: a round sends one row of 64 sums for each task and centroid, and the driver
holds as many rows as there are centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import map_rows
from pagelens.session import materialize

#: Components of a vector, one for each bit of a word.
COMPONENTS = 64
CENTROIDS, ROUNDS, SEED = 40, 5, "2"
#: A component ``x`` counts as ``floor(SCALE * x)``.
SCALE = 256
#: Integers lie within ``-LIMIT`` and ``LIMIT - 1``, so that every squared distance fits a long.
LIMIT = 1 << 27
#: Rows compared at a time with all centroids.
BLOCK = 2048


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LIMIT, LIMIT - 1).astype(np.int64)


def widths(ints: np.ndarray) -> np.ndarray:
    """Bits that each row needs in two's complement: the sign, and the largest magnitude's bits."""
    most = np.where(ints < 0, ~ints, ints).max(axis=1, initial=0)
    return np.frexp(most.astype(np.float64))[1].astype(np.int64) + 1


def planes(ints: np.ndarray) -> np.ndarray:
    """One row of words for each plane, one column for each vector."""
    width = int(widths(ints).max(initial=1))
    bits = [np.packbits((ints >> p & 1).astype(np.uint8), axis=1) for p in range(width)]
    return np.stack([np.ascontiguousarray(b).view(np.uint64)[:, 0] for b in bits])


def weights(width: int) -> np.ndarray:
    w = np.left_shift(1, np.arange(width, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of every vector of ``x`` with every one of ``y``, both given as planes."""
    total = np.zeros((x.shape[1], y.shape[1]), dtype=np.int64)
    for p, a in zip(weights(len(x)), x):
        for q, b in zip(weights(len(y)), y):
            total += np.bitwise_count(a[:, None] & b[None, :]).astype(np.int64) * (p * q)
    return total


def norms(x: np.ndarray) -> np.ndarray:
    """Squared lengths."""
    total = np.zeros(x.shape[1], dtype=np.int64)
    for p, a in zip(weights(len(x)), x):
        for q, b in zip(weights(len(x)), x):
            total += np.bitwise_count(a & b).astype(np.int64) * (p * q)
    return total


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number on ties, and its squared distance."""
    y = planes(centroids)
    own = norms(y)
    cluster, distance = np.zeros(x.shape[1], dtype=np.int64), np.zeros(x.shape[1], dtype=np.int64)
    for at in range(0, x.shape[1], BLOCK):
        part = x[:, at:at + BLOCK]
        far = norms(part)[:, None] - 2 * dots(part, y) + own[None, :]
        cluster[at:at + BLOCK] = far.argmin(axis=1)
        distance[at:at + BLOCK] = far.min(axis=1)
    return cluster, distance


def column_sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of each cluster: set bits of a plane, counted by position, times the plane's weight."""
    total = np.zeros((k, COMPONENTS), dtype=np.int64)
    order = np.argsort(cluster, kind="stable")
    found, first = np.unique(cluster[order], return_index=True)
    for w, plane in zip(weights(len(x)), x):
        bits = np.unpackbits(plane[order].view(np.uint8).reshape(-1, 8), axis=1)
        total[found] += np.add.reduceat(bits, first, axis=0, dtype=np.int64) * w
    return total


# rows

def whole(vec: Column) -> Column:
    """Exactly 64 components, none null, NaN or infinite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == COMPONENTS) & fine, F.lit(False))


def packed_planes(kept: DataFrame) -> DataFrame:
    """``vec_id, planes`` from ``vec_id, vec``; as many words as the vector needs, lowest plane first."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        ints = integers(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS))
        words, need = planes(ints), widths(ints)
        mine = np.arange(len(words))[None, :] < need[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(need)], type=pa.int32()), pa.array(words.T[mine].view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "planes"])

    return map_rows(kept, run, "vec_id long, planes array<long>")


def unpacked(column: pa.Array) -> np.ndarray:
    """Planes of a batch at one width: beyond its own planes a number repeats its sign."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    first = np.cumsum(sizes) - sizes
    return words[first + np.minimum(np.arange(sizes.max())[:, None], sizes - 1)]


def summed(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, n, s0 .. s63``: one row for each task and centroid that has vectors there."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, COMPONENTS), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch.column("planes"))
                cluster, _ = nearest(x, centroids)
                n += np.bincount(cluster, minlength=k)
                total += column_sums(x, cluster, k)
        have = np.nonzero(n)[0]
        if len(have):
            yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(n[have]), *[pa.array(c) for c in total[have].T]], names)

    names = ["cluster", "n", *[f"s{i}" for i in range(COMPONENTS)]]
    return table.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def starts(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The first ``k`` vectors by the hash of their identifiers; bounded by ``k`` rows on the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.filter(F.col("vec_id").isNotNull()).select("vec", h.alias("h")).orderBy("h", "vec").limit(k).collect()
    return integers(np.array([r["vec"] for r in rows], dtype=np.float64).reshape(-1, COMPONENTS))


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector kept, and the final centroids.

    Only vectors of exactly 64 components take part, none of them null or not finite; all others are left out. Equal
    rows count each for itself. A null identifier has no hash, so its vector starts no centroid but is assigned.
    Vectors that share an identifier start centroids in the order of their components. With fewer than ``k``
    vectors each starts a centroid; if no vector has an identifier, or the table is empty, the result is empty.
    Integers beyond 2**27 (components beyond 524 288) count as that limit. Other columns are not read.
    """
    vec = F.col("embedding").cast("array<double>").alias("vec")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec).filter(whole(F.col("vec")))
    centroids = starts(kept, k, seed)
    table = materialize(packed_planes(kept if len(centroids) else kept.limit(0)), "planes")
    for _ in range(rounds if len(centroids) else 0):
        parts = summed(table, centroids).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(COMPONENTS)])])
        for cluster, n, *total in parts.collect():  # at most k rows
            centroids[cluster] = [s // n for s in total]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        cluster, distance = nearest(unpacked(batch.column("planes")), centroids)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return map_rows(table, run, "vec_id long, cluster int, distance long"), centroids


def cluster_report(vectors: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that :func:`clustered` keeps.

    Nulls, short, long and repeated vectors, ties, empty tables and further columns are treated as stated there. Inertias
    beyond a long stay at its largest value.
    """
    labels, centroids = clustered(vectors)
    labels = materialize(labels, "clusters")
    most = (1 << 63) - 1
    sums = dict(labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect())  # at most k rows
    inertia = min(most, sum(map(int, sums.values())))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(c, min(most, int(s)), inertia, digest[c]) for c, s in sorted(sums.items())]
    facts = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = labels.join(F.broadcast(facts), "cluster")  # one row for each centroid
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same rows in DuckDB, every round written out; doubles hold these integers exactly."""

    def assigned(i: int) -> str:
        return f"""d{i} AS (SELECT r, vec_id, q, cluster, CAST(list_dot_product(q, q) - 2 * list_dot_product(q, c) + list_dot_product(c, c) AS BIGINT) AS d FROM kept, c{i}),
a{i} AS (SELECT r, arg_min(vec_id, d * {k} + cluster) AS vec_id, arg_min(q, d * {k} + cluster) AS q, arg_min(cluster, d * {k} + cluster) AS cluster, min(d) AS d FROM d{i} GROUP BY r)"""

    def moved(i: int) -> str:
        return f"""u{i} AS (SELECT cluster, unnest(q) AS v, unnest(range({COMPONENTS})) AS j FROM a{i}),
m{i} AS (SELECT cluster, j, CAST(floor(sum(v) / count(*)) AS DOUBLE) AS v FROM u{i} GROUP BY cluster, j),
n{i} AS (SELECT cluster, list(v ORDER BY j) AS c FROM m{i} GROUP BY cluster),
c{i + 1} AS (SELECT cluster, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (cluster))"""

    steps = ",\n".join(f"{assigned(i)},\n{moved(i)}" for i in range(rounds))
    return f"""WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) - 1 AS cluster, q AS c FROM kept WHERE vec_id IS NOT NULL
  ORDER BY cluster LIMIT {k}),
{steps},
{assigned(rounds)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""

"""Bit-plane clustering against plain integer arithmetic."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import bitplanes
from pagelens.session import fresh_path


def plain(rows, k=40, rounds=5, seed="2"):
    """rows: vec_id, list; returns the report's rows."""
    kept = [(i, [float(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    ints = [[int(max(-(2 ** 27), min(2 ** 27 - 1, np.floor(256 * x)))) for x in v] for _, v in kept]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, n) for n, (i, v) in enumerate(kept) if i is not None)
    centroids = [ints[n] for _, _, n in order[:k]]
    if not centroids:
        return []

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in ints]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        where = assign()
        for c in range(len(centroids)):
            mine = [v for v, (w, _) in zip(ints, where) if w == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    where = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = [sum(d for w, d in where if w == c) for c in range(len(centroids))]
    return sorted([(i, w, d, inertia[w], sum(inertia), digest[w]) for (i, _), (w, d) in zip(kept, where)], key=repr)


def got(df):
    return sorted(map(tuple, bitplanes.cluster_report(df).collect()), key=repr)


@pytest.mark.parametrize(("low", "high"), [(-1, 1), (0, 1), (-300, 500), (-(2 ** 27), 2 ** 27 - 1), (-4, -3)])
def test_dot_products_of_planes(low, high):
    rng = np.random.default_rng(0)
    x, y = rng.integers(low, high, (50, 64), endpoint=True), rng.integers(-260, 260, (7, 64))
    a, b = bitplanes.planes(x), bitplanes.planes(y)
    assert (bitplanes.dots(a, b) == x @ y.T).all() and (bitplanes.norms(a) == (x * x).sum(axis=1)).all()
    cluster, distance = bitplanes.nearest(a, y)
    far = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    assert (cluster == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    sums = bitplanes.column_sums(a, cluster, 7)
    assert all((sums[c] == x[cluster == c].sum(axis=0)).all() for c in range(7))


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).round(3).tolist()) for i in range(90)]
    rows += [(1, rows[1][1]), (2, rows[3][1]), (None, rows[4][1]), (None, rows[4][1])]  # repeats, two vectors of one identifier
    rows += [(200, [0.0] * 64), (201, [-0.0] * 64), (202, [1e300] * 64), (203, [-5e5] * 63 + [1e-300])]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] + [1.0] * 63), (306, [float("-inf")] + [1.0] * 63)]
    return rows


def test_report_equals_plain_clustering(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    df = df.select("*", *[F.lit("own").alias(c) for c in ("cluster", "distance", "planes", "vec", "n", "s0", "inertia", "label")])
    assert got(df) == plain(rows)


def test_few_many_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([(5, [0.5] * 64)], [(i, [float(i % 3)] * 64) for i in range(300)], [(i, [0.25] * 64) for i in range(50)], [(None, [0.5] * 64)], []):
        assert got(spark.createDataFrame(rows, schema)) == plain(rows)


def test_rows_of_a_file_equal_plain_clustering(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]
    assert got(vectors) == plain(rows)


def test_another_number_of_centroids_and_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) * 0.1 + i % 3).tolist()) for i in range(120)]
    path = fresh_path(spark, "vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(path)
    labels, centroids = bitplanes.clustered(spark.read.parquet(path), k=6, rounds=9, seed="x")
    want = plain(rows, 6, 9, "x")
    assert sorted(map(tuple, labels.collect())) == sorted(r[:3] for r in want) and len(centroids) == 6

"""Connected components of edge tables keyed by page."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators.grouping import split_hot
from pagelens.session import materialize, page_tasks


EDGE_LIMIT = 200_000


def tasks(df: DataFrame) -> int:
    """Tasks of a Python stage: the configured shuffle width, which adaptive merging by bytes would undercut, or more for many pages."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (page_tasks(df.sparkSession) or 0) // 4)


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], limit: int = EDGE_LIMIT) -> DataFrame:
    """Smallest node id reachable from each node: ``keys, node, label``.

    ``nodes`` has ``keys, node``; ``edges`` has ``keys, a, b``. Groups of up to ``limit`` edges are
    labelled inside Arrow batches of whole groups; a larger group goes through distributed star contraction.
    """
    keys = list(keys)
    e = materialize(
        edges.filter("a <> b").select(*keys, F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    cold, hot = split_hot(e, keys, limit)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.select(*keys).schema.fields)
    low = map_groups(cold, keys, lambda pdf, code: _label_edges(pdf, code, keys), f"{fields}, node bigint, label bigint")
    if hot is not None:
        low = low.unionByName(_contract(hot, keys))
    return nodes.join(materialize(low, "labels"), [*keys, "node"], "left").withColumn("label", F.coalesce("label", "node"))


def map_groups(df: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    """``fn(pdf, code)`` over batches of whole groups; ``code`` numbers the groups of a batch.

    Rows arrive sorted by group, so a batch only has to hold back its last, possibly unfinished
    group. Many small groups share one call, where a grouped map would pay per group.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            same = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = 0 if same.all() else len(pdf) - int(np.argmin(same[::-1]))
            if cut:
                yield call(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield call(pd.concat(held, ignore_index=True))

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        step = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        return fn(pdf, np.cumsum(step).astype(np.int64) - 1)

    return df.repartition(tasks(df), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest reachable index per index, by hooking roots and pointer jumping."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def _label_edges(pdf: pd.DataFrame, code: np.ndarray, keys: list[str]) -> pd.DataFrame:
    ends = np.concatenate([pdf["hi"].to_numpy(), pdf["lo"].to_numpy()])
    names, at = np.unique(ends, return_inverse=True)
    spot, first, node = np.unique(np.concatenate([code, code]) * len(names) + at, return_index=True, return_inverse=True)
    lab = min_labels(len(spot), node[: len(pdf)], node[len(pdf):])
    out = pdf[keys].iloc[first % len(pdf)].reset_index(drop=True)
    return out.assign(node=ends[first], label=ends[first][lab])


def _contract(e: DataFrame, keys: list[str]) -> DataFrame:
    """Alternating large-star and small-star steps.

    Every step only moves edges towards the smallest neighbour seen, keeps at most one row per
    edge and aggregates before it shuffles, so neither long chains nor one huge component collect
    in a single task. Each round is cut through a written table.
    """
    mark = None
    while True:
        e = materialize(_small_star(_large_star(e, keys), keys), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.groupBy(*keys, F.col("hi").alias("node")).agg(F.min("lo").alias("label"))


def _large_star(e: DataFrame, keys: list[str]) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = e.select(*keys, F.explode(F.array(
        F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )).alias("p")).select(*keys, "p.u", "p.v")
    low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.filter("v > u").join(low, [*keys, "u"])
        .select(*keys, F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    )


def _small_star(e: DataFrame, keys: list[str]) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    low = e.groupBy(*keys, "hi").agg(F.min("lo").alias("m"))
    j = e.join(low, [*keys, "hi"])
    return j.select(*keys, F.explode(F.array(
        F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo"))
    )).alias("p")).select(*keys, "p.hi", "p.lo").filter("hi <> lo").distinct()

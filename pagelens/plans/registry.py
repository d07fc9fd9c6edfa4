"""Registration of queries next to their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelens.plans.corpus import Corpus, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(corpus)`` as ``name``; ``sql`` runs on DuckDB over the space-separated ``views``."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Corpus(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, *views.split())
        return fn

    return wrap

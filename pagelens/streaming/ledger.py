"""Ledger rules on a stream of notes and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators.ledger import TRANSIENT


def note_rate(notes: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Errors and warnings per tag in tumbling (or sliding) windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return notes.withWatermark("ts", late).groupBy(w.alias("w"), "tag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warns")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tag", "n", "errors", "warns")


def retry_sessions(attempts: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """One row per retry ladder: a call's attempts with no pause of ``gap``, judged when it closes."""
    ends = (F.col("code") == 200) | ~F.col("code").isin(*TRANSIENT)
    first = F.min(F.when(ends, F.struct("attempt", "code"))).alias("first")
    s = attempts.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "call_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(~ends).alias("failures"), first)
    return s.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "call_id", "attempts", "failures",
        F.when(F.col("first").isNull(), "exhausted").when(F.col("first.code") == 200, "success").otherwise("fatal").alias("outcome"))


def dedup_notes(notes: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each distinct message once within the watermark."""
    return notes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["level", "tag", "msg"])

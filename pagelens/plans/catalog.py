"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import boxes, ledger, ordering, texts
from pagelens.plans import box_queries, ledger_queries, raster_queries, stream_queries, text_queries  # noqa: F401
from pagelens.plans.corpus import Corpus
from pagelens.session import materialize


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Detections to page reports: clip, suppress, merge, assign, split, order, label, count.

    The order is contract: duplicates merge before parents are assigned, labels exist before
    anything is counted.
    """
    c = Corpus(spark, folder)
    clipped = boxes.clip_boxes(c.det, c.frames)
    kept = boxes.truncate_boxes(boxes.suppress(clipped))
    kept = materialize(kept, "kept")
    merged = boxes.merge_nested(kept.filter("cls <> 0"))
    parents = kept.filter("cls = 0").withColumn("ord", F.struct(-F.col("score"), F.col("det_id")))
    assigned = ordering.split_shared_parents(materialize(boxes.assign_parents(merged, parents), "assigned"))
    placed = ordering.reading_order(materialize(assigned, "placed"))
    spoken = F.concat(F.lit("ドキ"), F.when(F.col("score") % 3 == 0, "っ").when(F.col("score") % 3 == 1, "ドキ").otherwise("は漢"))
    labelled = texts.label_regions(placed.select(
        "page_id", F.col("det_id").alias("region_id"), "idx", spoken.alias("src_text"), F.col("parent_x1").isNotNull().alias("in_parent"),
        F.when(F.col("score") % 4 != 0, "ok").alias("translation"), (F.col("score") % 29 == 0).alias("residue"),
        (F.col("score") % 23 == 0).alias("overflowed"), F.when(F.col("score") % 4 == 0, "lama").otherwise("flat").alias("route")))
    return ledger.page_table(ledger.page_counts(labelled, c.ledger))

"""Page completion and incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelens.operators.boxes import assign_parents, merge_nested, suppress
from pagelens.operators.ordering import reading_order, split_shared_parents
from pagelens.session import materialize, written

OUT = "page_id bigint, kind string, region_id bigint, n bigint"
STATE = "announced binary, answered binary, closed boolean"


def page_completion(events: DataFrame, wait_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """Follow pages until every announced region has an answer.

    ``events`` has ``page_id, region_id, kind (region|answer), text, ts``. Emits ``complete`` once
    per page, ``repair`` per unanswered region after ``wait_ms`` of event time, and ``late`` for
    answers after either. The state of an open page is eight bytes for each of its ids, that of a
    closed one is empty and goes ``wait_ms`` later; answers to a page that is no longer known wait
    for an announcement that long and are then ``late`` as well.
    """

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        announced, answered, closed = state.get if state.exists else (b"", b"", False)
        announced, answered = np.frombuffer(announced, dtype=np.int64), np.frombuffer(answered, dtype=np.int64)
        said, count, ids, again = "", [], np.zeros(0, dtype=np.int64), True
        if state.hasTimedOut:
            if not closed:
                said, ids = ("repair", np.setdiff1d(announced, answered)) if len(announced) else ("late", answered)
            again, closed = not closed and len(announced) > 0, True
            newest = state.getCurrentWatermarkMs()
        else:
            new, now, newest = [], [], state.getCurrentWatermarkMs()
            for pdf in batches:
                region = (pdf["kind"] == "region").to_numpy()
                good = ~region & pdf["text"].fillna("").str.strip().ne("").to_numpy()
                new.append(pdf["region_id"].to_numpy()[region])
                now.append(pdf["region_id"].to_numpy()[good])
                newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
            new, now = (np.concatenate(x).astype(np.int64) for x in (new, now))
            if closed:
                said, ids = "late", now
            else:
                announced, answered = np.union1d(announced, new), np.union1d(answered, now)
                if len(announced) and np.isin(announced, answered).all():
                    said, count, closed = "complete", [len(announced)], True
        if again:
            keep = (b"", b"") if closed else (announced.tobytes(), answered.tobytes())
            state.update((*keep, closed))
            state.setTimeoutTimestamp(newest + wait_ms)
        else:
            state.remove()
        n = count or [1] * len(ids)
        region = pd.array([None] * len(count) or ids, dtype="Int64")
        yield pd.DataFrame({"page_id": key[0], "kind": said, "region_id": region, "n": np.array(n, dtype=np.int64)})

    return events.withWatermark("ts", late).groupBy("page_id").applyInPandasWithState(follow, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def ingest(boxes: DataFrame, raw_path: str, out_path: str, progress: str, buckets: int = 64):
    """Keep ordered regions up to date with arriving detections.

    Every batch lands in its own folder of the raw table (a repeated batch replaces itself). The pages
    it touched are recomputed from all their boxes; other pages of the same buckets are carried over, and
    only the partitions of those buckets are overwritten.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        folder = f"{raw_path}/batch_id={batch_id}"
        batch.withColumn("bucket", F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        pages = written(spark.read.parquet(folder).select("bucket", "page_id").distinct(), "touched")
        touched = F.broadcast(pages.select("bucket").distinct())  # at most ``buckets`` rows
        known = spark.read.option("basePath", raw_path).parquet(raw_path).filter(F.col("batch_id") <= batch_id)
        det = known.join(touched, "bucket", "left_semi").join(pages.select("page_id"), "page_id", "left_semi").drop("batch_id")
        kept = written(suppress(det), "kept")
        parents = kept.filter("cls = 0").withColumn("ord", F.struct(-F.col("score"), F.col("det_id")))
        out = reading_order(split_shared_parents(assign_parents(merge_nested(kept.filter("cls <> 0")), parents)))
        out = materialize(out, "ordered")
        if batch_id:
            old = spark.read.schema(out.schema).parquet(out_path).join(touched, "bucket", "left_semi")
            out = materialize(out.unionByName(old.join(pages.select("page_id"), "page_id", "left_anti").select(*out.columns)), "merged")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out_path)

    return boxes.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start()

"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pagelens.plans import catalog
from pagelens.plans.registry import QUERIES
from pagelens.session import local_session, release

HEADLINE = (
    "suppress merge_nested assign_parents reading_order box_pairs overlap_groups split_parents label_regions clean_answer "
    "text_metrics wrap page_report batch_summary diagnose attempt_outcomes sweep otsu components dilate background_stats "
    "mask_intersect residue leakage disjoin nearest glyph_lines incremental_ingest seed_grow clean_audit compose_masks"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus, "bench", partitions=2 * int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name, fn in [("flagship", catalog.flagship), *[(n, QUERIES[n]) for n in names]]:
        t0 = time.time()
        fn(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
        release(spark)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

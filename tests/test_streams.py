"""Page completion over several micro-batches."""

from datetime import datetime, timedelta

from pagelens.session import fresh_path, release
from pagelens.streaming.pages import page_completion
from pagelens.streaming.sinks import drain, read_stream

SCHEMA = "page_id bigint, region_id bigint, kind string, text string, ts timestamp"


def run(spark, batches):
    start, folder = datetime(2024, 1, 1), fresh_path(spark, "events")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(p, r, k, t, start + timedelta(minutes=m)) for p, r, k, t, m in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    stream = read_stream(spark, folder + "/*", spark.read.parquet(folder + "/000").schema, files_per_batch=1)
    return sorted(((r.page_id, r.kind, r.region_id, r.n) for r in drain(page_completion(stream)).collect()), key=repr)


def test_a_page_of_any_size_completes_once(spark):
    tell, answer = [(1, i, "region", None, 0) for i in range(1500)], [(1, i, "answer", "x", 1) for i in range(1500)]
    assert run(spark, [tell, answer[:700], answer[700:], answer[:2]]) == [(1, "complete", None, 1500), (1, "late", 0, 1), (1, "late", 1, 1)]


def test_repair_and_answers_after_closing(spark):
    batches = [
        [(1, 1, "region", None, 0), (1, 2, "region", None, 0), (1, 1, "answer", "x", 0), (1, 2, "answer", "  ", 0)],
        [(2, 1, "answer", "x", 120)], [(2, 2, "answer", "x", 121)], [(1, 2, "answer", "x", 122)], [(9, 1, "region", None, 600)], [(9, 1, "answer", "x", 601)],
    ]
    got = run(spark, batches)
    assert [x for x in got if x[0] == 9] == [(9, "complete", None, 1)]
    assert (1, "repair", 2, 1) in got and (1, "late", 2, 1) in got and len([x for x in got if x[0] == 1]) == 2
    assert [x for x in got if x[0] == 2] == [(2, "late", 1, 1), (2, "late", 2, 1)]


def test_written_tables_can_be_deleted(spark):
    path = fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert release(spark) > 0 and not spark._jvm.java.io.File(path).exists()

"""The plans of page queries follow the size of what they make, not of the files they read."""

from pyspark.sql import functions as F

from pagelens.operators import raster as P
from pagelens.operators import runs as R
from pagelens.operators import tones as T
from pagelens.plans import corpus
from pagelens.plans.corpus import Corpus
from pagelens.session import measured_joins, size_in_bytes

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_never_broadcast_by_the_size_of_their_file(spark):
    c = Corpus(spark, DATA)
    pixels = c.rgb.join(c.fill.groupBy("page_id", "y", "x").agg(F.max("region_id").alias("last")), ["page_id", "y", "x"], "left")
    assert "Broadcast" not in plan(pixels)


def test_sides_of_a_few_megabytes_are_not_sent_to_the_driver(spark):
    known = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        measured_joins(spark)
        for rows, sent in ((100_000, False), (1_000, True)):  # 2.4 MB and 24 kB of rows
            side = spark.range(rows).selectExpr("id * 3 AS k").groupBy("k").agg(F.count("*").alias("n"))
            joined = spark.range(1_000_000).withColumnRenamed("id", "k").join(side, "k")
            assert len(joined.collect()) == -(-min(3 * rows, 1_000_000) // 3)
            assert ("BroadcastHashJoin" in plan(joined).split("== Initial Plan ==")[0]) == sent
        assert [size_in_bytes(t) for t in ("10485760b", "256k", "10MB", "7", "-1")] == [10 << 20, 256 << 10, 10 << 20, 7, -1]
    finally:
        for k, v in known.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_more_pages_make_more_tasks_and_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PAGES_A_TASK", 2)
    c = Corpus(spark, DATA)
    pages = c.pages.count()
    parts = c.pix.groupBy(F.spark_partition_id()).agg(F.count_distinct("page_id").alias("n")).collect()
    assert c.pix.rdd.getNumPartitions() == -(-pages // 2) > spark.sparkContext.defaultParallelism
    assert sum(r.n for r in parts) == pages and len(parts) > pages // 4


def test_rasters_dealt_by_page_are_joined_where_they_are(spark):
    c = Corpus(spark, DATA)
    both = plan(c.pix.join(c.after.withColumnRenamed("grey", "grey2"), ["page_id", "y", "x"]))
    assert both.count("Exchange") == both.count("REPARTITION_BY_NUM")


def test_more_turns_make_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(corpus, "TURNS_A_TASK", 10)
    c = Corpus(spark, DATA)
    assert c.conversations.rdd.getNumPartitions() == -(-c.conversations.count() // 10)


def test_runs_are_shuffled_before_they_grow(spark):
    runs = spark.createDataFrame([(1, 0, 5, 3, 9), (1, 0, 6, 20, 21)], "page_id long, region_id int, y int, x0 int, x1 int")
    for made in (R.ring(runs, 9), R.dilate(runs, 9), R.dilate_times(runs, 5), R.subtract(runs, R.grow(runs, 5))):
        text = plan(made)
        assert text.count("Exchange") == 1 and "Generate" not in text[text.index("Exchange"):]


def test_regions_meet_pixels_in_the_tasks_that_hold_them(spark):
    c = Corpus(spark, DATA)
    grid = plan(c.lines("rgb"))
    assert grid.count("Exchange") == grid.count("REPARTITION_BY_NUM") == 1
    boxes = R.box_runs(c.crops.filter("region_id = 2"))
    tones = plan(T.tones(P.values(boxes, c.lines("rgb")), R.RK, "rgb"))
    assert tones.count("Exchange") == 2  # the grid, and the runs that come to it


def test_masks_become_runs_branch_by_branch(spark):
    c = Corpus(spark, DATA)
    for name in ("ink", "interior", "fill"):
        runs = R.to_runs(getattr(c, name))
        want = sorted(map(tuple, runs.collect()))
        assert sorted(map(tuple, c.runs(name).select(*runs.columns).collect())) == want
        assert sorted(map(tuple, c.runs(name, 0).select(*runs.columns).collect())) == [r for r in want if r[1] == 0]

"""Streaming queries: drained to a table and compared with the batch rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.plans.box_queries import MERGE_SQL, SUPPRESS_SQL, order_sql
from pagelens.plans.corpus import VIEWS
from pagelens.plans.registry import query
from pagelens.session import fresh_path
from pagelens.streaming import ledger as L
from pagelens.streaming import pages as P
from pagelens.streaming.sinks import drain, read_stream

CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def event_stream(c):
    """The event file as a stream, with event time in the session's zone."""
    s = read_stream(c.spark, c.folder, c.events.schema, "events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_view(c, name: str):
    """A derived view of ``events`` over the event stream."""
    s = event_stream(c)
    return c.spark.sql(VIEWS[name].replace("{string}", "STRING"), events=s)


def rate_sql(starts: str) -> str:
    return f"""
WITH w AS (SELECT *, unnest({starts}) AS s FROM ledger)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS "start", strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end", tag, count(*) AS n, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warns
FROM w GROUP BY s, tag HAVING s + INTERVAL 1 HOUR <= {CLOSED}"""


@query("note_rate", rate_sql("[date_trunc('hour', ts)]"), "ledger")
def _(c):
    return drain(L.note_rate(stream_view(c, "ledger"))).select(stamp("start"), stamp("end"), "tag", "n", "errors", "warns")


HALF = "time_bucket(INTERVAL 30 MINUTE, ts)"


@query("note_rate_sliding", rate_sql(f"[{HALF}, {HALF} - INTERVAL 30 MINUTE]"), "ledger")
def _(c):
    return drain(L.note_rate(stream_view(c, "ledger"), slide="30 minutes")).select(stamp("start"), stamp("end"), "tag", "n", "errors", "warns")


@query("retry_sessions", f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM attempts WINDOW w AS (PARTITION BY call_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY call_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS "start", strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS "end", call_id, count(*) AS attempts, count(*) FILTER (code IN (429, 502)) AS failures,
  CASE arg_min(code, attempt) FILTER (code IN (200, 402)) WHEN 200 THEN 'success' WHEN 402 THEN 'fatal' ELSE 'exhausted' END AS outcome
FROM s GROUP BY call_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""", "attempts")
def _(c):
    return drain(L.retry_sessions(stream_view(c, "attempts"))).select(stamp("start"), stamp("end"), "call_id", "attempts", "failures", "outcome")


@query("dedup_notes", "SELECT DISTINCT level, tag, msg FROM ledger", "ledger")
def _(c):
    return drain(L.dedup_notes(stream_view(c, "ledger"))).select("level", "tag", "msg")


# Notes arrive in six slices of time; every seventh is held back by a slice, every thirty-fifth by two.
ARRIVAL = "CAST(FLOOR((us - lo) * 6e0 / (hi - lo + 1)) AS INT) + CASE WHEN seq % 35 = 0 THEN 2 WHEN seq % 7 = 0 THEN 1 ELSE 0 END"
BATCHES = 8

# The stream's rule replayed batch by batch: the watermark lies two hours behind the latest note of earlier batches. What is not later than
# the watermark of the batch before is dropped; a message is known until two hours after the note that told it, as far as the watermark goes.
LATE = f"""
WITH n AS (SELECT *, epoch_us(ts) AS us FROM ledger),
a AS (SELECT n.*, {ARRIVAL} AS b FROM n, (SELECT min(us) AS lo, max(us) AS hi FROM n)),
mark AS (SELECT k, coalesce((SELECT max(us) // 1000 * 1000 FROM a WHERE b < k) - 7200000000, 0) AS w FROM (SELECT unnest(range(-1, {BATCHES + 1})) AS k)),
intime AS (SELECT a.* FROM a JOIN mark ON mark.k = a.b - 1 WHERE us > greatest(w, 0)),
f AS (SELECT b, level, tag, msg, min(seq) AS seq, arg_min(us, seq) AS us FROM intime GROUP BY ALL),
st(k, level, tag, msg, told, until) AS (
  SELECT -1, level, tag, msg, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT level, tag, msg FROM ledger)
  UNION ALL
  SELECT k, level, tag, msg, CASE WHEN until IS NULL THEN seq END, CASE WHEN coalesce(until, us + 7200000000) > w THEN coalesce(until, us + 7200000000) END
  FROM (SELECT st.k + 1 AS k, st.level, st.tag, st.msg, st.until, f.seq, f.us, mark.w FROM st JOIN mark ON mark.k = st.k + 1
    LEFT JOIN f ON f.b = st.k + 1 AND f.level = st.level AND f.tag = st.tag AND f.msg = st.msg WHERE st.k < {BATCHES - 1}))
SELECT told AS seq, level, tag, msg FROM st WHERE told IS NOT NULL"""


def in_batches(c):
    """The ledger as files that come one after the other."""
    n = c.ledger.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))
    ends = n.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    folder = fresh_path(c.spark, "notes")
    dealt = n.join(F.broadcast(ends)).withColumn("b", F.expr(ARRIVAL)).select("seq", "ts", "level", "tag", "msg", "b")
    for b in range(BATCHES):
        dealt.filter(F.col("b") == b).drop("b").coalesce(1).sortWithinPartitions("seq").write.parquet(f"{folder}/{b:02d}")
    return read_stream(c.spark, folder + "/*", dealt.drop("b").schema, files_per_batch=1)


@query("dedup_late_notes", LATE, "ledger")
def _(c):
    return drain(L.dedup_notes(in_batches(c))).select("seq", "level", "tag", "msg")


@query("page_completion", """
WITH e AS (SELECT event_id // 20 AS page_id, event_id % 10 AS region_id, event_id % 20 < 10 AS told, ts,
    trim(CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN '' ELSE coalesce(props, '') END) <> '' AS said FROM events),
p AS (SELECT page_id, epoch_ms(max(ts)) + 3600000 < (SELECT epoch_ms(max(ts)) - 600000 FROM events) AS over FROM e GROUP BY page_id),
a AS (SELECT DISTINCT page_id, region_id, TRUE AS yes FROM e WHERE told), b AS (SELECT DISTINCT page_id, region_id, TRUE AS yes FROM e WHERE NOT told AND said),
m AS (SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.region_id, b.region_id) AS region_id, a.yes AS told, b.yes AS said FROM a FULL JOIN b ON a.page_id = b.page_id AND a.region_id = b.region_id),
c AS (SELECT page_id, count(*) FILTER (told) AS n, count(*) FILTER (told AND said IS NULL) AS lacking FROM m GROUP BY page_id)
SELECT page_id, 'complete' AS kind, CAST(NULL AS BIGINT) AS region_id, n FROM c WHERE n > 0 AND lacking = 0
UNION ALL SELECT m.page_id, CASE WHEN n > 0 THEN 'repair' ELSE 'late' END, region_id, 1 FROM m JOIN c USING (page_id) JOIN p USING (page_id)
WHERE over AND ((lacking > 0 AND told AND said IS NULL) OR n = 0)""")
def _(c):
    e = event_stream(c)
    i = F.col("event_id")
    rows = e.select(
        F.floor(i / 20).alias("page_id"), (i % 10).alias("region_id"), F.when(i % 20 < 10, "region").otherwise("answer").alias("kind"),
        F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "").otherwise(F.col("props")).alias("text"), "ts")
    return drain(P.page_completion(rows))


@query("incremental_ingest", "WITH " + SUPPRESS_SQL + "," + MERGE_SQL + "," + order_sql("mrg", "ro") + " SELECT page_id, det_id, row_no, idx FROM ro_o", "det")
def _(c):
    landing = fresh_path(c.spark, "landing")
    c.det.repartition(2).write.parquet(landing)
    out = fresh_path(c.spark, "regions")
    s = read_stream(c.spark, landing, c.det.schema, files_per_batch=1)
    P.ingest(s, fresh_path(c.spark, "raw"), out, fresh_path(c.spark, "progress")).awaitTermination()
    return c.spark.read.parquet(out).select("page_id", "det_id", "row_no", "idx")

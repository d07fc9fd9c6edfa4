"""Source, ledger and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.operators import evaluate as E
from pagelens.operators import ledger as L
from pagelens.plans.registry import query
from pagelens.plans.text_queries import LABEL_SQL, repeat_sql
from pagelens.functions import fixed as X
from pagelens.sources import codecs, reports

# ---------------------------------------------------------------- sources


@query("decode_detections", """
SELECT l_orderkey AS image_id, l_linenumber % 3 AS cls, l_discount * 10 AS score, l_quantity AS x1, l_quantity + 5 AS y1, l_quantity + 40 AS x2, l_quantity + 60 AS y2
FROM lineitem WHERE l_discount * 10 >= 3e-1""")
def _(c):
    q = F.col("l_quantity")
    raw = c.lineitem.groupBy(F.col("l_orderkey").alias("image_id")).agg(F.collect_list(F.struct(
        (F.col("l_linenumber") % 3).alias("label"), F.array(q, q + 5, q + 40, q + 60).alias("box"), (F.col("l_discount") * 10).alias("score"))).alias("d"))
    raw = raw.select("image_id", F.col("d.label").alias("labels"), F.col("d.box").alias("boxes"), F.col("d.score").alias("scores"))
    return codecs.decode_detections(raw).drop("ord")


@query("decode_logits", """
WITH p AS (SELECT det_id, page_id, [1 / (1 + exp(-(score - 500) / 200e0)), 1 / (1 + exp(-(x1 - 200) / 100e0)), 1 / (1 + exp(-(y1 - 300) / 150e0))] AS p, x1 / 1000e0 AS cx, y1 / 1000e0 AS cy,
  (x2 - x1) / 1000e0 AS bw, (y2 - y1) / 1000e0 AS bh, w, h FROM det JOIN frames USING (page_id))
SELECT page_id, det_id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS cls, list_max(p) AS score, (cx - bw / 2) * w AS x1, (cy - bh / 2) * h AS y1, (cx + bw / 2) * w AS x2, (cy + bh / 2) * h AS y2
FROM p WHERE list_max(p) >= 3e-1""", "det frames")
def _(c):
    d = c.det.join(c.frames, "page_id")
    raw = d.select(
        "page_id", "det_id", "w", "h", F.array((F.col("score") - 500) / F.lit(200.0), (F.col("x1") - 200) / F.lit(100.0), (F.col("y1") - 300) / F.lit(150.0)).alias("logits"),
        F.array(*[e / F.lit(1000.0) for e in (F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))]).alias("box"))
    return codecs.decode_logits(raw)


@query("parse_notes", "SELECT seq, level, tag, msg FROM ledger", "ledger")
def _(c):
    lines = c.ledger.select("seq", codecs.note_line(F.col("level"), F.col("tag"), F.col("msg")).alias("value"))
    return codecs.parse_notes(lines)


@query("keyed_json", "SELECT event_id, event_id % 7 AS region_id, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events")
def _(c):
    doc = F.concat(F.lit('{"'), (F.col("event_id") % 7).cast("string"), F.lit('": '), F.col("props"), F.lit(', "note": {"k": 1}}'))
    rows = codecs.read_keyed_json(c.events.select("event_id", doc.alias("value")), "struct<k:int>")
    return rows.select("event_id", "region_id", F.col("v.k").alias("k"))


@query("decode_replies", """
SELECT 'answer' AS kind, event_id, user_id AS region_id, 't' || event_id AS text, NULL AS out_tokens FROM events WHERE event_type NOT IN ('error', 'view')
UNION ALL SELECT 'failure', event_id, NULL, CASE WHEN event_type = 'view' THEN 'truncated' ELSE 'off_format' END, CAST(user_id AS INT) FROM events WHERE event_type IN ('error', 'view')""")
def _(c):
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    said = F.when(F.col("event_type") == "error", "no json").when(F.col("event_type") == "view", "cut off {").otherwise(
        F.concat(F.lit('Sure: {"'), user, F.lit('": "t'), event, F.lit('", "x": "y"} done')))
    reply = F.to_json(F.struct(
        F.array(F.struct(F.struct(said.alias("content")).alias("message"), F.when(F.col("event_type") == "view", "length").otherwise("stop").alias("finish_reason"))).alias("choices"),
        F.struct(F.col("user_id").alias("completion_tokens")).alias("usage")))
    prefix = F.when(F.col("event_id") % 2 == 0, "data: ").otherwise("")
    ok, bad = codecs.decode_replies(c.events.select("event_id", F.concat(prefix, reply).alias("raw")))
    a = ok.select(F.lit("answer").alias("kind"), "event_id", "region_id", "text", F.lit(None).cast("int").alias("out_tokens"))
    return a.unionByName(bad.select(F.lit("failure").alias("kind"), "event_id", F.lit(None).cast("bigint").alias("region_id"), F.col("reason").alias("text"), "out_tokens"))


@query("read_reports", """
SELECT page_id, region_id, x1, y1, x2, y2, det_conf, label, src_text, translation, overflowed, route, residue FROM regions""", "regions")
def _(c):
    docs = L.report_documents(c.regions, c.ledger)
    folder = reports.write_documents(docs)
    return reports.read_reports(c.spark, folder)[0]


@query("report_notes", "SELECT page_id, seq, level, tag, msg FROM ledger SEMI JOIN regions USING (page_id)", "regions ledger")
def _(c):
    folder = reports.write_documents(L.report_documents(c.regions, c.ledger))
    return reports.read_reports(c.spark, folder)[1]


# Every tenth page's document breaks off.
@query("report_rejects", """
SELECT left('{"page_id":' || page_id, 12) AS bad, count(*) AS n FROM (SELECT DISTINCT page_id FROM regions) WHERE page_id % 10 = 0 GROUP BY 1""", "regions")
def _(c):
    docs = L.report_documents(c.regions, c.ledger)
    folder = reports.write_documents(docs.withColumn("doc", F.when(F.col("page_id") % 10 == 0, F.left("doc", F.lit(12))).otherwise(F.col("doc"))))
    return reports.read_reports(c.spark, folder)[2].groupBy(F.col("_bad").alias("bad")).agg(F.count(F.lit(1)).alias("n"))


@query("write_reports", "SELECT *, CAST(page_id % 3 AS INT) AS run_id FROM regions", "regions")
def _(c):
    folder = reports.write_tables(c.regions.withColumn("run_id", F.col("page_id") % 3))
    return c.spark.read.parquet(folder).select(*c.regions.columns, F.col("run_id").cast("int").alias("run_id"))


# ---------------------------------------------------------------- reports

COUNTS_SQL = """nt AS (SELECT page_id, count(*) FILTER (level = 'error') AS error_count, count(*) FILTER (level = 'warn') AS warn_count FROM ledger GROUP BY page_id),
ct AS (SELECT r.page_id, count(*) AS region_count, count(*) FILTER (residue) AS residue_count, count(*) FILTER (overflowed) AS overflow_count,
  count(*) FILTER (label IN ('SFX', 'UNREADABLE')) AS protected_count, count(*) FILTER (label = 'SFX') AS sfx_count, count(*) FILTER (coalesce(translation, '') <> '') AS translated_count,
  count(*) FILTER (label NOT IN ('SFX', 'UNREADABLE') AND src_text <> '' AND coalesce(translation, '') = '') AS untranslated_count,
  count(*) FILTER (label NOT IN ('SFX', 'UNREADABLE') AND src_text <> '') AS translatable_count, count(*) FILTER (route = 'flat') AS route_flat, count(*) FILTER (route = 'lama') AS route_lama,
  coalesce(any_value(error_count), 0) AS error_count, coalesce(any_value(warn_count), 0) AS warn_count,
  coalesce(string_agg(region_id, ',' ORDER BY region_id) FILTER (residue), '') AS residue_idx, coalesce(string_agg(region_id, ',' ORDER BY region_id) FILTER (label = 'SFX'), '') AS sfx_idx,
  coalesce(string_agg(region_id, ',' ORDER BY region_id) FILTER (label NOT IN ('SFX', 'UNREADABLE') AND src_text <> '' AND coalesce(translation, '') = ''), '') AS untranslated_idx
  FROM regions r LEFT JOIN nt ON nt.page_id = r.page_id GROUP BY r.page_id)"""


@query("page_report", "WITH " + COUNTS_SQL + " SELECT * FROM ct", "regions ledger")
def _(c):
    counts, ids = L.page_report(c.regions, c.ledger)
    lists = ("residue_idx", "sfx_idx", "untranslated_idx")
    texts = ids.groupBy("page_id").pivot("kind", list(lists)).agg(F.array_join(F.array_sort(F.collect_list("region_id")).cast("array<string>"), ","))
    j = counts.join(texts, "page_id", "left")
    return j.select(*counts.columns, *[F.coalesce(n, F.lit("")).alias(n) for n in lists])


@query("page_table", "WITH " + COUNTS_SQL + """
SELECT page_id AS page, region_count AS regions, sfx_count AS sfx_kept, translated_count AS translated, CASE WHEN untranslated_count > 0 THEN '**' || untranslated_count || '**' ELSE '0' END AS untranslated,
  residue_count AS residue, overflow_count AS overflow, CASE WHEN error_count > 0 AND warn_count > 0 THEN 'E' || error_count || ' W' || warn_count WHEN error_count > 0 THEN 'E' || error_count
  WHEN warn_count > 0 THEN 'W' || warn_count ELSE '-' END AS notes FROM ct""", "regions ledger")
def _(c):
    return L.page_table(L.page_counts(c.regions, c.ledger))


def run_counts(c):
    return L.page_counts(c.regions, c.ledger).withColumn("run_id", F.col("page_id") % 40)


@query("batch_summary", "WITH " + COUNTS_SQL + """
SELECT page_id % 40 AS run_id, page_id, count(*) AS pages, CAST(sum(region_count) AS BIGINT) AS regions, CAST(sum(residue_count) AS BIGINT) AS residue_total, CAST(sum(overflow_count) AS BIGINT) AS overflow_total,
  CAST(sum(sfx_count) AS BIGINT) AS sfx_total, CAST(sum(error_count) AS BIGINT) AS error_total, CAST(sum(warn_count) AS BIGINT) AS warn_total, CAST(sum(translated_count) AS BIGINT) AS translated_total,
  CAST(sum(untranslated_count) AS BIGINT) AS untranslated_total, grouping_id(page_id % 40, page_id) AS level FROM ct GROUP BY ROLLUP (page_id % 40, page_id)""", "regions ledger")
def _(c):
    return L.batch_summary(run_counts(c))


def lines_sql(level: str, limit: int, n: str) -> str:
    return f"""{n}_d AS (SELECT page_id % 40 AS run_id, msg, min(seq) AS seq, arg_min(tag, seq) AS tag FROM ledger WHERE level = '{level}' GROUP BY ALL),
{n}_k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k FROM {n}_d QUALIFY k <= {limit}),
{n} AS (SELECT run_id, string_agg('[' || tag || '] ' || msg, '; ' ORDER BY k) AS l, count(*) AS n FROM {n}_k GROUP BY run_id)"""


@query("diagnose", "WITH " + COUNTS_SQL + "," + lines_sql("error", 6, "el") + "," + lines_sql("warn", 4, "wl") + """,
rn AS (SELECT page_id % 40 AS run_id, count(*) FILTER (translatable_count > 0 AND translated_count = 0) AS dead_pages, count(*) FILTER (untranslated_count > 0) AS partial_pages,
  CAST(sum(untranslated_count) AS BIGINT) AS untranslated, CAST(sum(residue_count) AS BIGINT) AS residue_total, CAST(sum(overflow_count) AS BIGINT) AS overflow_total FROM ct GROUP BY 1),
dn AS (SELECT page_id % 40 AS run_id, page_id, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) AS k FROM ct WHERE translatable_count > 0 AND translated_count = 0 QUALIFY k <= 8),
ds AS (SELECT run_id, string_agg(page_id, ', ' ORDER BY page_id) AS dead_names FROM dn GROUP BY 1),
sn AS (SELECT page_id % 40 AS run_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warns FROM ledger GROUP BY 1)
SELECT rn.run_id, dead_pages, partial_pages, untranslated, residue_total, overflow_total, dead_names, coalesce(errors, 0) AS errors, coalesce(warns, 0) AS warns,
  CASE WHEN el.n >= 6 THEN el.l || '; +' || (errors - 6) || ' more' ELSE el.l END AS error_lines, CASE WHEN wl.n >= 4 THEN wl.l || '; +' || (warns - 4) || ' more' ELSE wl.l END AS warn_lines,
  CASE WHEN dead_pages > 0 THEN 'dead' WHEN partial_pages > 0 THEN 'partial' WHEN coalesce(errors, 0) > 0 THEN 'failed' WHEN residue_total > 0 OR overflow_total > 0 OR coalesce(warns, 0) > 0 THEN 'soft' ELSE 'clean' END AS severity
FROM rn LEFT JOIN ds ON ds.run_id = rn.run_id LEFT JOIN sn ON sn.run_id = rn.run_id LEFT JOIN el ON el.run_id = rn.run_id LEFT JOIN wl ON wl.run_id = rn.run_id""", "regions ledger")
def _(c):
    return L.diagnose(run_counts(c), c.ledger.withColumn("run_id", F.col("page_id") % 40))


@query("note_counts", "SELECT level, tag, count(*) AS n, grouping_id(level, tag) AS gid FROM ledger GROUP BY CUBE (level, tag)", "ledger")
def _(c):
    return L.note_counts(c.ledger)


@query("notes_by_page", """
WITH m AS (SELECT event_id AS seq, user_id % 3 AS run_id, event_id AS page_id FROM events WHERE event_type = 'signup'), n AS (SELECT seq, seq % 3 AS run_id, msg FROM ledger)
SELECT n.seq, n.run_id, n.msg, m.page_id AS at_page FROM n ASOF LEFT JOIN m ON n.run_id = m.run_id AND n.seq >= m.seq""", "ledger")
def _(c):
    marks = c.events.filter("event_type = 'signup'").select((F.col("user_id") % 3).alias("run_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("page_id"))
    return L.notes_by_page(c.ledger.select("seq", (F.col("seq") % 3).alias("run_id"), "msg"), marks)


@query("attempt_outcomes", """
WITH a AS (SELECT *, CAST(round(elapsed * 100) AS BIGINT) AS cents FROM attempts),
s AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY call_id ORDER BY attempt) AS BIGINT) AS spent FROM a),
e AS (SELECT *, CASE WHEN 24000 - (spent - cents) <= 100 THEN 'deadline' WHEN code = 200 THEN 'success' WHEN code = 402 THEN 'fatal' END AS fin FROM s),
f AS (SELECT call_id, attempt, fin, CASE WHEN fin = 'deadline' THEN spent - cents ELSE spent END AS c FROM e WHERE fin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY attempt) = 1),
t AS (SELECT e.call_id, e.attempt, e.code, row_number() OVER (PARTITION BY e.call_id ORDER BY e.attempt DESC) AS k FROM e LEFT JOIN f ON f.call_id = e.call_id WHERE f.attempt IS NULL OR e.attempt < f.attempt),
g AS (SELECT call_id, count(*) AS n, string_agg(code, ',' ORDER BY attempt) FILTER (k <= 6) AS l FROM t GROUP BY 1)
SELECT x.call_id, coalesce(fin, 'exhausted') AS outcome, coalesce(n, 0) AS failures, coalesce(l, '') AS last_failures, coalesce(f.c, x.total) AS cents
FROM (SELECT call_id, max(spent) AS total FROM s GROUP BY 1) x LEFT JOIN f ON f.call_id = x.call_id LEFT JOIN g ON g.call_id = x.call_id""", "attempts")
def _(c):
    return L.attempt_outcomes(c.attempts)


@query("latency_stats", """
WITH s AS (SELECT event_type AS variant, value AS seconds, length(props) * 20 AS o, user_id % 50 AS r, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT variant, count(*) AS n, min(seconds) AS min, max(seconds) AS max, CAST(sum(o) AS BIGINT) AS out_tokens, CAST(sum(r) AS BIGINT) AS reason_tokens, max(seconds) FILTER (k = n // 2 + 1) AS upper_median,
  CAST(sum(o) - sum(r) AS BIGINT) AS useful_tokens FROM s GROUP BY variant""")
def _(c):
    s = c.events.select(F.col("event_type").alias("variant"), F.col("value").alias("seconds"), (F.length("props") * 20).alias("out_tokens"), (F.col("user_id") % 50).alias("reason_tokens"))
    return L.latency_stats(s)


@query("prefix_counts", "SELECT split_part(p_name, ' ', 1) AS prefix, count(*) AS n FROM part GROUP BY 1")
def _(c):
    return L.prefix_counts(c.part.select(F.col("p_name").alias("name")), " ")


DIFF_B = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CONCAT(text, '!') WHEN doc_id % 3 = 0 THEN replace(text, '\\n', '\\r\\n') ELSE text END AS text FROM {documents} WHERE doc_id % 13 <> 0
UNION ALL SELECT doc_id + 10000000, text FROM {documents} WHERE doc_id % 50 = 0"""


@query("diff_tables", """
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'drift' ELSE 'same' END AS status FROM documents
UNION ALL SELECT doc_id + 10000000, 'orphan' FROM documents WHERE doc_id % 50 = 0""")
def _(c):
    return L.diff_tables(c.documents, c.spark.sql(DIFF_B, documents=c.documents), ["doc_id"], "text")


@query("distinct_counts", "SELECT lang, count(*) AS n, count(DISTINCT text) AS exact, true AS close FROM documents GROUP BY lang")
def _(c):
    d = L.distinct_counts(c.documents, "lang", "text")
    return d.select("lang", "n", "exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.1 * F.col("exact") + 2).alias("close"))


@query("stage_drift", """
WITH s AS (SELECT page_id, det_id AS region_id, unnest([1, 2, 3]) AS stage_no, (x2 - x1) * (y2 - y1) AS a, score FROM det),
t AS (SELECT page_id, region_id, stage_no, CAST(a - (stage_no - 1) * score AS BIGINT) AS area, score AS ink_px, lag(CAST(a - (stage_no - 1) * score AS BIGINT)) OVER (PARTITION BY page_id, region_id ORDER BY stage_no) AS p FROM s)
SELECT page_id, region_id, stage_no, area, area - p AS change, CASE WHEN p > 0 THEN 100e0 * (p - area) / p END AS lost_pct, ink_px / CAST(greatest(area, 1) AS DOUBLE) AS ink_ratio FROM t""", "det")
def _(c):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    s = c.det.select("page_id", F.col("det_id").alias("region_id"), F.col("score").alias("ink_px"), area.alias("a"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("stage_no"))
    return L.stage_drift(s.withColumn("area", (F.col("a") - (F.col("stage_no") - 1) * F.col("ink_px")).cast("bigint")))


# ---------------------------------------------------------------- evaluation

def rules():
    guess = lambda cond: F.when(cond, "SFX").otherwise("DIALOGUE")
    core = F.col("_core")
    return {"short": guess(F.length(core) <= 3), "sounds": guess(core.isin(*X.SOUNDS)), "repeat": guess(F.col("_rep")), "chain": F.col("want")}


@query("evaluate_rules", "WITH " + LABEL_SQL + f""",
v AS (SELECT src, in_parent, label, unnest([{{'n': 'short', 'g': CASE WHEN length(regexp_replace(text, '[^{X.KANA}]', '', 'g')) <= 3 THEN 'SFX' ELSE 'DIALOGUE' END}},
  {{'n': 'sounds', 'g': CASE WHEN regexp_replace(text, '[^{X.KANA}]', '', 'g') IN ({", ".join("'" + s + "'" for s in X.SOUNDS)}) THEN 'SFX' ELSE 'DIALOGUE' END}},
  {{'n': 'repeat', 'g': CASE WHEN {repeat_sql('core')} THEN 'SFX' ELSE 'DIALOGUE' END}}, {{'n': 'chain', 'g': label}}]) AS r FROM lab)
SELECT r.n AS variant, CASE WHEN in_parent THEN 'inside' ELSE 'outside' END AS case_set, count(*) AS cases, count(*) FILTER (r.g <> label) AS errors, count(*) FILTER (r.g <> label AND r.g = 'SFX') AS false_positive,
  count(*) FILTER (r.g <> label AND label = 'SFX') AS missed, min(src) FILTER (r.g <> label) AS first_miss FROM v GROUP BY 1, 2""", "kana")
def _(c):
    cases = c.kana.select(F.when(F.col("in_parent"), "inside").otherwise("outside").alias("case_set"), F.col("src").alias("case"), "text", "in_parent")
    return E.evaluate_rules(T.with_shape(cases, F.col("text")).withColumn("want", T.label(F.col("in_parent"))), rules())


@query("sweep", """
WITH sd AS (SELECT least(x2 - x1, y2 - y1) AS side, count(*) AS n FROM det WHERE cls <> 0 GROUP BY 1),
g AS (SELECT side, n, spacing, pad, CAST(trunc((side - 2 * CAST(trunc(side * pad) AS INT)) / (spacing * 4)) AS INT) AS raw FROM sd, (SELECT unnest([128e-2, 11e-1, 1e0, 96e-2, 9e-1]) AS spacing), (SELECT unnest([1e-1, 8e-2, 6e-2, 4e-2]) AS pad)),
f AS (SELECT *, CASE WHEN raw < 11 THEN 0 ELSE least(raw, 96) END AS feas FROM g),
x AS (SELECT spacing, pad, feas, unnest(range(n)) AS z FROM f WHERE feas > 0),
t AS (SELECT spacing, pad, least(greatest(CAST(round_even(quantile_cont(feas, 35e-2), 0) AS INT), 11), 96) AS target FROM x GROUP BY 1, 2),
s AS (SELECT spacing, pad, target, CAST(sum(CASE WHEN feas > 0 THEN 0 ELSE n END) AS BIGINT) AS zeros, round(max(least(feas, target)) FILTER (feas > 0) / CAST(min(least(feas, target)) FILTER (feas > 0) AS DOUBLE), 2) AS spread,
  round(sum(n * abs(least(feas, target) - side * 117e-3 / 844e-3)) FILTER (feas > 0) / sum(n) FILTER (feas > 0), 2) AS deviation FROM f JOIN t USING (spacing, pad) GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (ORDER BY zeros, spread, deviation, spacing, pad) = 1 AS best FROM s""", "det")
def _(c):
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return E.sweep(c.det.filter("cls <> 0").select(side.alias("side")), [1.28, 1.10, 1.00, 0.96, 0.90], [0.10, 0.08, 0.06, 0.04])


@query("calibrate", """
SELECT cls, count(*) AS n, quantile_cont((x2 - x1) / CAST(y2 - y1 AS DOUBLE), 1e-1) AS p10, quantile_cont((x2 - x1) / CAST(y2 - y1 AS DOUBLE), 25e-2) AS p25, quantile_cont((x2 - x1) / CAST(y2 - y1 AS DOUBLE), 5e-1) AS median,
  quantile_cont((x2 - x1) / CAST(y2 - y1 AS DOUBLE), 75e-2) AS p75, quantile_cont((x2 - x1) / CAST(y2 - y1 AS DOUBLE), 9e-1) AS p90 FROM det GROUP BY cls""", "det")
def _(c):
    return E.calibrate(c.det, "cls", (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))


@query("size_models", """
WITH r0 AS (SELECT page_id, det_id, x1, y1, x2, y2, CAST(least(x2 - x1, y2 - y1) // 6 AS INT) AS feas, least(x2 - x1, y2 - y1) * 117e-3 / 844e-3 AS ideal, 5 + score % 40 AS ref FROM det WHERE cls <> 0),
rr AS (SELECT * FROM r0 WHERE feas > 0 AND ref > 0),
g AS (SELECT page_id, greatest(CAST(trunc(median(y2 - y1) * 6e-1) AS INT), 20) AS gap, CAST(trunc(quantile_cont(feas, 35e-2)) AS INT) AS p35 FROM rr GROUP BY page_id),
s AS (SELECT *, max(y2) OVER (PARTITION BY page_id ORDER BY y1, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bot FROM rr),
f AS (SELECT s.*, p35, CASE WHEN bot IS NOT NULL AND y1 - bot > gap THEN 1 ELSE 0 END AS st FROM s JOIN g USING (page_id)),
p AS (SELECT *, sum(st) OVER (PARTITION BY page_id ORDER BY y1, det_id ROWS UNBOUNDED PRECEDING) AS panel FROM f),
m AS (SELECT *, CAST(round_even(median(least(ideal, feas)) OVER (PARTITION BY page_id, panel), 0) AS INT) AS mid FROM p),
e AS (SELECT page_id, 'uniform' AS model, avg(abs(least(p35, feas) - ref)) AS error, NULL AS k FROM m GROUP BY page_id UNION ALL SELECT page_id, 'proportional', avg(abs(least(CAST(round_even(ideal, 0) AS INT), feas) - ref)), NULL FROM m GROUP BY page_id
  UNION ALL SELECT page_id, 'panel', avg(abs(least(mid, feas) - ref)), NULL FROM m GROUP BY page_id UNION ALL SELECT page_id, 'fill', avg(abs(feas - ref)), NULL FROM m GROUP BY page_id),
ks AS (SELECT page_id, k, round(avg(abs(least(CAST(round_even(ideal * k, 0) AS INT), feas) - ref)), 9) AS error FROM m, (SELECT 1e0 + unnest(range(21)) * 5e-2 AS k) GROUP BY 1, 2)
SELECT page_id, model, error, CAST(k AS DOUBLE) AS k FROM e UNION ALL (SELECT page_id, 'scaled', error, k FROM ks QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY error, k) = 1)""", "det")
def _(c):
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    r = c.det.filter("cls <> 0").select("page_id", "det_id", "x1", "y1", "x2", "y2", F.floor(side / 6).cast("int").alias("feas"), (side * 0.117 / 0.844).alias("ideal"), (5 + F.col("score") % 40).alias("ref"))
    return E.size_models(r)


@query("check", """
WITH b AS (SELECT count(*) FILTER (NOT (x2 > x1 AND y2 > y1)) AS a, count(*) FILTER (label = 'SFX' AND translation IS NOT NULL) AS b, count(*) FILTER (overflowed) AS c, count(*) AS n FROM regions)
SELECT 'has_rows' AS name, 'PASS' AS status, CAST(0 AS BIGINT) AS failures UNION ALL SELECT 'solid_boxes', CASE WHEN a > 0 THEN 'FAIL' ELSE 'PASS' END, a FROM b UNION ALL SELECT 'sounds_untranslated', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b FROM b
UNION ALL SELECT 'no_overflow', CASE WHEN c > 0 THEN 'FAIL' ELSE 'PASS' END, c FROM b
UNION ALL SELECT 'all', CASE WHEN a + b + c > 0 THEN 'FAIL' ELSE 'PASS' END, CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS BIGINT) FROM b""", "regions")
def _(c):
    return E.check(c.regions, {
        "solid_boxes": (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")),
        "sounds_untranslated": (F.col("label") != "SFX") | F.col("translation").isNull(),
        "no_overflow": ~F.col("overflowed")})


@query("grid", """
SELECT det_id, size, pad, (x2 - x1) - 2 * pad AS room FROM det, (SELECT CAST(unnest([8, 12, 16]) AS INT) AS size), (SELECT CAST(unnest([2, 4]) AS INT) AS pad) WHERE (x2 - x1) - 2 * pad >= size""", "det")
def _(c):
    from pagelens.operators.boxes import grid

    room = F.col("x2") - F.col("x1") - 2 * F.col("pad")
    return grid(c.det, size=[8, 12, 16], pad=[2, 4]).select("det_id", "size", "pad", room.alias("room")).filter("room >= size")


@query("run_inventory", """
SELECT page_id, count(*) FILTER (coalesce(translation, '') <> '') / CAST(count(*) AS DOUBLE) AS translated_share FROM regions GROUP BY page_id""", "regions")
def _(c):
    folder = reports.write_documents(L.report_documents(c.regions, c.ledger))
    return reports.run_inventory(c.spark, folder).select("page_id", "translated_share")

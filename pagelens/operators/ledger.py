"""Notes, page reports, batch summaries and provider attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators.grouping import GROUP_LIMIT, Scan, scan, top_k
from pagelens.operators.texts import with_protection
from pagelens.settings import SETTINGS

# Transient HTTP codes.
TRANSIENT = (429, 500, 502, 503, 504)


def page_counts(regions: DataFrame, notes: DataFrame) -> DataFrame:
    """Counts of the page report, one row per page."""
    r = with_protection(regions)
    done = F.coalesce("translation", F.lit("")) != ""
    n = r.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("region_count"), F.count_if("residue").alias("residue_count"), F.count_if("overflowed").alias("overflow_count"),
        F.count_if("protected").alias("protected_count"), F.count_if(F.col("label") == "SFX").alias("sfx_count"), F.count_if(done).alias("translated_count"),
        F.count_if("to_send").alias("untranslated_count"), F.count_if("translatable").alias("translatable_count"),
        F.count_if(F.col("route") == "flat").alias("route_flat"), F.count_if(F.col("route") == "lama").alias("route_lama"),
    )
    m = notes.groupBy("page_id").agg(F.count_if(F.col("level") == "error").alias("error_count"), F.count_if(F.col("level") == "warn").alias("warn_count"))
    zero = {"error_count": 0, "warn_count": 0}
    return n.join(m, "page_id", "left").na.fill(zero)


def page_report(regions: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The page report: one row of counts for every page, and the table of its id lists.

    The second table has ``page_id, kind, region_id`` with kind residue_idx, sfx_idx or untranslated_idx, so
    that no row grows with its page.
    """
    lists = {"residue_idx": F.col("residue"), "sfx_idx": F.col("label") == "SFX", "untranslated_idx": F.col("to_send")}
    kinds = F.array_compact(F.array(*[F.when(cond, F.lit(kind)) for kind, cond in lists.items()]))
    ids = with_protection(regions).select("page_id", F.explode(kinds).alias("kind"), "region_id")
    return page_counts(regions, notes), ids


def report_documents(regions: DataFrame, notes: DataFrame) -> DataFrame:
    """Sidecar documents ``page_id, doc``: one JSON text for every page, with its id lists, regions and notes.

    A document is as large as its page by its format; pages too large for that belong in the tables of
    :func:`page_report`.
    """
    counts, ids = page_report(regions, notes)
    lists = ids.groupBy("page_id").pivot("kind", ["residue_idx", "sfx_idx", "untranslated_idx"]).agg(F.array_sort(F.collect_list("region_id")))
    rest = [c for c in regions.columns if c not in ("page_id", "region_id")]
    nested = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("region_id", *rest))).alias("regions"))
    said = notes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "level", "tag", "msg"))).alias("notes"))
    j = counts.join(lists, "page_id", "left").join(nested, "page_id").join(said, "page_id", "left")
    return j.select("page_id", F.to_json(F.struct(*j.columns)).alias("doc"))


def batch_summary(counts: DataFrame) -> DataFrame:
    """Page, run and grand totals in one roll-up; ``level`` 0 = page, 1 = run, 3 = all."""
    total = {n: F.sum(c) for n, c in {
        "regions": "region_count", "residue_total": "residue_count", "overflow_total": "overflow_count", "sfx_total": "sfx_count", "error_total": "error_count",
        "warn_total": "warn_count", "translated_total": "translated_count", "untranslated_total": "untranslated_count"}.items()}
    return counts.rollup("run_id", "page_id").agg(F.count(F.lit(1)).alias("pages"), *[c.alias(n) for n, c in total.items()], F.grouping_id().cast("bigint").alias("level"))


def first_messages(notes: DataFrame, level: str, limit: int) -> DataFrame:
    """First ``limit`` distinct messages per run in order of appearance, with the running place."""
    d = notes.filter(F.col("level") == level).groupBy("run_id", "msg").agg(F.min(F.struct("seq", "tag")).alias("m"))
    return top_k(d.select("run_id", "msg", F.col("m.seq").alias("seq"), F.col("m.tag").alias("tag")), ["run_id"], [F.col("seq")], limit, "place")


def diagnose(counts: DataFrame, notes: DataFrame) -> DataFrame:
    """Severity per run, the pages and regions behind it, and the first messages.

    A page is dead when something was translatable and nothing was translated. Once a message
    list reaches its limit the line "+N more" follows, N counting non-distinct notes past it.
    """
    dead = (F.col("translatable_count") > 0) & (F.col("translated_count") == 0)
    run = counts.groupBy("run_id").agg(
        F.count_if(dead).alias("dead_pages"), F.count_if(F.col("untranslated_count") > 0).alias("partial_pages"),
        F.sum("untranslated_count").alias("untranslated"), F.sum("residue_count").alias("residue_total"), F.sum("overflow_count").alias("overflow_total"))
    names = top_k(counts.filter(dead), ["run_id"], [F.col("page_id")], 8).groupBy("run_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda p: p.cast("string")), ", ").alias("dead_names"))
    seen = notes.groupBy("run_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warns"))
    out = run.join(names, "run_id", "left").join(seen, "run_id", "left").na.fill({"errors": 0, "warns": 0})
    for level, limit, name in (("error", 6, "error_lines"), ("warn", 4, "warn_lines")):
        lines = first_messages(notes, level, limit).groupBy("run_id").agg(
            F.array_sort(F.collect_list(F.struct("place", F.format_string("[%s] %s", "tag", "msg").alias("t")))).alias("l"))
        text = F.array_join(F.transform("l", lambda x: x["t"]), "; ")
        out = out.join(lines.select("run_id", text.alias(name), F.size("l").alias("n_" + name)), "run_id", "left")
        more = F.format_string("; +%d more", F.col(level + "s") - limit)
        out = out.withColumn(name, F.when(F.col("n_" + name) >= limit, F.concat(name, more)).otherwise(F.col(name))).drop("n_" + name)
    severity = (
        F.when(F.col("dead_pages") > 0, "dead").when(F.col("partial_pages") > 0, "partial").when(F.col("errors") > 0, "failed")
        .when((F.col("residue_total") > 0) | (F.col("overflow_total") > 0) | (F.col("warns") > 0), "soft").otherwise("clean"))
    return out.withColumn("severity", severity)


def page_table(counts: DataFrame) -> DataFrame:
    """Eight display columns per page."""
    flag = F.concat_ws(" ", F.when(F.col("error_count") > 0, F.concat(F.lit("E"), "error_count")), F.when(F.col("warn_count") > 0, F.concat(F.lit("W"), "warn_count")))
    return counts.select(
        F.col("page_id").alias("page"), F.col("region_count").alias("regions"), F.col("sfx_count").alias("sfx_kept"), F.col("translated_count").alias("translated"),
        F.when(F.col("untranslated_count") > 0, F.concat(F.lit("**"), "untranslated_count", F.lit("**"))).otherwise("0").alias("untranslated"),
        F.col("residue_count").alias("residue"), F.col("overflow_count").alias("overflow"), F.when(flag == "", "-").otherwise(flag).alias("notes"))


def note_counts(notes: DataFrame) -> DataFrame:
    return notes.cube("level", "tag").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("gid"))


def notes_by_page(notes: DataFrame, marks: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Each note with the page being processed when it was written; NULL before the first page.

    Marks and notes run through one ordered scan per run, so no range join is needed; a long run
    is scanned in blocks.
    """
    m = marks.select("run_id", "seq", F.col("page_id").alias("mark"), F.lit(0).alias("is_note"))
    n = notes.select("run_id", "seq", F.lit(None).cast("bigint").alias("mark"), F.lit(1).alias("is_note"), *[c for c in notes.columns if c not in ("run_id", "seq")])
    both = n.unionByName(m, allowMissingColumns=True)
    done = scan(both, ["run_id"], [F.col("seq"), F.col("is_note")], [Scan("page", "last", "mark")], limit)
    return done.filter("is_note = 1").select(*notes.columns, F.col("page").alias("at_page"))


def attempt_outcomes(attempts: DataFrame, deadline: float = SETTINGS.deadline_seconds, limit: int = GROUP_LIMIT) -> DataFrame:
    """How each call ended: success, fatal, deadline or exhausted, with its last six failures.

    An attempt starts only while more than a second is left of the deadline over the whole chain.
    """
    a = attempts.withColumn("cents", F.round(F.col("elapsed") * 100).cast("bigint"))
    a = scan(a, ["call_id"], [F.col("attempt")], [Scan("spent", "sum", "cents")], limit)
    before = F.col("spent") - F.col("cents")
    end = F.when(int(deadline * 100) - before <= 100, "deadline").when(F.col("code") == 200, "success").when(~F.col("code").isin(*TRANSIENT), "fatal")
    a = a.withColumn("end", end)
    over = a.groupBy("call_id").agg(
        F.min(F.when(F.col("end").isNotNull(), F.struct("attempt", "end", before.alias("before"), F.when(F.col("end") != "deadline", F.col("spent")).alias("spent")))).alias("e"),
        F.max("spent").alias("all_spent"))
    over = over.select("call_id", F.coalesce("e.end", F.lit("exhausted")).alias("outcome"), F.col("e.attempt").alias("at"),
                       F.coalesce("e.spent", "e.before", "all_spent").alias("cents"))
    tried = a.join(over, "call_id").filter("at is null or attempt < at")
    n = tried.groupBy("call_id").agg(F.count(F.lit(1)).alias("failures"))
    last = top_k(tried.select("call_id", "attempt", "code"), ["call_id"], [-F.col("attempt")], 6).groupBy("call_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "code"))), lambda x: x["code"].cast("string")), ",").alias("last_failures"))
    return over.join(n, "call_id", "left").join(last, "call_id", "left").select(
        "call_id", "outcome", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"), F.coalesce("last_failures", F.lit("")).alias("last_failures"), "cents")


def latency_stats(samples: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Per variant n, min, upper median (element ``n // 2`` of the sorted list), max and token sums."""
    hist = samples.groupBy("variant", "seconds").agg(F.count(F.lit(1)).alias("c"))
    total = samples.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.min("seconds").alias("min"), F.max("seconds").alias("max"),
        F.sum("out_tokens").alias("out_tokens"), F.sum("reason_tokens").alias("reason_tokens"))
    run = scan(hist, ["variant"], [F.col("seconds")], [Scan("upto", "sum", "c")], limit).join(total, "variant")
    mid = run.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("variant").agg(F.min("seconds").alias("upper_median"))
    return total.join(mid, "variant").withColumn("useful_tokens", F.col("out_tokens") - F.col("reason_tokens"))


def prefix_counts(names: DataFrame, sep: str = "/") -> DataFrame:
    return names.groupBy(F.split_part("name", F.lit(sep), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix")


def stage_drift(snapshots: DataFrame) -> DataFrame:
    """Change of each region's area from stage to stage."""
    w = Window.partitionBy("page_id", "region_id").orderBy("stage_no")
    prev = F.lag("area").over(w)
    return snapshots.select(
        "page_id", "region_id", "stage_no", "area", (F.col("area") - prev).alias("change"),
        F.when(prev > 0, 100.0 * (prev - F.col("area")) / prev).alias("lost_pct"), (F.col("ink_px") / F.greatest("area", F.lit(1))).alias("ink_ratio"))


def diff_tables(a: DataFrame, b: DataFrame, keys: list[str], text: str) -> DataFrame:
    """same, drift, missing (only in ``a``) or orphan (only in ``b``) per key; line ends do not count."""
    plain = lambda c: F.sha2(F.regexp_replace(c, "\r\n?", "\n"), 256)
    left = a.select(*keys, plain(F.col(text)).alias("ha"))
    right = b.select(*keys, plain(F.col(text)).alias("hb"))
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "orphan").when(F.col("ha") == F.col("hb"), "same").otherwise("drift")
    return left.join(right, keys, "full_outer").select(*keys, status.alias("status"))


def distinct_counts(rows: DataFrame, group: str, value: str) -> DataFrame:
    digest = F.xxhash64(value)
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5(value)).alias("exact"), F.approx_count_distinct(digest, 0.02).alias("approx"))

"""Decoders for detector output, log lines, keyed JSON and model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.settings import SETTINGS

LEVELS = {"!!": "error", "!": "warn", "i": "info"}


def decode_detections(raw: DataFrame, conf: float = SETTINGS.det_conf) -> DataFrame:
    """Parallel arrays ``labels, boxes, scores`` to one row per box at or above ``conf``."""
    z = F.arrays_zip("labels", "boxes", "scores")
    one = raw.select(*[c for c in raw.columns if c not in ("labels", "boxes", "scores")], F.posexplode(z).alias("ord", "d"))
    b = F.col("d.boxes")
    keys = [c for c in one.columns if c != "d"]
    return one.filter(F.col("d.scores") >= conf).select(
        *keys, F.col("d.labels").alias("cls"), F.col("d.scores").alias("score"),
        *[F.element_at(b, i + 1).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def decode_logits(raw: DataFrame, conf: float = SETTINGS.det_conf) -> DataFrame:
    """Raw branch: ``logits`` per class and a relative ``cxcywh`` box, scaled by ``w, h``."""
    p = F.transform("logits", lambda x: 1.0 / (1.0 + F.exp(-x)))
    best = F.array_max("p")
    cx, cy, bw, bh = (F.element_at("box", i) for i in (1, 2, 3, 4))
    rest = [c for c in raw.columns if c not in ("logits", "box", "w", "h")]
    return raw.withColumn("p", p).filter(best >= conf).select(
        *rest, (F.array_position("p", best) - 1).cast("int").alias("cls"), best.alias("score"),
        ((cx - bw / 2) * F.col("w")).alias("x1"), ((cy - bh / 2) * F.col("h")).alias("y1"),
        ((cx + bw / 2) * F.col("w")).alias("x2"), ((cy + bh / 2) * F.col("h")).alias("y2"))


def parse_notes(lines: DataFrame) -> DataFrame:
    """``[!!] [tag] msg`` lines (column ``value``) to level, tag and message; other lines are left out."""
    pat = r"^\s*\[(!!|!|i)\] \[([^\]]*)\] (.*)$"
    mark = F.regexp_extract("value", pat, 1)
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return lines.filter(F.col("value").rlike(pat)).select(
        *[c for c in lines.columns if c != "value"], level[mark].alias("level"), F.regexp_extract("value", pat, 2).alias("tag"), F.regexp_extract("value", pat, 3).alias("msg"))


def read_keyed_json(df: DataFrame, value_type: str, col: str = "value") -> DataFrame:
    """JSON objects keyed by region id to rows; keys that are not whole numbers are dropped."""
    pairs = df.select(*[c for c in df.columns if c != col], F.explode(F.from_json(col, f"map<string,{value_type}>")).alias("k", "v"))
    key = F.expr("try_cast(k AS BIGINT)")
    return pairs.withColumn("region_id", key).filter("region_id is not null").drop("k")


def decode_replies(df: DataFrame, col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Model replies to answers per region, and failures with finish reason and token count.

    An optional ``data:`` prefix goes first; the answer is the outermost ``{...}`` of the content.
    """
    body = F.regexp_replace(F.trim(F.col(col)), r"^data:\s*", "")
    schema = ("choices array<struct<message:struct<content:string>,finish_reason:string>>, "
              "usage struct<prompt_tokens:int,completion_tokens:int>")
    keys = [c for c in df.columns if c != col]
    r = df.select(*keys, F.from_json(body, schema).alias("r")).select(
        *keys, F.coalesce(F.col("r.choices")[0]["message"]["content"], F.lit("")).alias("content"),
        F.col("r.choices")[0]["finish_reason"].alias("finish_reason"), F.col("r.usage.completion_tokens").alias("out_tokens"))
    inner = F.regexp_extract("content", r"(?s)(\{.*\})", 1)
    parsed = r.withColumn("map", F.when(inner != "", F.from_json(inner, "map<string,string>")))
    answers = parsed.filter("map is not null").select(*keys, F.explode("map").alias("k", "text")).select(
        *keys, F.expr("try_cast(k AS BIGINT)").alias("region_id"), "text").filter("region_id is not null")
    why = F.when(F.col("finish_reason") == "length", "truncated").otherwise("off_format")
    failures = parsed.filter("map is null").select(*keys, why.alias("reason"), "finish_reason", "out_tokens")
    return answers, failures


def note_line(level: Column, tag: Column, msg: Column) -> Column:
    """The inverse of :func:`parse_notes`."""
    mark = F.when(level == "error", "!!").when(level == "warn", "!").otherwise("i")
    return F.concat(F.lit("["), mark, F.lit("] ["), tag, F.lit("] "), msg)

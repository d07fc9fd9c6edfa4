"""The corpus a query runs on: driver tables plus the page tables derived from them.

Each derived view is one SQL text valid in Spark and in DuckDB. ``{name}`` refers to a driver
table or an earlier view; ``{pixel_grid}`` is the one place where the dialects differ.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from pagelens.operators.raster import scanlines
from pagelens.operators.runs import to_runs
from pagelens.session import materialize, measured_joins, prepare, reduce_tasks

SIDE = 48
#: Pages that one task turns into pixels; their rows fit the memory that a task has for sorting.
PAGES_A_TASK = 256
#: Turns of conversations that one task wraps and cleans.
TURNS_A_TASK = 5_000

VIEWS: dict[str, str] = {
    # Detections: class 0 is a container, 1 and 2 are text. (orderkey, linenumber) repeats.
    "det": """
SELECT CAST(FLOOR(l_orderkey / 8e0) AS BIGINT) AS page_id,
       CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS det_id,
       CAST((MIN(l_partkey) * 37) % 400 AS INT) AS x1,
       CAST((MIN(l_suppkey) * 53) % 600 AS INT) AS y1,
       CAST((MIN(l_partkey) * 37) % 400 + 40 + (MIN(l_partkey) * 13) % 180 AS INT) AS x2,
       CAST((MIN(l_suppkey) * 53) % 600 + 40 + (MIN(l_suppkey) * 17) % 220 AS INT) AS y2,
       CAST((MIN(l_partkey) * 7 + l_linenumber * 101) % 3 AS INT) AS cls,
       CAST((MIN(l_partkey) * 31 + MIN(l_suppkey) * 17 + l_linenumber) % 1000 AS INT) AS score
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # A second detector run over the cleaned pages.
    "redet": """
SELECT page_id, det_id, x1 + score % 60 AS x1, y1 + score % 45 AS y1, x2 + score % 60 AS x2, y2 + score % 45 AS y2
FROM {det} WHERE score % 3 = 0""",
    # Page frames, tight enough for clipping to matter.
    "frames": """
SELECT page_id, CAST(520 + page_id % 640 AS INT) AS w, CAST(700 + (page_id * 7) % 500 AS INT) AS h
FROM {det} GROUP BY page_id""",
    # Finished regions as the report stage sees them.
    "regions": """
SELECT page_id, det_id AS region_id, x1, y1, x2, y2, score / 1000e0 AS det_conf,
       CASE WHEN score % 11 = 0 THEN 'UNREADABLE' WHEN score % 5 = 0 THEN 'SFX' ELSE 'DIALOGUE' END AS label,
       CASE WHEN score % 11 = 0 THEN '' ELSE CONCAT('src', CAST(score AS {string})) END AS src_text,
       CASE WHEN score % 5 = 0 OR page_id % 9 = 0 THEN NULL WHEN score % 17 = 0 THEN ''
            ELSE CONCAT('out', CAST(score AS {string})) END AS translation,
       score % 23 = 0 AS overflowed,
       CASE WHEN score % 11 = 0 OR score % 5 = 0 THEN 'skip' WHEN score % 4 = 0 THEN 'lama' ELSE 'flat' END AS route,
       score % 29 = 0 AS residue
FROM {det} WHERE cls <> 0""",
    "ledger": """
SELECT CAST(event_id AS BIGINT) AS seq, ts, CAST(FLOOR(event_id / 20e0) AS BIGINT) AS page_id,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' ELSE 'info' END AS level,
       CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'detect' WHEN 1 THEN 'translate' WHEN 2 THEN 'budget' ELSE 'ort' END AS tag,
       CONCAT('m', CAST(CAST(FLOOR(value / 25e0) AS INT) AS {string})) AS msg
FROM {events}""",
    "attempts": """
SELECT user_id AS call_id, event_id AS attempt, ts,
       CASE WHEN event_type = 'purchase' THEN 200 WHEN event_type = 'signup' THEN 402
            WHEN CAST(FLOOR(value) AS INT) % 2 = 0 THEN 502 ELSE 429 END AS code,
       value AS elapsed
FROM {events}""",
    # One SIDE x SIDE grey raster per page: two overlapping light discs with outlines and ink
    # strokes on textured ground, plus one block of protected ink in the lower left corner.
    "canvas": """
SELECT page_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(page_id % 20 AS INT) AS p,
       CAST((x - 15 - seed % 4) * (x - 15 - seed % 4) + (y - 19) * (y - 19) AS INT) AS da,
       CAST((x - 32 + page_id % 3) * (x - 32 + page_id % 3) + (y - 27) * (y - 27) AS INT) AS db,
       CAST((x * 31 + y * 17 + seed * 7) % 40 AS INT) AS noise
FROM (SELECT page_id, seed, i % 48 AS x, FLOOR(i / 48e0) AS y FROM {pixel_grid}) t""",
    "shaded": """
SELECT page_id, y, x, da, db, noise,
       CASE WHEN x BETWEEN 3 AND 9 AND y BETWEEN 39 AND 44 AND (x + y) % 3 = 0 THEN 20
            WHEN da < 64 AND x % 6 < 2 AND y % 8 < 5 THEN 15 + p
            WHEN db < 49 AND x % 6 < 2 AND y % 8 < 5 THEN 25 + p
            WHEN da < 144 OR db < 121 THEN 236 + noise % 8
            WHEN da < 182 OR db < 156 THEN 30
            ELSE 150 + noise END AS grey
FROM {canvas}""",
    "pix": "SELECT page_id, y, x, grey FROM {shaded}",
    # The same pages after erasing: some ink survives, everything else is unchanged.
    "after": """
SELECT page_id, y, x,
       CASE WHEN x BETWEEN 3 AND 9 AND y BETWEEN 39 AND 44 AND (x + y) % 3 = 0 THEN 20
            WHEN (da < 64 OR db < 49) AND x % 6 < 2 AND y % 8 < 5 THEN
                 CASE WHEN (x * 7 + y + p) % 13 < 4 THEN 30 ELSE 240 END
            WHEN da < 144 OR db < 121 THEN 236 + noise % 8
            WHEN da < 182 OR db < 156 THEN CASE WHEN (x + y + p) % 17 = 0 THEN 200 ELSE 30 END
            ELSE 150 + noise END AS grey
FROM {canvas}""",
    "rgb": """
SELECT page_id, y, x,
       CASE WHEN marked THEN 210 ELSE grey END AS r,
       CASE WHEN marked THEN 40 ELSE greatest(grey - x % 4, 0) END AS g,
       CASE WHEN marked THEN 50 ELSE greatest(grey - y % 5, 0) END AS b
FROM (SELECT *, da > 200 AND db > 200 AND x > 36 AND y < 12 AND noise % 7 <> 0 AS marked FROM {shaded}) t""",
    # Region boxes on the rasters; region 2 is the protected block.
    "crops": """
SELECT page_id, 0 AS region_id, CAST(3 + LENGTH(html) % 4 AS INT) AS x1, 7 AS y1,
       CAST(28 + LENGTH(html) % 4 AS INT) AS x2, 32 AS y2, 'DIALOGUE' AS label FROM {pages}
UNION ALL
SELECT page_id, 1, CAST(21 - page_id % 3 AS INT), 16, CAST(44 - page_id % 3 AS INT), 39, 'DIALOGUE' FROM {pages}
UNION ALL
SELECT page_id, 2, 2, 38, 11, 46, 'SFX' FROM {pages}""",
    "ink": """
SELECT page_id, 0 AS region_id, y, x FROM {canvas} WHERE da < 64 AND x % 6 < 2 AND y % 8 < 5
UNION ALL
SELECT page_id, 1, y, x FROM {canvas} WHERE db < 49 AND da >= 64 AND x % 6 < 2 AND y % 8 < 5
UNION ALL
SELECT page_id, 2, y, x FROM {canvas} WHERE x BETWEEN 3 AND 9 AND y BETWEEN 39 AND 44 AND (x + y) % 3 = 0""",
    "interior": """
SELECT page_id, 0 AS region_id, y, x FROM {canvas} WHERE da < 144
UNION ALL
SELECT page_id, 1, y, x FROM {canvas} WHERE db < 121
UNION ALL
SELECT page_id, 2, y, x FROM {canvas} WHERE x BETWEEN 2 AND 10 AND y BETWEEN 38 AND 45""",
    # Fill masks: a little larger than the interiors, with a stray lobe off to the side.
    "fill": """
SELECT page_id, 0 AS region_id, y, x FROM {canvas} WHERE da < 169
UNION ALL
SELECT page_id, 1, y, x FROM {canvas} WHERE db < 144 OR (x > 44 AND y < 6)""",
    "prob": """
SELECT page_id, 0 AS region_id, y, x,
       (CASE WHEN da < 64 AND x % 6 < 2 AND y % 8 < 5 THEN 380 + noise * 8
             WHEN x % 6 < 3 AND y % 8 < 6 THEN 60 + noise * 3 ELSE 20 END) / 1000e0 AS p
FROM {canvas} WHERE da < 200
UNION ALL
SELECT page_id, 1, y, x,
       (CASE WHEN db < 49 AND x % 6 < 2 AND y % 8 < 5 THEN 380 + noise * 8
             WHEN x % 6 < 3 AND y % 8 < 6 THEN 60 + noise * 3 ELSE 20 END) / 1000e0 AS p
FROM {canvas} WHERE db < 180""",
}

VIEWS |= {
    # Every distinct word of the documents, spelled in kana and symbols.
    "kana": """
SELECT w AS src, translate(lower(w), 'etaonihrsdlucmpwbfgvykxzqj.,', 'ドキっーんはぁぴくうそれ！？．ッ漢なに♥〜だめゴ　…。、') AS text,
       LENGTH(w) % 2 = 0 AS in_parent
FROM {doc_words} t WHERE w <> '' GROUP BY w""",
    "replies": """
SELECT CAST(FLOOR(conv_id / 20e0) AS BIGINT) AS page_id, conv_id AS region_id, CAST(FLOOR(turn / 2e0) AS INT) AS round,
       CASE WHEN LENGTH(text) % 3 = 0 THEN '  ' WHEN LENGTH(text) % 5 = 0 THEN '．．．' ELSE text END AS text
FROM {conversations} WHERE role = 'assistant'""",
    "asked": """
SELECT page_id, region_id, round, CASE WHEN round % 2 = 1 THEN 'budget' ELSE 'missing' END AS kind
FROM {replies} WHERE round > 0 AND region_id % 4 <> 0""",
    "items": """
SELECT CAST(FLOOR(conv_id / 20e0) AS BIGINT) AS page_id, conv_id AS region_id,
       CASE WHEN conv_id % 3 = 0 THEN CONCAT(text, '♥') ELSE text END AS src_text
FROM {conversations} WHERE turn = 0""",
    "boxed": """
SELECT doc_id, text, CAST(200 + doc_id % 200 AS INT) AS box_w, CAST(400 + (doc_id * 7) % 900 AS INT) AS box_h, CAST(8 + doc_id % 5 AS INT) AS size
FROM {documents}""",
}
WORDS = {
    "spark": "(SELECT doc_id, w FROM {documents} LATERAL VIEW explode(split(text, ' ')) e AS w)",
    "duckdb": "(SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM {documents})",
}
GRID = {
    # Spread the pages over the tasks before each one turns into SIDE*SIDE rows.
    "spark": "(SELECT page_id, seed, i FROM (SELECT /*+ REPARTITION({tasks}, page_id) */ page_id, LENGTH(html) AS seed "
             "FROM {pages}) LATERAL VIEW explode(sequence(0, 2303)) s AS i)",
    "duckdb": "(SELECT page_id, LENGTH(html) AS seed, unnest(range(2304)) AS i FROM {pages})",
}
STRING = {"spark": "STRING", "duckdb": "VARCHAR"}
_NAME = re.compile(r"\{(\w+)\}")


def needs(view: str) -> list[str]:
    """Views ``view`` is built from, itself last, each once."""
    seen: list[str] = []

    def visit(name: str) -> None:
        for child in _NAME.findall(VIEWS[name]):
            if child in VIEWS and child not in seen:
                visit(child)
        if name not in seen:
            seen.append(name)

    visit(view)
    return seen


class Corpus:
    """Driver tables and derived views of one folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = measured_joins(prepare(spark)), folder
        self._made: dict[str, DataFrame | int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._view(name) if name in VIEWS else self._table(name)
        return self._made[name]

    def once(self, name: str, make) -> DataFrame:
        """A table several steps of one query read: written the first time it is asked for."""
        key = "once " + name
        if key not in self._made:
            self._made[key] = materialize(make(), name)
        return self._made[key]

    def lines(self, name: str) -> DataFrame:
        """A raster view in rows instead of pixels. It is made where it is read, in the tasks that hold its page: neither written nor shuffled."""
        key = "lines " + name
        if key not in self._made:
            self._made[key] = scanlines(getattr(self, name))
        return self._made[key]

    def runs(self, name: str, only: int | None = None) -> DataFrame:
        """A mask view in runs, written once. Its branches hold one region each, so their pixels become runs in the tasks that hold their page.

        ``only`` takes the branch of one region.
        """
        branches = VIEWS[name].split("UNION ALL")
        made = [to_runs(self._sql(b if "AS region_id" in b else b.replace("page_id, %d," % i, "page_id, %d AS region_id," % i, 1)))
                for i, b in enumerate(branches) if only is None or i == only]
        return self.once(f"{name}-runs" if only is None else f"{name}-runs-{only}", lambda: reduce(DataFrame.unionByName, made))

    def _table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # A text table of one row group is read by one task; spread it before the per-text work.
        # A large table has more splits than cores and is left alone; turns are so small that their number decides.
        parts = self.spark.sparkContext.defaultParallelism
        if name == "conversations":
            parts = max(parts, -(-df.count() // TURNS_A_TASK))
        if name in ("documents", "conversations") and df.rdd.getNumPartitions() < parts:
            df = df.repartition(parts)
        return df

    def _tasks(self) -> int:
        """Parts of the pixel grid: more with more pages, so that no task grows with the input."""
        if "tasks" not in self._made:
            parts = -(-self.pages.count() // PAGES_A_TASK)
            reduce_tasks(self.spark, -(-parts // 4))
            self._made["tasks"] = max(self.spark.sparkContext.defaultParallelism, parts)
            self.spark.conf.set("spark.pagelens.tasks", str(self._made["tasks"]))
        return self._made["tasks"]

    def _view(self, name: str) -> DataFrame:
        return self._sql(VIEWS[name])

    def _sql(self, text: str) -> DataFrame:
        text = text.replace("{pixel_grid}", GRID["spark"]).replace("{string}", STRING["spark"])
        text = text.replace("{doc_words}", WORDS["spark"])
        if "{tasks}" in text:
            text = text.replace("{tasks}", str(self._tasks()))
        used = {n: getattr(self, n) for n in set(_NAME.findall(text))}
        return self.spark.sql(text, **used)


def oracle(body: str, *views: str) -> str:
    """DuckDB text of a query over the named views."""
    order: list[str] = []
    for v in views:
        order += [n for n in needs(v) if n not in order]
    parts = []
    for name in order:
        text = VIEWS[name].replace("{pixel_grid}", GRID["duckdb"]).replace("{string}", STRING["duckdb"])
        text = text.replace("{doc_words}", WORDS["duckdb"])
        parts.append(f"{name} AS ({_NAME.sub(r'\1', text).strip()})")
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return "WITH RECURSIVE " + ",\n".join([*parts, body]) if parts else "WITH RECURSIVE " + body
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body

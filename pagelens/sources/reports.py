"""Sidecar reports: JSON documents and partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.session import fresh_path, materialize

REGION = ("region_id bigint, x1 int, y1 int, x2 int, y2 int, det_conf double, label string, src_text string, translation string, "
          "overflowed boolean, route string, residue boolean")
NOTE = "seq bigint, level string, tag string, msg string"
DOCUMENT = (f"page_id bigint, region_count bigint, translated_count bigint, untranslated_count bigint, "
            f"regions array<struct<{REGION.replace(' ', ':').replace(',:', ',')}>>, notes array<struct<{NOTE.replace(' ', ':').replace(',:', ',')}>>")


def write_documents(docs: DataFrame, path: str | None = None) -> str:
    """One JSON document per line, ``doc`` column; returns the folder."""
    path = path or fresh_path(docs.sparkSession, "reports")
    docs.select("doc").write.text(path)
    return path


def read_reports(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flat regions, flat notes, and files with unreadable documents; the files are parsed once for all three."""
    docs = materialize(_documents(spark, path, multi_line).select("page_id", "regions", "notes", "_bad", "file"), "documents")
    good = docs.filter("_bad is null")
    regions = good.select("page_id", F.inline("regions"))
    notes = good.select("page_id", F.inline_outer("notes")).filter("seq is not null")
    return regions, notes, docs.filter("_bad is not null").select("file", "_bad")


def _documents(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    reader = spark.read.schema(DOCUMENT + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    df = reader.option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"),
                     F.col("_metadata.file_size").alias("bytes"))


def run_inventory(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Latest report per page: translated share, file time and size."""
    docs = _documents(spark, path, multi_line).filter("_bad is null")
    newest = docs.groupBy("page_id").agg(F.max(F.struct("modified", "file", "bytes", "translated_count", "region_count")).alias("m"))
    return newest.select(
        "page_id", (F.col("m.translated_count") / F.greatest("m.region_count", F.lit(1))).alias("translated_share"),
        F.date_format("m.modified", "MM-dd HH:mm:ss").alias("modified"), F.col("m.bytes").alias("bytes"))


def write_tables(df: DataFrame, path: str | None = None, by: str = "run_id") -> str:
    """Parquet partitioned by run; re-running a run replaces only its own folder."""
    path = path or fresh_path(df.sparkSession, "tables")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return path

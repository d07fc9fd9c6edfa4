"""Run a bounded stream to its end into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pagelens.session import fresh_path, prepare


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = prepare(spark).readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(stream: DataFrame, stem: str = "stream") -> DataFrame:
    """Append everything available now to a parquet table and return it."""
    spark = stream.sparkSession
    path = fresh_path(spark, stem)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
         .option("checkpointLocation", path + "-progress").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

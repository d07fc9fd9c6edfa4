"""Page images: Spark's image reader, a table of what it could not read, and pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions taken as pages.
EXTENSIONS = (
    "jpg", "jpeg", "jpe", "jfif", "png", "webp", "bmp", "dib", "tif", "tiff", "gif", "ppm", "pgm", "pbm", "avif", "heic", "heif",
)


def read_pages(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """``origin, height, width, nChannels, mode, data`` of every decodable image under ``path``."""
    reader = spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True)
    return reader.load(path).select("image.*")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Files with a page extension that the image reader drops."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    pages = files.filter(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*EXTENSIONS))
    good = read_pages(spark, path).select(F.regexp_replace("origin", "^file:/+", "/").alias("p"))
    return pages.withColumn("p", F.regexp_replace("path", "^file:/+", "/")).join(good, "p", "left_anti").drop("p")


def explode_pixels(images: DataFrame, key: str) -> DataFrame:
    """One row per pixel with RGB (the reader stores BGR) and integer-weighted grey."""
    kind = images.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, y int, x int, r int, g int, b int, grey int"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, h, w, ch, data in zip(pdf[key], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                px = np.frombuffer(data, np.uint8).reshape(h, w, ch).astype(np.int32)
                b, g, r = (px[:, :, min(i, ch - 1)].ravel() for i in range(3))
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                grey = (4899 * r + 9617 * g + 1868 * b + 8192) >> 14
                yield pd.DataFrame({key: k, "y": y, "x": x, "r": r, "g": g, "b": b, "grey": grey})

    return images.select(key, "height", "width", "nChannels", "data").mapInPandas(unpack, schema)


def pack_images(rgb: DataFrame, key: str) -> DataFrame:
    """The inverse: image rows (BGR bytes) from a dense pixel table; an image is one row by nature."""
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    px = F.array_sort(F.collect_list(F.struct("y", "x", F.concat(two("b"), two("g"), two("r")).alias("h"))))
    g = rgb.groupBy(key).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), px.alias("px"))
    data = F.unhex(F.array_join(F.transform("px", lambda p: p["h"]), ""))
    return g.select(key, "height", "width", F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))


def shift_layer(pixels: DataFrame, boxes: DataFrame, frame: DataFrame, keys=("page_id", "region_id")) -> DataFrame:
    """Move a box-local layer to page coordinates and clip it to the page."""
    j = pixels.join(boxes.select(*keys, "x1", "y1"), list(keys)).join(frame.select("page_id", "w", "h"), "page_id")
    moved = j.select(*keys, (F.col("y") + F.col("y1")).alias("y"), (F.col("x") + F.col("x1")).alias("x"), "w", "h")
    return moved.filter("x >= 0 and y >= 0 and x < w and y < h").drop("w", "h")

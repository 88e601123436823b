"""Decoded image files as pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = 1 << 18  # pixels handed to Spark at once


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(image_id, height, width, nChannels, data)`` from PNG, TIFF, JPEG or GIF files."""
    src = spark.read.format("image").option("pathGlobFilter", glob).load(path).select("image.*")
    name = F.element_at(F.split("origin", "/"), -1)
    return src.select(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("image_id"), "height", "width", "nChannels", "data")


def undecodable(images: DataFrame) -> DataFrame:
    """Files the decoder could not read (height -1), to be reported rather than lost."""
    return images.where("height <= 0").select("image_id")


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            px = np.frombuffer(row.data, np.uint8).reshape(row.height * row.width, row.nChannels)
            bgr = px[:, :3] if row.nChannels >= 3 else np.repeat(px[:, :1], 3, axis=1)
            for at in range(0, len(px), _ROWS):
                part = bgr[at:at + _ROWS].astype("int32")
                i = np.arange(at, at + len(part))
                yield pd.DataFrame({"image_id": row.image_id, "y": (i // row.width).astype("int32"),
                                    "x": (i % row.width).astype("int32"),
                                    "r": part[:, 2], "g": part[:, 1], "b": part[:, 0]})


def unpack_pixels(images: DataFrame, skip_undecodable: bool = False) -> DataFrame:
    """``px(image_id, y, x, r, g, b)``; gray images repeat their value. Bytes are stored as BGR.

    A file that could not be decoded is an error, unless it is to be skipped (``undecodable`` lists those).
    """
    key = images.schema["image_id"].dataType.simpleString()
    bad = F.coalesce(F.col("height") <= 0, F.lit(True))
    if skip_undecodable:
        images = images.where(~bad)
    else:
        message = F.concat(F.lit("cannot decode image "), F.coalesce(F.col("image_id").cast("string"), F.lit("null")))
        images = images.withColumn("height", F.when(bad, F.raise_error(message).cast("int")).otherwise(F.col("height")))
    cols = images.select("image_id", "height", "width", "nChannels", "data")
    return cols.mapInPandas(_unpack, f"image_id {key}, y int, x int, r int, g int, b int")


def gray_of(r: Column, g: Column, b: Column) -> Column:
    """Luma with integer weights 19595, 38470, 7471 over 65536, rounded."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def load_gray(spark: SparkSession, path: str, glob: str = "*", skip_undecodable: bool = False) -> DataFrame:
    px = unpack_pixels(read_images(spark, path, glob), skip_undecodable)
    return px.select("image_id", "y", "x", gray_of(F.col("r"), F.col("g"), F.col("b")).cast("int").alias("v"))


def binarise(grid: DataFrame, threshold: int = 127) -> DataFrame:
    """Foreground points of a gray mask: ``v > threshold``."""
    return grid.where(F.col("v") > threshold).select("image_id", "y", "x")

"""Image files as grid tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import LUMA_WEIGHTS


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images by Spark's image source; an unreadable file is a row with ``success`` false."""
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    return images.select("image.*", (F.col("image.height") > 0).alias("success"))


def image_grids(images: DataFrame) -> DataFrame:
    """Brightness grids ``(gid, h, w, y, x, v)``; rounded like 8-bit grey images.

    An unreadable image has no cells; its row stays with the images. An image is cut into its lines before bytes become numbers, so a task holds
    one line at a time, not an exploded image.
    """
    weights = np.array([LUMA_WEIGHTS[c] for c in "bgr"])

    @F.pandas_udf("array<double>")
    def grey(lines: pd.Series, channels: pd.Series) -> pd.Series:
        def one(line, n):
            raw = np.frombuffer(line, np.uint8).reshape(-1, n)
            return raw[:, 0].astype(float) if n == 1 else np.rint(raw[:, :3] @ weights)

        return pd.Series([one(line, n) for line, n in zip(lines, channels)])

    stride = F.col("width") * F.col("nChannels")
    lines = images.filter("height > 0").select(
        F.col("origin").alias("gid"), F.col("height").alias("h"), F.col("width").alias("w"),
        "nChannels", "width", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"),
    ).select("gid", "h", "w", "y", "nChannels", F.substring("data", F.col("y") * stride + 1, stride).alias("line"))
    values = lines.select("gid", "h", "w", "y", grey("line", "nChannels").alias("line"))
    return values.select("gid", "h", "w", "y", F.posexplode("line").alias("x", "v"))

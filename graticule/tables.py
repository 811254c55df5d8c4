"""The tables of the engine: samples, scanline rasters, pixels, markers, graphs.

samples: id, feat array<double>, truelabel (1..), status (bit mask).
scanlines: image, y, line array<double>; one row of pixels per row, so that a raster is as
parallel as it is tall, and what lies side by side in x needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Status bits of samples.
UNKNOWN, TEST, TRAIN, OUTLIER, ERROR, ARTIFICIAL, SUPERVISED, PROPAGATED, PROTOTYPE, CENTROID = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def doubles(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.transform(column, lambda v: v.cast("double"))


def samples(spark: SparkSession, folder: str, test_every: int = 5) -> DataFrame:
    """Embeddings as samples: classes count from 1, every `test_every`th id is for testing, the others for training."""
    e = read(spark, folder, "embeddings")
    status = F.when(F.col("vec_id") % test_every == 0, TEST).otherwise(TRAIN)
    return e.select(F.col("vec_id").alias("id"), doubles("embedding").alias("feat"), (F.col("label") + 1).alias("truelabel"), status.alias("status"))


def scanlines(spark: SparkSession, folder: str, scale: int = 1000) -> DataFrame:
    """Embeddings as an integer raster: x is the dimension, y the vector."""
    e = read(spark, folder, "embeddings")
    line = F.transform("embedding", lambda v: F.round(v.cast("double") * scale))
    return e.select(F.lit("e").alias("image"), F.col("vec_id").alias("y"), line.alias("line"))


def pixels(lines: DataFrame, column: str = "line", name: str = "val") -> DataFrame:
    """One row per pixel."""
    return lines.select("image", "y", F.posexplode(column).alias("x", name))


def components(sm: DataFrame) -> DataFrame:
    """One row per sample and feature: id, truelabel, status, dim, v."""
    return sm.select("id", "truelabel", "status", F.posexplode("feat").alias("dim", "v"))


def has(status: Column, bits: int) -> Column:
    """Any of the bits is set."""
    return status.bitwiseAND(bits) != 0

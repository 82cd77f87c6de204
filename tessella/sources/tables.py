"""Rasters from tables: a scalar or RGBA raster held as one array of floats per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of the RGBA adapter: channel = floor(clamp((v + 0.6) / 1.2, 0, 1) * 255).
CHANNEL_SHIFT, CHANNEL_RANGE = 0.6, 1.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scalar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, vals array<double>, region): a raster row per vector, 64 cells wide."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("embeddings").alias("img"), F.col("vec_id").cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("vals"), F.col("label").cast("long").alias("region"))


def cells(rows: DataFrame) -> DataFrame:
    """(img, y, x, v, region) from a raster of rows."""
    return rows.select("img", "y", F.posexplode("vals").alias("x", "v"), "region")


def scalar_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(scalar_rows(spark, sf_dir))


def rgba_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, r, g, b, a): four floats a cell, 16 cells wide."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("vals"))
    byte = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v + CHANNEL_SHIFT) / CHANNEL_RANGE)) * 255).cast("int")
    pixel = F.transform(
        F.sequence(F.lit(0), (F.size("vals") / 4).cast("int") - 1),
        lambda i: F.struct(i.alias("x"), *[byte(F.get("vals", i * 4 + k)).alias(c) for k, c in enumerate("rgba")]),
    )
    return e.select(F.lit("embeddings").alias("img"), "y", F.explode(pixel).alias("p")).select("img", "y", "p.*")

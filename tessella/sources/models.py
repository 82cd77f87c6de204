"""SRC06-SRC08: a model registry (TOML) as a DataFrame, joined with the files that are there."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# SRC06, fixed values: names, files and sizes of the three models the layers come from. Their files
# are not part of the repository; without them the placeholders are used.
REGISTRY = """
[models.depth_anything]
name = "Depth-Anything V2 Small"
filename = "depth_anything_v2_vits.onnx"
size_mb = 94.4

[models.edge_detection]
name = "DexiNed"
filename = "dexined.onnx"
size_mb = 133.8

[models.segmentation]
name = "AnimeSegment"
filename = "anime_segment.onnx"
size_mb = 168.0
"""
MODEL = "id string, name string, filename string, size_mb double, enabled boolean"


def registry(spark: SparkSession, text: str = REGISTRY) -> DataFrame:
    models = tomllib.loads(text).get("models", {})
    return spark.createDataFrame([(k, m["name"], m["filename"], float(m["size_mb"]), bool(m.get("enabled", True))) for k, m in models.items()], MODEL)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC08: (filename) of the files in a folder that Spark can list; content is not read."""
    found = spark.read.format("binaryFile").load(folder).select("path")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename")).distinct()


def status(models: DataFrame, present: DataFrame) -> DataFrame:
    """JOI10: every model with whether its file is there, by id."""
    there = present.select("filename", F.lit(True).alias("there"))
    return models.join(there, "filename", "left").select("id", F.col("there").isNotNull().alias("downloaded")).orderBy("id")


def missing(models: DataFrame, present: DataFrame) -> DataFrame:
    """JOI09, FIL07, SET03: enabled models without a file."""
    return models.where("enabled").join(present, "filename", "left_anti").select("id")


def total_size(models: DataFrame) -> DataFrame:
    """AGG16."""
    return models.where("enabled").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("size_mb"), 3).alias("size_mb"))

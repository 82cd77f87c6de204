"""Incremental use on streams of rasters that arrive as files of rows (img, y, vals, region).

The reference semantics are those of the batch operators; sums, counts and histograms add up,
so they can be kept by a streaming aggregation, and thresholds follow from the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "img string, y int, vals array<double>, region long"


def read_rows(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def region_totals(stream: DataFrame) -> DataFrame:
    """(img, region, n, total): complete mode; mean = total / n."""
    cells = stream.select("img", "region", F.explode("vals").alias("v"))
    return cells.groupBy("img", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


def histograms(stream: DataFrame) -> DataFrame:
    """(img, bin, n) of values in 0..1: complete mode; feed the result to ``stats.otsu``."""
    cells = stream.select("img", F.explode("vals").alias("v"))
    return cells.groupBy("img", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v"))) * 255 + 0.5).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def drain(result: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """Runs the stream over what is there and returns the state as a table (for tests and
    scheduled runs)."""
    q = result.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)

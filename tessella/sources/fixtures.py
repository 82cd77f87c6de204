"""SRC11: closed-form rasters as DataFrames, one row a pixel, generated by spark.range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, height: int, width: int, img: str = "fixture") -> DataFrame:
    i = spark.range(height * width)
    return i.select(F.lit(img).alias("img"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def _rgb(g: DataFrame, r: Column, gr: Column, b: Column) -> DataFrame:
    byte = lambda c: F.floor(F.greatest(F.lit(0), F.least(F.lit(255), c))).cast("int")
    return g.select("img", "y", "x", byte(r).alias("r"), byte(gr).alias("g"), byte(b).alias("b"), F.lit(255).alias("a"))


def _radius(size: int) -> Column:
    c = size / 2
    dx, dy = (F.col("x") - c) / c, (F.col("y") - c) / c
    return F.sqrt(dx * dx + dy * dy)


def portrait(spark: SparkSession, size: int = 256) -> DataFrame:
    d = _radius(size)
    pick = lambda near, far: F.when(d < 0.6, near * (1 - d / 2)).otherwise(far)
    return _rgb(grid(spark, size, size, "portrait"), pick(220, 40), pick(180, 40), pick(150, 60))


def bands(spark: SparkSession, size: int = 256) -> DataFrame:
    third = size // 3
    pick = lambda a, b, c: F.when(F.col("y") < third, a).when(F.col("y") < 2 * size // 3, b).otherwise(c)
    return _rgb(grid(spark, size, size, "bands"), pick(80, 255, 200), pick(120, 220, 60), pick(200, 180, 60))


def busy(spark: SparkSession, size: int = 256) -> DataFrame:
    v = (F.col("x").bitwiseXOR(F.col("y")) * 7 + (F.col("x") * F.col("y")) % 13) % 256
    d = _radius(size)
    pick = lambda disc, rest: F.when(d * d < 0.25, disc).otherwise(rest)
    return _rgb(grid(spark, size, size, "busy"), pick(220, v), pick(180, F.floor(v / 2)), pick(150, 255 - v))


def low_detail(spark: SparkSession, size: int = 128) -> DataFrame:
    inner = F.col("x").between(size // 3, 2 * size // 3 - 1) & F.col("y").between(size // 3, 2 * size // 3 - 1)
    v = F.when(inner, 200).otherwise(128)
    return _rgb(grid(spark, size, size, "low_detail"), v, v, v)


def high_detail(spark: SparkSession, size: int = 256) -> DataFrame:
    checker = F.when((F.floor(F.col("x") / 8) + F.floor(F.col("y") / 8)) % 2 == 0, 200).otherwise(50)
    v = F.greatest(F.least(checker, F.floor(((F.col("x") + F.col("y")) % 256) / 2)), F.lit(50))
    return _rgb(grid(spark, size, size, "high_detail"), v, v, v)


def gradient(spark: SparkSession, size: int = 128) -> DataFrame:
    return _rgb(grid(spark, size, size, "gradient"), F.col("x") * 255 / size, F.col("y") * 255 / size, (F.col("x") + F.col("y")) * 255 / (2 * size))


def radial_depth(spark: SparkSession, size: int, img: str) -> DataFrame:
    return grid(spark, size, size, img).withColumn("v", F.least(F.lit(1.0), _radius(size)))


def strong_edges(spark: SparkSession, size: int = 128, img: str = "strong_edges") -> DataFrame:
    band = F.col("x").between(size // 4, size // 4 + 2) | F.col("y").between(size // 2, size // 2 + 2)
    return grid(spark, size, size, img).withColumn("v", F.when(F.col("x") == F.col("y"), 0.8).when(band, 0.9).otherwise(0.0))

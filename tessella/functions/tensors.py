"""PRJ12, PRJ17, PRJ19, AGG18, GEO04: tensors for models and their outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The normalisation profiles, mean and deviation per channel.
PROFILES = {
    "unit": ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)),
    "imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
    "half": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5)),
}


@dataclass(frozen=True)
class Scale:
    """From a model's input (height, width) to the original."""

    original: tuple[int, int]
    model: tuple[int, int]

    def normalised(self, x: float, y: float) -> tuple[float, float]:
        """PRJ17: a point of the model's input as fractions of the original."""
        return x * (self.original[1] / self.model[1]) / self.original[1], y * (self.original[0] / self.model[0]) / self.original[0]

    def box(self, x1: float, y1: float, x2: float, y2: float) -> tuple[float, float, float, float]:
        return (*self.normalised(x1, y1), *self.normalised(x2, y2))


def tensor(pixels: DataFrame, size, profile: str = "imagenet") -> DataFrame:
    """(img, shape array<int>, data array<float>): channels, rows, columns in that order. An
    image, of a model's input size, is one row."""
    mean, std = PROFILES[profile]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), ((F.col(c) / 255.0 - mean[k]) / std[k]).alias("v")) for k, c in enumerate("rgb")]))
    flat = pixels.select("img", "y", "x", each.alias("p"))
    packed = flat.groupBy("img").agg(F.sort_array(F.collect_list(F.struct("p.c", "y", "x", "p.v"))).alias("d"))
    return packed.select("img", F.array(*[F.lit(v) for v in (1, 3, *size)]).alias("shape"), F.transform("d", lambda s: s["v"].cast("float")).alias("data"))


def class_argmax(logits: DataFrame) -> DataFrame:
    """AGG18: (img, y, x, c, v): the class with the greatest value, lowest on ties."""
    best = F.min(F.struct((-F.col("v")).alias("m"), "c"))
    return logits.groupBy("img", "y", "x").agg(best.alias("b")).select("img", "y", "x", F.col("b.c").alias("c"), (-F.col("b.m")).alias("v"))


def class_map(classes: DataFrame, size, out) -> DataFrame:
    """GEO04: classes (img, y, x, c, v) at the output's cells, nearest by round(o / scale)."""
    imgs = classes.select("img").distinct()
    at = lambda o, k: F.least(F.floor(o * size[k] / float(out[k]) + 0.5), F.lit(size[k] - 1)).cast("int")
    grid = imgs.select("img", F.explode(F.sequence(F.lit(0), F.lit(out[0] - 1))).alias("oy")).select("img", "oy", F.explode(F.sequence(F.lit(0), F.lit(out[1] - 1))).alias("ox"))
    return grid.withColumn("y", at(F.col("oy"), 0)).withColumn("x", at(F.col("ox"), 1)).join(classes, ["img", "y", "x"]).select("img", F.col("oy").alias("y"), F.col("ox").alias("x"), "c", "v")


def even_bands(n: int) -> list[float]:
    """PRJ19: i / n."""
    return [i / n for i in range(n)]

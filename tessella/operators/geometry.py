"""Resampling and geometry. Row rasters (img, y, vals) are resampled by joining each output row
with the one or two input rows it needs and indexing their arrays; pixel rasters (img, y, x, ...)
are moved by rewriting coordinates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import clamp

PIXEL = ("r", "g", "b", "a")
#: Pixels of a grid that are made from one row.
BLOCK = 1 << 16


def _grid(rows: DataFrame, out_h: int) -> DataFrame:
    """(img, oy) for every image and output row."""
    return rows.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(out_h - 1))).alias("oy"))


def _two_rows(rows: DataFrame, out_h: int, in_h: int, pos: Column) -> DataFrame:
    """(img, oy, ty, top, bottom): the rows floor(pos) and the next, and the fraction."""
    grid = _grid(rows, out_h).withColumn("py", pos).withColumn("y0", F.least(F.floor("py").cast("int"), F.lit(in_h - 1)))
    grid = grid.withColumn("y1", F.least(F.col("y0") + 1, F.lit(in_h - 1))).withColumn("ty", F.col("py") - F.col("y0"))
    top = rows.select("img", F.col("y").alias("y0"), F.col("vals").alias("top"))
    bottom = rows.select("img", F.col("y").alias("y1"), F.col("vals").alias("bottom"))
    return grid.join(top, ["img", "y0"]).join(bottom, ["img", "y1"])


def _bilinear(rows: DataFrame, size, out, at_y: Column, at_x) -> DataFrame:
    two = _two_rows(rows, out[0], size[0], at_y)

    def cell(o: Column) -> Column:
        px = at_x(o)
        x0 = F.least(F.floor(px).cast("int"), F.lit(size[1] - 1))
        x1, tx = F.least(x0 + 1, F.lit(size[1] - 1)), px - x0
        up = F.get("top", x0) * (1 - tx) + F.get("top", x1) * tx
        down = F.get("bottom", x0) * (1 - tx) + F.get("bottom", x1) * tx
        return up * (1 - F.col("ty")) + down * F.col("ty")

    cells = F.transform(F.sequence(F.lit(0), F.lit(out[1] - 1)), cell)
    return two.select("img", F.col("oy").alias("y"), F.posexplode(cells).alias("x", "v"))


def resample_bilinear(rows: DataFrame, size, out) -> DataFrame:
    """GEO01: corner-aligned, position o (in - 1) / (out - 1)."""
    step = [(i - 1) / (o - 1) if o > 1 else 0.0 for i, o in zip(size, out, strict=True)]
    return _bilinear(rows, size, out, F.col("oy") * step[0], lambda o: o * step[1])


def upsample_model(rows: DataFrame, size, out) -> DataFrame:
    """GEO03: origin-aligned, position o in / out, clamped to the last cell."""
    scale = [o / i for i, o in zip(size, out, strict=True)]
    return _bilinear(rows, size, out, clamp(F.col("oy") / scale[0], 0, size[0] - 1), lambda o: clamp(o / scale[1], 0, size[1] - 1))


def resample_nearest(rows: DataFrame, size, out) -> DataFrame:
    """GEO02, and with the class map GEO04: floor((o + 0.5) in / out)."""
    at = lambda o, k: F.least(F.floor((o + 0.5) * size[k] / float(out[k])), F.lit(size[k] - 1)).cast("int")
    grid = _grid(rows, out[0]).withColumn("sy", at(F.col("oy"), 0))
    got = grid.join(rows.select("img", F.col("y").alias("sy"), "vals"), ["img", "sy"])
    cells = F.transform(F.sequence(F.lit(0), F.lit(out[1] - 1)), lambda o: F.get("vals", at(o, 1)))
    return got.select("img", F.col("oy").alias("y"), F.posexplode(cells).alias("x", "v"))


def downsample_nearest(cells: DataFrame, size, out) -> DataFrame:
    """GEO05: the pixel at floor((o + 0.5) in / out). Each input pixel finds the outputs that
    take it, so there is no join."""

    def outputs(at: Column, k: int) -> Column:
        near = F.floor(at * out[k] / float(size[k])).cast("int")
        reach = max(2, math.ceil(out[k] / size[k]) + 1)
        span = F.sequence(F.greatest(near - reach, F.lit(0)), F.least(near + reach, F.lit(out[k] - 1)))
        return F.filter(span, lambda o: F.floor((o + 0.5) * size[k] / float(out[k])) == at)

    hit = cells.withColumn("oy_", F.explode(outputs(F.col("y"), 0))).withColumn("ox_", F.explode(outputs(F.col("x"), 1)))
    return hit.withColumn("y", F.col("oy_")).withColumn("x", F.col("ox_")).drop("oy_", "ox_")


def _covered(cells: DataFrame, at: str, k: int, size, out, support: float, weight) -> DataFrame:
    """The cells, each once for every output `at`_o whose filter covers its position, with the
    filter's weight `at`_w. Plain columns, as functions over arrays are not compiled."""
    scale = size[k] / out[k]
    wide = max(scale, 1.0)
    near = F.floor((F.col(at) + 0.5) / scale).cast("int")
    reach = math.ceil(support * wide / scale) + 1
    span = F.sequence(F.greatest(near - reach, F.lit(0)), F.least(near + reach, F.lit(out[k] - 1)))
    spread = cells.withColumn(f"{at}_o", F.explode(span))
    return spread.withColumn(f"{at}_w", weight(F.abs((F.col(at) + 0.5 - (F.col(f"{at}_o") + 0.5) * scale) / wide))).where(F.col(f"{at}_w") != 0)


def _filtered(cells: DataFrame, size, out, support: float, weight) -> DataFrame:
    """Separable filter resampling of pixels: sums of w v over sums of w."""
    both = _covered(_covered(cells, "y", 0, size, out, support, weight), "x", 1, size, out, support, weight)
    w = F.col("y_w") * F.col("x_w")
    sums = both.groupBy("img", F.col("y_o").alias("y"), F.col("x_o").alias("x")).agg(*[F.sum(w * F.col(c)).alias(c) for c in PIXEL], F.sum(w).alias("w_"))
    return sums.select("img", "y", "x", *[clamp(F.floor(F.col(c) / F.col("w_") + 0.5), 0, 255).cast("int").alias(c) for c in PIXEL])


def downsample_triangle(cells: DataFrame, size, out) -> DataFrame:
    """GEO05: triangle filter, our own definition, rounded half up."""
    return _filtered(cells, size, out, 1.0, lambda d: F.greatest(F.lit(0.0), 1 - d))


def resize_lanczos(cells: DataFrame, size, out) -> DataFrame:
    """GEO06: Lanczos with three lobes, our own definition, rounded half up."""

    def weight(d: Column) -> Column:
        p = d * math.pi
        return F.when(d < 1e-9, 1.0).when(d < 3, F.sin(p) * F.sin(p / 3) * 3 / (p * p)).otherwise(0.0)

    return _filtered(cells, size, out, 3.0, weight)


def max_dimension(size: tuple[int, int], most: int) -> tuple[int, int]:
    """GEO06: the size to shrink to, so that no side is over `most` (0: any)."""
    top = max(size)
    if not most or top <= most:
        return size
    return tuple(max(1, math.floor(s * most / top + 0.5)) for s in size)


def flip(cells: DataFrame, size, horizontal: bool = False, vertical: bool = False) -> DataFrame:
    """GEO10."""
    x = F.lit(size[1] - 1) - F.col("x") if horizontal else F.col("x")
    y = F.lit(size[0] - 1) - F.col("y") if vertical else F.col("y")
    return cells.withColumn("x", x).withColumn("y", y)


def pixel_grid(cells: DataFrame, size) -> DataFrame:
    """(img, y, x) of every pixel of an image of this size. Blocks of pixels are dealt to tasks
    and filled there, as an image is one row until then."""
    n, spark = size[0] * size[1], cells.sparkSession
    blocks = cells.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // BLOCK).cast("long"))).alias("b"))
    if n > BLOCK:
        blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.sequence(F.col("b") * BLOCK, F.least((F.col("b") + 1) * BLOCK, F.lit(n).cast("long")) - 1)
    return blocks.select("img", F.explode(at).alias("i")).select("img", F.expr(f"int(i div {size[1]})").alias("y"), (F.col("i") % size[1]).cast("int").alias("x"))


def on_clear(cells: DataFrame, size) -> DataFrame:
    """The image with the pixels that cells lacks transparent black."""
    filled = pixel_grid(cells, size).join(cells, ["img", "y", "x"], "left")
    return filled.select("img", "y", "x", *[F.coalesce(c, F.lit(0)).alias(c) for c in PIXEL])


def offset(cells: DataFrame, size, dx: float, dy: float) -> DataFrame:
    """GEO08: moved by a fraction of the size, truncated to pixels; what is left behind is clear."""
    mx, my = int(dx * size[1]), int(dy * size[0])
    moved = cells.withColumn("x", F.col("x") + mx).withColumn("y", F.col("y") + my)
    kept = moved.where(F.col("x").between(0, size[1] - 1) & F.col("y").between(0, size[0] - 1))
    return kept if mx == my == 0 else on_clear(kept, size)


def clip(cells: DataFrame, size, x: float, y: float, width: float, height: float) -> DataFrame:
    """GEO09: a fractional rectangle within the image, moved to the origin."""
    x0, y0 = min(int(x * size[1]), size[1] - 1), min(int(y * size[0]), size[0] - 1)
    w, h = min(int(width * size[1]), size[1] - x0), min(int(height * size[0]), size[0] - y0)
    inside = cells.where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))
    return inside.withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def rotated_size(size, degrees: float) -> tuple[int, int]:
    c, s = abs(math.cos(math.radians(degrees))), abs(math.sin(math.radians(degrees)))
    return int(size[1] * s + size[0] * c + 1e-9), int(size[1] * c + size[0] * s + 1e-9)


def rotate(cells: DataFrame, size, degrees: float, compat: bool = True) -> DataFrame:
    """GEO07: inverse map and bilinear taps, truncated; clear outside. With compat the sine and
    cosine of the inverse map lose their signs, as those of the size do. Each input pixel finds the
    outputs that tap it, so there is no join."""
    out = rotated_size(size, degrees)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    if compat:
        c, s = abs(c), abs(s)
    u, v = F.col("x") - size[1] / 2, F.col("y") - size[0] / 2
    reach = abs(c) + abs(s) + 1e-3
    steps = lambda o: F.explode(F.array(*[F.col(o) + k for k in range(math.floor(2 * reach) + 1)]))
    first = lambda at, k: F.ceil(at + out[k] / 2 - reach).cast("int")
    near = cells.select("img", "y", "x", *PIXEL, first(u * s + v * c, 0).alias("oy"), first(u * c - v * s, 1).alias("ox"))
    near = near.withColumn("oy", steps("oy")).where(F.col("oy").between(0, out[0] - 1))
    near = near.withColumn("ox", steps("ox")).where(F.col("ox").between(0, out[1] - 1))
    dx, dy = F.col("ox") - out[1] / 2, F.col("oy") - out[0] / 2
    near = near.withColumn("sx", dx * c + dy * s + size[1] / 2).withColumn("sy", dx * -s + dy * c + size[0] / 2)
    ok = (F.col("sx") >= 0) & (F.col("sx") < size[1]) & (F.col("sy") >= 0) & (F.col("sy") < size[0])

    def share(at: str, source: str, k: int) -> Column:
        low = F.floor(source)
        f = F.col(source) - low
        return F.when(F.col(at) == low, 1 - f).otherwise(0.0) + F.when(F.col(at) == F.least(low + 1, F.lit(size[k] - 1)), f).otherwise(0.0)

    taps = near.where(ok).withColumn("w", share("x", "sx", 1) * share("y", "sy", 0)).where(F.col("w") > 0)
    taps = taps.select("img", F.col("oy").alias("y"), F.col("ox").alias("x"), *[(F.col(p) * F.col("w")).alias(p) for p in PIXEL])
    clear = pixel_grid(cells, out).select("img", "y", "x", *[F.lit(0.0).alias(p) for p in PIXEL])
    sums = taps.unionByName(clear).groupBy("img", "y", "x").agg(*[F.sum(p).alias(p) for p in PIXEL])
    return sums.select("img", "y", "x", *[F.floor(F.col(p) + 5e-7).cast("int").alias(p) for p in PIXEL])


@dataclass(frozen=True)
class ImageState:
    """GEO11: pending flips, rotation and size limit of an image; applied in that order."""

    size: tuple[int, int]
    flip_h: bool = False
    flip_v: bool = False
    rotation: float = 0.0
    most: int = 1024

    def flipped(self, horizontal: bool) -> ImageState:
        return ImageState(self.size, self.flip_h ^ horizontal, self.flip_v ^ (not horizontal), self.rotation, self.most)

    def turned(self, degrees: float) -> ImageState:
        return ImageState(self.size, self.flip_h, self.flip_v, (self.rotation + degrees) % 360.0, self.most)

    def reset(self) -> ImageState:
        return ImageState(self.size, most=self.most)

    def apply(self, cells: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        out, size = flip(cells, self.size, self.flip_h, self.flip_v), self.size
        if abs(self.rotation) > 1e-7:
            out, size = rotate(out, size, self.rotation), rotated_size(size, self.rotation)
        target = max_dimension(size, self.most)
        return (out, size) if target == size else (resize_lanczos(out, size, target), target)


def apply_transforms(cells: DataFrame, size, scale: float = 1.0, rotation: float = 0.0, dx: float = 0.0, dy: float = 0.0, flip_h: bool = False, flip_v: bool = False) -> tuple[DataFrame, tuple[int, int]]:
    """GEO12: scale, rotate, offset, flips; steps that change nothing are left out."""
    if scale != 1.0:
        target = tuple(max(1, int(s * scale)) for s in size)
        cells, size = resize_lanczos(cells, size, target), target
    if rotation:
        cells, size = rotate(cells, size, rotation), rotated_size(size, rotation)
    if dx or dy:
        cells = offset(cells, size, dx, dy)
    return flip(cells, size, flip_h, flip_v), size


def output_size(size: tuple[int, int], target: int, mode: str = "square", custom: tuple[int, int] = (64, 64)) -> tuple[int, int]:
    """PRJ18: (height, width) for the modes square, preserve and custom; at least 8 where it
    follows from the aspect ratio or is custom."""
    if mode == "custom":
        return max(custom[0], 8), max(custom[1], 8)
    if mode == "preserve":
        aspect = size[1] / size[0]
        if aspect >= 1:
            return max(8, math.floor(target / aspect + 0.5)), target
        return target, max(8, math.floor(target * aspect + 0.5))
    return target, target

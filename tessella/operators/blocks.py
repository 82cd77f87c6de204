"""Block reductions: each output cell gathers the input cells of its block. Blocks are
[floor(o s), ceil((o + 1) s)) with s = in / out, so they overlap where s is no integer: an
input cell goes to every block that holds it, then one grouped aggregation follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color


def _blocks(at: Column, size: int, out: int) -> Column:
    """The output positions whose block holds input position `at`."""
    near = F.floor(at * out / float(size)).cast("int")
    candidates = F.sequence(F.greatest(near - 2, F.lit(0)), F.least(near + 2, F.lit(out - 1)))
    s = F.lit(size / float(out))
    return F.filter(candidates, lambda o: (F.floor(o * s) <= at) & (at < F.least(F.ceil((o + 1) * s), F.lit(size))))


def to_blocks(cells: DataFrame, size: tuple[int, int], out: tuple[int, int]) -> DataFrame:
    """Adds oy, ox, a row for each block that holds the cell; size and out are (height, width)."""
    rows = cells.withColumn("oy", F.explode(_blocks(F.col("y"), size[0], out[0])))
    return rows.withColumn("ox", F.explode(_blocks(F.col("x"), size[1], out[1])))


def block_max(cells: DataFrame, value: str, size, out) -> DataFrame:
    """AGG04, from 0 up."""
    return to_blocks(cells, size, out).groupBy("img", "oy", "ox").agg(F.greatest(F.max(value), F.lit(0.0)).alias("v"))


def block_area(cells: DataFrame, size, out) -> DataFrame:
    """AGG03: channel sums over counts, integer division."""
    n = F.count(F.lit(1))
    return to_blocks(cells, size, out).groupBy("img", "oy", "ox").agg(*[F.floor(F.sum(c) / n).cast("int").alias(c) for c in "rgba"])


def block_median(cells: DataFrame, size, out) -> DataFrame:
    """AGG02: median of each Lab channel (l, a, b). Blocks are small, so the built-in median."""
    rows = color.with_lab(cells).select("img", "y", "x", "l_", "a_", "b_")
    return to_blocks(rows, size, out).groupBy("img", "oy", "ox").agg(F.median("l_").alias("l"), F.median("a_").alias("a"), F.median("b_").alias("b"))


def block_mean_weighted(cells: DataFrame, size, out, weight: str | None = None) -> DataFrame:
    """AGG01: weighted mean in Lab, back to bytes; a missing weight is 1, no weight gives black."""
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    rows = color.with_lab(cells.withColumn("w_", w)).select("img", "y", "x", "w_", F.col("a").alias("alpha_"), "l_", "a_", "b_")
    sums = to_blocks(rows, size, out).groupBy("img", "oy", "ox").agg(F.sum("w_").alias("w"), *[F.sum(F.col(c) * F.col("w_")).alias(c) for c in ("l_", "a_", "b_", "alpha_")])
    ok = F.col("w") > 0
    mean = sums.withColumns({c: F.when(ok, F.col(c) / F.col("w")).otherwise(0.0) for c in ("l_", "a_", "b_")})
    alpha = F.when(ok, color.clamp(F.round(F.col("alpha_") / F.col("w")), 0, 255).cast("int")).otherwise(255)
    out = color.with_rgb(mean, ("r", "g", "b"))
    return out.select("img", "oy", "ox", *[F.when(ok, F.col(c)).otherwise(0).alias(c) for c in "rgb"], alpha.alias("a"))

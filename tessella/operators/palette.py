"""Palette search, quantisation, sampling and clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color
from ..sources.palettes import palette_frame

SAMPLE, ROUNDS, TOLERANCE = 16_384, 20, 1e-6
#: Keys of a block of the two-level running sum.
BLOCK = 1 << 16
#: The arithmetic hash of the sampler: (id * A + B) mod M, the same in every SQL dialect.
HASH_A, HASH_B, HASH_M = 48_271, 12_345, 2_147_483_647


LAB = ("l_", "a_", "b_")


def lab_palette(colors) -> list[tuple[float, float, float]]:
    """The palette in Lab, computed once on the driver."""
    out = []
    for rgb in colors:
        light = [s / 12.92 if s <= 0.04045 else ((s + 0.055) / 1.055) ** 2.4 for s in (c / 255 for c in rgb)]
        f = []
        for row, white in zip(color.TO_XYZ, color.WHITE, strict=True):
            t = sum(a * b for a, b in zip(row, light, strict=True)) / white
            f.append(np.cbrt(t) if t > color.EPSILON else (t * color.KAPPA + 16) / 116)
        out.append((float(116 * f[1] - 16), float(500 * (f[0] - f[1])), float(200 * (f[1] - f[2]))))
    return out


def _distances(lab, colors) -> list[Column]:
    lab = tuple(F.col(c) if isinstance(c, str) else c for c in lab)
    return [color.delta_squared(lab, tuple(F.lit(v) for v in entry)) for entry in lab_palette(colors)]


def nearest_index(lab, colors) -> Column:
    """JOI03: the palette is a literal, so there is neither a join nor 32 rows a cell. Lowest
    index on ties. lab: three column names or columns."""
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(_distances(lab, colors))]))["i"]


def furthest_index(lab, colors) -> Column:
    """JOI04: lowest index on ties."""
    return F.array_min(F.array(*[F.struct((-d).alias("d"), F.lit(i).alias("i")) for i, d in enumerate(_distances(lab, colors))]))["i"]


def darkest(colors) -> int:
    """JOI05: index of the least lightness."""
    return min(range(len(colors)), key=lambda i: (lab_palette(colors)[i][0], i))


def entry(index: Column, colors, channel: int) -> Column:
    return F.element_at(F.array(*[F.lit(int(c[channel])) for c in colors]), index + 1)


def quantise(cells: DataFrame, colors) -> DataFrame:
    """CMP06: each pixel (r, g, b) replaced by its nearest entry; an empty palette changes nothing."""
    if not colors:
        return cells
    indexed = color.with_lab(cells).withColumn("idx_", nearest_index(LAB, colors)).drop("l_", "a_", "b_")
    return indexed.withColumns({c: entry(F.col("idx_"), colors, k) for k, c in enumerate("rgb")} | {"a": F.lit(255)}).drop("idx_")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from an integer key, two steps of the arithmetic hash."""
    h = F.pmod(F.pmod(key * HASH_A + HASH_B, F.lit(HASH_M)) * HASH_A, F.lit(HASH_M))
    return (h + 1) / F.lit(float(HASH_M + 1))


def weighted_sample(df: DataFrame, key: Column, weight: Column, n: int = SAMPLE) -> DataFrame:
    """SMP01: n rows without replacement, in proportion to weight: the greatest ln(u) / w
    (Efraimidis and Spirakis), u hashed from the key. A top-n, never a full sort."""
    return df.withColumn("s_", F.log(uniform(key)) / weight).orderBy(F.desc("s_"), key).limit(n).drop("s_")


def uniform_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """SMP02."""
    return df.withColumn("s_", uniform(key)).orderBy("s_", key).limit(n).drop("s_")


def plus_plus_pick(df: DataFrame, distance: str, key: str, u: float) -> DataFrame:
    """CLU03, WIN01: the row at which the running sum of distances, by an integer key, first
    reaches u times the total (the last row if rounding leaves none; nothing of nothing).

    Two levels: the running sum over blocks of BLOCK keys, a row each, names the block, in which
    alone rows are summed one by one. No task orders all rows.
    """
    blocks = df.groupBy(F.floor(F.col(key) / BLOCK).alias("block_")).agg(F.sum(distance).alias("own_"))
    run = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("acc_", F.sum("own_").over(run)).withColumn("most_", F.sum("own_").over(Window.partitionBy()) * u)
    reached = F.when(F.col("acc_") >= F.col("most_"), F.struct("block_", (F.col("acc_") - F.col("own_")).alias("before_"), "most_"))
    last = F.max(F.struct("block_", (F.col("acc_") - F.col("own_")).alias("before_"), "most_"))
    hit = blocks.agg(F.coalesce(F.min(reached), last).alias("h_")).select("h_.*").first()  # one row
    if hit["block_"] is None:
        return df.limit(0)
    inside = df.where(F.floor(F.col(key) / BLOCK) == hit["block_"])
    inside = inside.withColumn("acc_", F.sum(distance).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) + hit["before_"])
    return inside.orderBy(F.col("acc_") < hit["most_"], F.when(F.col("acc_") < hit["most_"], -F.col(key)).otherwise(F.col(key))).limit(1).drop("acc_")


def medoids(df: DataFrame, cluster: str, distance: str, key: str) -> DataFrame:
    """CLU04: per cluster the member nearest to its centroid, the lowest key on ties."""
    return df.groupBy(cluster).agg(F.min(F.struct(F.col(distance).alias("d"), F.col(key).alias("k")))["k"].alias(key))


def kmeans(points: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """CLU02 on the driver, over at most SAMPLE Lab points: k-means++ seeds, at most ROUNDS
    rounds, empty clusters keep their centroid; the medoid of each cluster (first on ties)."""
    if not len(points) or not k:
        return points[:0]
    k, rng = min(k, len(points)), np.random.default_rng(seed)
    centers = [points[rng.integers(len(points))]]
    near = ((points - centers[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = near.sum()
        at = rng.integers(len(points)) if total <= 0 else min(len(points) - 1, int(np.searchsorted(np.cumsum(near), rng.random() * total)))
        centers.append(points[at])
        near = np.minimum(near, ((points - points[at]) ** 2).sum(axis=1))
    c = np.array(centers)
    gap = lambda: ((points[:, None, :] - c[None]) ** 2).sum(axis=2)
    for _ in range(ROUNDS):
        own = gap().argmin(axis=1)
        n = np.bincount(own, minlength=k)
        new = np.stack([np.bincount(own, weights=points[:, d], minlength=k) for d in range(3)], axis=1)
        new = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
        moved = (((new - c) ** 2).sum(axis=1) > TOLERANCE).any()
        c = new
        if not moved:
            break
    d = gap()
    own = d.argmin(axis=1)
    d = np.where(own[:, None] == np.arange(k)[None], d, np.inf)
    has = np.isfinite(d).any(axis=0)
    return np.where(has[:, None], points[d.argmin(axis=0)], c)


def generate(cells: DataFrame, mode: str = "auto", max_colors: int = 32, preset: str = "none", custom=(), key: Column | None = None) -> list[tuple[int, int, int]]:
    """CMP05: the palette as a list. auto and hybrid: chroma-weighted sample, k-means, medoids;
    the sample is bounded, so it may come to the driver."""
    from ..sources.palettes import palette

    if mode == "preset":
        return list(palette(preset))
    if mode == "custom":
        return [tuple(c) for c in custom]
    spark = cells.sparkSession
    key = key if key is not None else F.col("y").cast("long") * 100_003 + F.col("x")
    picked = weighted_sample(color.with_lab(cells).withColumn("k_", key), F.col("k_"), color.chroma_weight(F.col("a_"), F.col("b_")))
    points = picked.orderBy("k_").select("l_", "a_", "b_").toPandas().to_numpy(float)
    centers = kmeans(points, max_colors)
    if not len(centers):
        return []
    frame = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centers)], "i int, l double, a double, b double")
    back = color.with_rgb(frame, lab=("l", "a", "b"), out=("nr", "ng", "nb"))
    return [(x["nr"], x["ng"], x["nb"]) for x in back.orderBy("i").collect()]


def as_frame(spark: SparkSession, colors) -> DataFrame:
    return palette_frame(spark, colors)

"""Robust statistics, normalisers and histogram thresholds over groups of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import clamp

#: Buckets between a group's least and greatest value; exact ranks are taken within one.
BUCKETS = 1024
#: Groups known to have at most so many values, such as the cells of a small image, are sorted by
#: one aggregate; others are bucketed.
LARGE = 1_000_000


def is_large(size: tuple[int, int]) -> bool:
    """Whether an image of (height, width) has more cells than one aggregate should sort."""
    return size[0] * size[1] > LARGE


def _at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], large: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """One row per group with the values at 0-based ranks (columns over `n_`).

    Two passes over the values: counts per bucket (partially aggregated) locate each rank's
    bucket, then only those buckets' values are sorted, each bucket for itself. No task ever
    sorts a whole group. NaN sorts last and has the last bucket. With large=False, which the
    caller answers for, each group is gathered and sorted by one aggregate instead.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("v_")).where("v_ is not null")
    if not large:
        whole = rows.groupBy(*by).agg(F.sort_array(F.collect_list("v_")).alias("s_")).withColumn("n_", F.size("s_")).where("n_ > 0")
        return whole.select(*by, *[F.get("s_", r.cast("int")).alias(k) for k, r in ranks.items()])
    span = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), F.min("v_").alias("lo_"), F.max(F.when(~F.isnan("v_"), F.col("v_"))).alias("hi_"))
    step = (F.col("hi_") - F.col("lo_")) / buckets
    at = F.when(F.isnan("v_"), buckets).when(step > 0, F.least(F.lit(buckets - 1), F.floor((F.col("v_") - F.col("lo_")) / step))).otherwise(0).cast("int")
    join = lambda a, b: a.join(b, by) if by else a.crossJoin(b)  # noqa: E731  b is one row then
    put = join(rows, F.broadcast(span) if not by else span).withColumn("b_", at)
    counts = put.groupBy(*by, "b_").agg(F.count(F.lit(1)).alias("c_"), F.max("n_").alias("n_"))
    order = Window.partitionBy(*by).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before_", F.coalesce(F.sum("c_").over(order), F.lit(0)))
    asked = counts.select(*by, "b_", "c_", "before_", F.explode(F.array(*[F.struct(F.lit(k).alias("name_"), r.cast("long").alias("rank_")) for k, r in ranks.items()])).alias("q"))
    asked = asked.where((F.col("q.rank_") >= F.col("before_")) & (F.col("q.rank_") < F.col("before_") + F.col("c_")))
    asked = asked.select(*by, "b_", F.col("q.name_").alias("name_"), (F.col("q.rank_") - F.col("before_") + 1).alias("place_"))
    inner = put.select(*by, "b_", "v_").join(asked.select(*by, "b_").distinct(), [*by, "b_"], "left_semi")
    inner = inner.withColumn("place_", F.row_number().over(Window.partitionBy(*by, "b_").orderBy("v_")))
    hit = inner.join(asked, [*by, "b_", "place_"])
    pick = [F.max(F.when(F.col("name_") == k, F.col("v_"))).alias(k) for k in ranks]
    return hit.groupBy(*by).agg(*pick)


def rank_of(p: float) -> Column:
    """0-based nearest rank: (n - 1) p, rounded half up."""
    return F.floor((F.col("n_") - 1) * F.lit(float(p)) + 0.5)


def nearest_ranks(df: DataFrame, by: list[str], value: str, ps: dict[str, float], large: bool = True) -> DataFrame:
    """AGG07: nearest-rank percentiles, one column each."""
    return _at_ranks(df, by, value, {k: rank_of(p) for k, p in ps.items()}, large)


def medians(df: DataFrame, by: list[str], value: str, name: str = "med") -> DataFrame:
    """Median, the mean of the two middle values of an even number."""
    two = _at_ranks(df, by, value, {"lo_m": F.floor((F.col("n_") - 1) / 2), "hi_m": F.floor(F.col("n_") / 2)})
    return two.select(*by, ((F.col("lo_m") + F.col("hi_m")) / 2).alias(name))


def mad_stats(df: DataFrame, by: list[str], value: str, large: bool = False) -> DataFrame:
    """AGG05: (by, n, med, mad), two passes. Small groups, such as regions of an image, use the
    built-in median; with large=True no group is gathered in one place."""
    rows = df.select(*by, F.col(value).cast("double").alias("v"))
    if large:
        med = medians(rows, by, "v")
        gap = rows.join(med, by).withColumn("d", F.abs(F.col("v") - F.col("med")))
        n = rows.groupBy(*by).agg(F.count("v").alias("n"))
        return n.join(med, by).join(medians(gap, by, "d", "mad"), by)
    med = rows.groupBy(*by).agg(F.count("v").alias("n"), F.median("v").alias("med"))
    gap = rows.join(med.select(*by, "med"), by)
    return med.join(gap.groupBy(*by).agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad")), by)


def _scaled(df: DataFrame, value: str, low: Column, high: Column, degenerate: Column) -> Column:
    return F.when(high - low < 1e-6, degenerate).otherwise(clamp((F.col(value) - low) / (high - low), 0, 1))


def min_max(df: DataFrame, value: str, by: list[str], out: str = "n") -> DataFrame:
    """NRM01: min-max to [0, 1], the range at least 1e-6."""
    ends = df.groupBy(*by).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    wide = F.greatest(F.col("hi_") - F.col("lo_"), F.lit(1e-6))
    return df.join(ends, by).withColumn(out, clamp((F.col(value) - F.col("lo_")) / wide, 0, 1)).drop("lo_", "hi_")


def percentile_normalised(df: DataFrame, value: str, by: list[str], low: float = 0.05, high: float = 0.95, fallback: str = "min_max", out: str = "n", large: bool = True) -> DataFrame:
    """NRM02 (fallback 'min_max') and NRM03 (fallback 'zero'): scaled between two nearest-rank
    percentiles; where they coincide, min-max or 0."""
    if fallback == "min_max" and high <= low:
        return min_max(df, value, by, out)
    ends = nearest_ranks(df, by, value, {"p_lo": low, "p_hi": high}, large)
    joined = df.join(ends, by)
    if fallback == "zero":
        flat = F.lit(0.0)
    else:
        whole = df.groupBy(*by).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
        joined = joined.join(whole, by)
        flat = clamp((F.col(value) - F.col("lo_")) / F.greatest(F.col("hi_") - F.col("lo_"), F.lit(1e-6)), 0, 1)
    return joined.withColumn(out, _scaled(joined, value, F.col("p_lo"), F.col("p_hi"), flat)).drop("lo_", "hi_", "p_lo", "p_hi")


#: The percentiles between which a depth is shaded.
SHADED = {"p_lo": 0.02, "p_hi": 0.98}


def shading_between(value: str, low: Column, high: Column) -> Column:
    """NRM04, the formula: from [low, high] to [1, -1] (near is bright); 0 if they coincide."""
    n = F.when(high - low < 1e-6, F.lit(0.5)).otherwise(clamp((F.col(value) - low) / (high - low), 0, 1))
    return (F.lit(0.5) - n) * 2


def global_shading(df: DataFrame, value: str, by: list[str], out: str = "shade", large: bool = True) -> DataFrame:
    """NRM04 between the 2nd and 98th percentile."""
    ends = nearest_ranks(df, by, value, SHADED, large)
    return df.join(ends, by).withColumn(out, shading_between(value, F.col("p_lo"), F.col("p_hi"))).drop("p_lo", "p_hi")


def _middle(values: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def gathered_stats(df: DataFrame, by: list[str], value: str, *more: Column) -> DataFrame:
    """(by, n, mean, med, mad, more) of groups known to be small, by one aggregate; more are further
    aggregates."""
    whole = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sort_array(F.collect_list(value)).alias("s_"), *more)
    whole = whole.withColumn("med", _middle(F.col("s_")))
    gaps = F.sort_array(F.transform("s_", lambda v: F.abs(v - F.col("med"))))
    return whole.withColumn("s_", gaps).withColumn("mad", _middle(F.col("s_"))).drop("s_")


def histogram(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """AGG08: (by, bin 0..255, n)."""
    bin_ = F.floor(clamp(F.col(value), 0, 1) * 255 + 0.5).cast("int")
    return df.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame, by: list[str]) -> DataFrame:
    """AGG09: (by, thr): the threshold t / 255 with the greatest between-class variance, lowest
    on ties, 0.6 if there is none. Bins without values can't win: the classes are the same as
    at the last bin with values, which comes first."""
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    w = hist.select(*by, "bin", F.col("n").cast("double").alias("n"))
    w = w.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("bin")).over(up)).withColumn("w", F.sum("n").over(whole)).withColumn("s", F.sum(F.col("n") * F.col("bin")).over(whole))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.when(w1 > 0, w1)
    var = F.when(w1 > 0, F.col("w0") * w1 * gap * gap)
    best = F.min(F.when(var > 0, F.struct((-var).alias("v"), "bin")))["bin"]
    return w.groupBy(*by).agg(F.coalesce(best / 255.0, F.lit(0.6)).alias("thr"))


def background_threshold(df: DataFrame, value: str, by: list[str], use_otsu: bool = True, manual: float = 0.6) -> DataFrame:
    """FIL03: (by, thr), clamped to 0.3..0.85, or the manual one to 0.01..0.99."""
    if not use_otsu:
        return df.select(*by).distinct().withColumn("thr", F.lit(min(max(manual, 0.01), 0.99)))
    return otsu(histogram(df, value, by), by).withColumn("thr", clamp(F.col("thr"), 0.3, 0.85))


def shading_from_stats(value: Column, region: Column, med: Column, mad: Column, least: float) -> Column:
    """Local shading: clamp((median - v) / (1.4826 mad), -1, 1); 0 for flat regions and background."""
    return F.when(region.isNull() | (mad < least) | mad.isNull() | (mad <= 0), 0.0).otherwise(clamp((med - value) / F.when(mad > 0, mad * 1.4826), -1, 1))


def blended_shading(glob: Column, local: Column, flat: Column, weight: float) -> Column:
    """PRJ08."""
    return clamp(glob * weight + local * (1 - weight), -1, 1) * flat


def top_k(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """AGG12, TOP01: the k most frequent keys; ties by the keys themselves."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by).limit(k)

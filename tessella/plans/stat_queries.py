"""Queries on statistics, normalisers, thresholds and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoint import cut
from ..operators import regions, stats, stencil
from ..sources.tables import cells, scalar_cells, scalar_rows, table
from .registry import E, nearest_rank_sql, query, r6, with_

W, MAD_LEAST, GLOBAL_WEIGHT = 64, 0.02, 0.6
#: The 5 x 5 median of e: med5 (y, x, v, region).
MED5 = """hw AS (SELECT max(y) AS h FROM e),
med5 AS (SELECT a.y, a.x, a.region, median(b.v) AS v FROM e a, hw, (SELECT unnest(range(-2, 3)) AS dy) dys, (SELECT unnest(range(-2, 3)) AS dx) dxs, e b
  WHERE b.y = greatest(0, least(h, a.y + dy)) AND b.x = greatest(0, least(63, a.x + dx)) GROUP BY a.y, a.x, a.region)"""
NORM = "ends AS (SELECT min(v) AS lo, max(v) AS hi FROM e), n AS (SELECT y, x, region, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v - lo) / greatest(hi - lo, 1e-6))) AS v FROM e, ends)"


def normalised(spark, d):
    """The scalar raster scaled to 0..1."""
    return stats.min_max(scalar_cells(spark, d), "v", ["img"], "n").select("img", "y", "x", F.col("n").alias("v"), "region")


def _shaded(spark, d):
    rows = scalar_rows(spark, d)
    med = cut(stencil.median5(rows, "v").join(rows.select("img", "y", "region"), ["img", "y"]))  # read by four aggregations
    local = stats.mad_stats(med, ["region"], "v").select("region", "med", "mad")
    both = stats.global_shading(med, "v", ["img"], "glob", stats.is_large((height(spark, d), W))).join(local, "region")
    s = stats.shading_from_stats(F.col("v"), F.col("region"), F.col("med"), F.col("mad"), MAD_LEAST)
    flat = F.when(F.col("mad") < MAD_LEAST, 0.0).otherwise(1.0)
    return both.withColumn("shade", stats.blended_shading(F.col("glob"), s, flat, GLOBAL_WEIGHT))


SHADE_SQL = [
    E,
    MED5,
    "st AS (SELECT region, median(v) AS med FROM med5 GROUP BY region)",
    "mads AS (SELECT m.region, any_value(st.med) AS med, median(abs(m.v - st.med)) AS mad FROM med5 m JOIN st USING (region) GROUP BY m.region)",
    f"pc AS (SELECT {nearest_rank_sql('v', 0.02)} AS lo, {nearest_rank_sql('v', 0.98)} AS hi FROM med5)",
    """sh AS (SELECT m.y, m.x, m.region, m.v,
      (0.5 - CASE WHEN hi - lo < 1e-6 THEN 0.5 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (m.v - lo) / (hi - lo))) END) * 2 AS gl,
      CASE WHEN mad < 0.02 THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (med - m.v) / (1.4826::DOUBLE * mad))) END AS loc,
      CASE WHEN mad < 0.02 THEN 0.0 ELSE 1.0 END AS flat
    FROM med5 m JOIN mads USING (region), pc)""",
]


@query(with_(SHADE_SQL, "SELECT y, x, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, gl * 0.6 + loc * 0.4)) * flat, 6) + 0.0 AS shade FROM sh"))
def shade_regions(spark, d):
    return _shaded(spark, d).select("y", "x", r6("shade").alias("shade"))


@query(with_([E, MED5], "SELECT y, x, round(v, 6) + 0.0 AS m FROM med5"))
def median5(spark, d):
    return stencil.median5(scalar_rows(spark, d)).select("y", "x", r6("m").alias("m"))


@query(with_([E, "s AS (SELECT region, count(*) AS n, median(v) AS med FROM e GROUP BY region)"], "SELECT region, any_value(n) AS n, round(any_value(med), 6) + 0.0 AS med, round(median(abs(v - med)), 6) + 0.0 AS mad FROM e JOIN s USING (region) GROUP BY region"))
def region_mad(spark, d):
    return stats.mad_stats(scalar_cells(spark, d), ["region"], "v").select("region", "n", r6("med").alias("med"), r6("mad").alias("mad"))


@query("WITH s AS (SELECT event_type, count(*) AS n, median(value) AS med FROM events GROUP BY event_type) SELECT event_type, any_value(n) AS n, round(any_value(med), 6) + 0.0 AS med, round(median(abs(value - med)), 6) + 0.0 AS mad FROM events JOIN s USING (event_type) GROUP BY event_type")
def events_mad(spark, d):
    return stats.mad_stats(table(spark, d, "events"), ["event_type"], "value", large=True).select("event_type", "n", r6("med").alias("med"), r6("mad").alias("mad"))


@query("WITH s AS (SELECT l_returnflag, count(*) AS n, median(l_extendedprice) AS med FROM lineitem GROUP BY 1) SELECT l_returnflag, any_value(n) AS n, round(any_value(med), 6) + 0.0 AS med, round(median(abs(l_extendedprice - med)), 6) + 0.0 AS mad FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1")
def lineitem_mad(spark, d):
    return stats.mad_stats(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", large=True).select("l_returnflag", "n", r6("med").alias("med"), r6("mad").alias("mad"))


RANKS = {"p02": 0.02, "p50": 0.5, "p95": 0.95, "p98": 0.98}


@query("SELECT event_type, " + ", ".join(f"round({nearest_rank_sql('value', p)}, 6) + 0.0 AS {k}" for k, p in RANKS.items()) + " FROM events GROUP BY event_type")
def nearest_rank(spark, d):
    return stats.nearest_ranks(table(spark, d, "events"), ["event_type"], "value", RANKS).select("event_type", *[r6(k).alias(k) for k in RANKS])


@query(f"SELECT round({nearest_rank_sql('v', 0.95)}, 6) + 0.0 AS p95 FROM (SELECT l_discount AS v FROM lineitem UNION ALL SELECT l_tax AS v FROM lineitem)")
def union_percentile(spark, d):
    """AGG07 over the union of two layers (SET01)."""
    li = table(spark, d, "lineitem")
    both = li.select(F.col("l_discount").alias("v")).unionAll(li.select(F.col("l_tax").alias("v")))
    return stats.nearest_ranks(both.withColumn("one", F.lit(1)), ["one"], "v", {"p95": 0.95}).select(r6("p95").alias("p95"))


@query(with_([E, NORM], "SELECT y, x, round(v, 6) + 0.0 AS n FROM n"))
def minmax_norm(spark, d):
    return normalised(spark, d).select("y", "x", r6("v").alias("n"))


def _pct_sql(lo: float, hi: float) -> str:
    return with_([E, f"p AS (SELECT {nearest_rank_sql('v', lo)} AS lo, {nearest_rank_sql('v', hi)} AS hi FROM e)"], "SELECT y, x, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v - lo) / (hi - lo))), 6) + 0.0 AS n FROM e, p")


@query(_pct_sql(0.1, 0.9))
def pct_norm(spark, d):
    return stats.percentile_normalised(scalar_cells(spark, d), "v", ["img"], 0.1, 0.9).select("y", "x", r6("n").alias("n"))


@query(_pct_sql(0.05, 0.95))
def pct_norm_5_95(spark, d):
    return stats.percentile_normalised(scalar_cells(spark, d), "v", ["img"], 0.05, 0.95, "zero").select("y", "x", r6("n").alias("n"))


@query(with_([E], "SELECT y, x, 0.0::DOUBLE AS zero, 0.5::DOUBLE AS half FROM e"))
def pct_norm_degenerate(spark, d):
    """NRM02, NRM03 and NRM04 on a constant layer: min-max gives 0, zero gives 0, shading 0."""
    flat = scalar_cells(spark, d).withColumn("v", F.lit(7.0))
    zero = stats.percentile_normalised(flat, "v", ["img"], 0.05, 0.95, "zero", "zero")
    return stats.global_shading(zero, "v", ["img"], "s").select("y", "x", "zero", (F.lit(0.5) - F.col("s") / 2).alias("half"))


@query(with_([E, f"p AS (SELECT {nearest_rank_sql('v', 0.02)} AS lo, {nearest_rank_sql('v', 0.98)} AS hi FROM e)"], "SELECT y, x, round((0.5 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v - lo) / (hi - lo)))) * 2, 6) + 0.0 AS shade FROM e, p"))
def global_shading(spark, d):
    return stats.global_shading(scalar_cells(spark, d), "v", ["img"]).select("y", "x", r6("shade").alias("shade"))


HIST = "h AS (SELECT CAST(floor(v * 255 + 0.5) AS INT) AS bin, count(*) AS n FROM n GROUP BY 1)"


@query(with_([E, NORM, HIST], "SELECT bin, n FROM h"))
def histogram256(spark, d):
    return stats.histogram(normalised(spark, d), "v", ["img"]).select("bin", "n")


OTSU = """c AS (SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) AS w0, CAST(sum(n * bin) OVER (ORDER BY bin) AS DOUBLE) AS s0, CAST(sum(n) OVER () AS DOUBLE) AS w, CAST(sum(n * bin) OVER () AS DOUBLE) AS s FROM h),
v AS (SELECT bin, w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) AS q FROM c WHERE w > w0),
o AS (SELECT coalesce((SELECT bin FROM v WHERE q > 0 ORDER BY q DESC, bin LIMIT 1) / 255.0::DOUBLE, 0.6::DOUBLE) AS thr)"""


@query(with_([E, NORM, HIST, OTSU], "SELECT round(thr, 6) + 0.0 AS thr FROM o"))
def otsu(spark, d):
    return stats.otsu(stats.histogram(normalised(spark, d), "v", ["img"]), ["img"]).select(r6("thr").alias("thr"))


@query(with_([E, NORM, HIST, OTSU], "SELECT y, x, v > greatest(0.3, least(0.85, thr)) AS is_bg FROM n, o"))
def bg_threshold(spark, d):
    return regions.classify_background(normalised(spark, d).drop("region"), (0, W)).select("y", "x", "is_bg")


@query(with_([E, NORM], "SELECT y, x, v > 0.45 AS is_bg FROM n"))
def bg_threshold_manual(spark, d):
    return regions.classify_background(normalised(spark, d).drop("region"), (0, W), use_otsu=False, manual=0.45).select("y", "x", "is_bg")


@query(with_([E, NORM], "SELECT y, x, v < 0.5 AS is_bg FROM n"))
def bg_segmentation(spark, d):
    return regions.classify_background(normalised(spark, d).withColumnRenamed("v", "seg").withColumn("v", F.lit(0.0)), (0, W), seg="seg").select("y", "x", "is_bg")


def height(spark, d) -> int:
    return table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1


REG = f"""hh AS (SELECT max(y) AS h FROM e),
rs AS (SELECT region, avg(v) AS mean, count(*) AS n, bool_or(x = 0 OR y = 0 OR x = 63 OR y = h) AS border FROM e, hh GROUP BY region),
p7 AS (SELECT {nearest_rank_sql("mean", 0.7)} AS p70 FROM rs)"""


@query(with_([E, REG], "SELECT region, round(mean, 6) + 0.0 AS mean, n, border FROM rs"))
def region_stats(spark, d):
    return regions.region_stats(scalar_cells(spark, d), (height(spark, d), W)).select("region", r6("mean").alias("mean"), "n", "border")


@query(with_([E, REG], "SELECT region, mean > p70 AND (border OR n > CAST(floor((h + 1) * 64 * 0.15::DOUBLE) AS INT)) AS is_bg FROM rs, p7, hh"))
def region_background(spark, d):
    return regions.region_background(scalar_cells(spark, d), (height(spark, d), W)).select("region", "is_bg")


@query(with_([E, "s AS (SELECT region, median(v) AS med FROM e GROUP BY region)"], "SELECT region, CASE WHEN median(abs(v - med)) < 0.084 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS flat FROM e JOIN s USING (region) GROUP BY region"))
def flat_mask(spark, d):
    mads = stats.mad_stats(scalar_cells(spark, d), ["region"], "v")
    return mads.select("region", F.when(F.col("mad") < 0.084, 0.0).otherwise(1.0).alias("flat"))


@query("SELECT count(DISTINCT label) AS n FROM embeddings")
def distinct_regions(spark, d):
    return table(spark, d, "embeddings").agg(F.countDistinct("label").alias("n"))


@query(with_([E], "SELECT y, x, round(max(v) OVER () , 6) + 0.0 AS top, round(v / greatest(1.0::DOUBLE, max(v) OVER ()), 6) + 0.0 AS v FROM e"))
def over_maximum(spark, d):
    """AGG10: the fold from 1, and the maximum itself."""
    c = scalar_cells(spark, d).select("img", "y", "x", "v")
    top = c.groupBy("img").agg(F.max("v").alias("top"))
    return stencil.over_max(c, "v", 1.0).join(top, "img").select("y", "x", r6("top").alias("top"), r6("v").alias("v"))


COMPONENTS = f"""WITH RECURSIVE {E}, {NORM}, m AS (SELECT y * 64 + x AS i, y, x FROM n WHERE v >= 0.6),
adj AS (SELECT a.i AS a, b.i AS b FROM m a JOIN m b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.i <> b.i),
reach(i, r) AS (SELECT i, i FROM m UNION SELECT adj.b, reach.r FROM reach JOIN adj ON adj.a = reach.i WHERE reach.r < adj.b)
SELECT CAST(comp AS BIGINT) AS comp, count(*) AS size FROM (SELECT i, min(r) AS comp FROM reach GROUP BY i) GROUP BY comp"""


@query(COMPONENTS)
def components(spark, d):
    """ITR03, AGG15: 8-connected components of the thresholded raster, least cell and size."""
    mask = normalised(spark, d).where("v >= 0.6").select("img", "y", "x")
    named = regions.components(mask)
    return named.groupBy("img", "comp").agg(F.count(F.lit(1)).alias("size")).select((F.shiftright("comp", 32) * W + F.col("comp").bitwiseAND(F.lit((1 << 32) - 1))).alias("comp"), "size")


@query()
def split_regions(spark, d):
    """ITR03: labels cut into connected parts and renumbered."""
    return regions.split_disconnected(cells(scalar_rows(spark, d)).select("img", "y", "x", "region")).groupBy("region").agg(F.count(F.lit(1)).alias("n"))

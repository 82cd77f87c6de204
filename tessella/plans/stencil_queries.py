"""Queries on stencils, edges, resampling and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges, geometry, regions, stats, stencil
from ..sources.tables import rgba_cells, scalar_cells, scalar_rows
from .color_queries import luma_rows
from .registry import E, R, query, r6, with_
from .stat_queries import NORM, W, height, normalised

HE = "hh AS (SELECT max(y) AS h FROM e)"
HR = "hh AS (SELECT max(y) AS h FROM r)"
#: nb: for each cell of e its 3 x 3 neighbours (dy, dx, v) within the image.
NB = "nb AS (SELECT a.y, a.x, a.v AS own, b.y - a.y AS dy, b.x - a.x AS dx, b.v FROM {s} a JOIN {s} b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1)"
SOBEL = """g AS (SELECT y, x, CASE WHEN count(*) = 9 THEN sqrt(pow(sum(v * dx * (2 - abs(dy))), 2) + pow(sum(v * dy * (2 - abs(dx))), 2)) ELSE 0 END AS g FROM nb GROUP BY y, x)"""


@query(with_([E, NB.format(s="e"), SOBEL, "t AS (SELECT max(g) AS t FROM g)"], "SELECT y, x, round(g / t, 6) + 0.0 AS g FROM g, t"))
def sobel(spark, d):
    return stencil.over_max(stencil.sobel(scalar_rows(spark, d)), "g").select("y", "x", r6("g").alias("g"))


LUMA = "lu AS (SELECT y, x, CAST((r * 2126 + g * 7152 + b * 722) // 10000 AS DOUBLE) AS v FROM r)"


@query(with_([R, LUMA, NB.format(s="lu"), SOBEL, "q AS (SELECT list_sort(list(g))[CAST(floor((count(*) - 1) * 0.05::DOUBLE + 0.5) AS INT) + 1] AS lo, list_sort(list(g))[CAST(floor((count(*) - 1) * 0.95::DOUBLE + 0.5) AS INT) + 1] AS hi FROM g)"], "SELECT y, x FROM g, q WHERE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (g - lo) / (hi - lo))) > 0.3"))
def sobel_mask(spark, d):
    return edges.sobel_mask(rgba_cells(spark, d), 0.3).select("y", "x")


@query(with_([R, LUMA, NB.format(s="lu"), SOBEL, "q AS (SELECT list_sort(list(g))[CAST(floor((count(*) - 1) * 0.05::DOUBLE + 0.5) AS INT) + 1] AS lo, list_sort(list(g))[CAST(floor((count(*) - 1) * 0.95::DOUBLE + 0.5) AS INT) + 1] AS hi FROM g)"], "SELECT y, x, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (g - lo) / (hi - lo))), 6) + 0.0 AS v FROM g, q"))
def placeholder_edges(spark, d):
    """STN04: the edge detector without a model."""
    g = stencil.sobel(luma_rows(spark, d), "g", 255.0)
    return stats.percentile_normalised(g, "g", ["img"], 0.05, 0.95, out="v").select("y", "x", r6("v").alias("v"))


@query(with_([E], "SELECT y, x, round(coalesce(abs(lead(v) OVER (PARTITION BY y ORDER BY x) - v), 0), 6) + 0.0 AS dx, round(coalesce(abs(lead(v) OVER (PARTITION BY x ORDER BY y) - v), 0), 6) + 0.0 AS dy FROM e"))
def grad_forward(spark, d):
    return stencil.forward_gradients(scalar_rows(spark, d)).select("y", "x", r6("dx").alias("dx"), r6("dy").alias("dy"))


CENTRAL = "c AS (SELECT y, x, lead(v) OVER (PARTITION BY y ORDER BY x) - lag(v) OVER (PARTITION BY y ORDER BY x) AS gx, lead(v) OVER (PARTITION BY x ORDER BY y) - lag(v) OVER (PARTITION BY x ORDER BY y) AS gy FROM e)"


@query(with_([E, CENTRAL], "SELECT y, x, round(coalesce(1 + abs(gx) + abs(gy), 1), 6) + 0.0 AS g FROM c"))
def grad_central(spark, d):
    return stencil.depth_importance(scalar_rows(spark, d)).select("y", "x", r6("g").alias("g"))


@query(with_([E, CENTRAL, "m AS (SELECT y, x, coalesce(sqrt(gx * gx + gy * gy), 0) AS g FROM c)"], "SELECT y, x, round(g / (SELECT max(g) FROM m), 6) + 0.0 AS g FROM m"))
def grad_magnitude(spark, d):
    return stencil.over_max(stencil.central_magnitude(scalar_rows(spark, d)), "g").select("y", "x", r6("g").alias("g"))


@query(with_([E, NB.format(s="e"), SOBEL, CENTRAL, "s AS (SELECT y, x, g / (SELECT max(g) FROM g) AS g FROM g)", "b AS (SELECT y, x, coalesce(1 + abs(gx) + abs(gy), 1) AS g FROM c)", "k AS (SELECT y, x, b.g / greatest(1, (SELECT max(g) FROM b)) * 0.7::DOUBLE + s.g * 0.3::DOUBLE AS g FROM b JOIN s USING (y, x))"], "SELECT y, x, round(g / greatest(1.0::DOUBLE, (SELECT max(g) FROM k)), 6) + 0.0 AS g FROM k"))
def importance(spark, d):
    rows = scalar_rows(spark, d)
    base = stencil.over_max(stencil.depth_importance(rows), "g", 1.0)
    return stencil.combined_importance(base, stencil.over_max(stencil.sobel(rows), "g")).select("y", "x", r6("g").alias("g"))


@query(with_([E, NB.format(s="e")], "SELECT y, x, round(CASE WHEN max(v) > any_value(own) THEN 0 ELSE any_value(own) END, 6) + 0.0 AS v FROM nb GROUP BY y, x"))
def nms(spark, d):
    return stencil.non_maximum(scalar_rows(spark, d)).select("y", "x", r6("v").alias("v"))


@query(with_([E, NB.format(s="e")], "SELECT y, x, round(avg(v), 6) + 0.0 AS m FROM nb GROUP BY y, x"))
def mean3(spark, d):
    return stencil.mean3(scalar_rows(spark, d)).select("y", "x", r6("m").alias("m"))


@query(with_([E, "q AS (SELECT y, x, CAST(floor((v + 1) * 4) AS DOUBLE) AS v FROM e)", NB.format(s="q")], "SELECT y, x, min(v) <> max(v) AS span FROM nb GROUP BY y, x"))
def label_span(spark, d):
    """STN10 over labels cut from the values."""
    labels = scalar_cells(spark, d).select("img", "y", "x", F.floor((F.col("v") + 1) * 4).cast("double").alias("v"))
    return stencil.spans(stencil.rows_of(labels)).select("y", "x", "span")


MASK = "m AS (SELECT y, x, v FROM n WHERE v >= 0.75)"


def mask(spark, d, least=0.75):
    return normalised(spark, d).where(F.col("v") >= least).select("img", "y", "x")


@query(with_([E, NORM, MASK, NB.format(s="m")], "SELECT y, x FROM nb GROUP BY y, x HAVING count(*) = 1"))
def isolated(spark, d):
    """STN11: the cells that would be dropped."""
    m = mask(spark, d)
    return m.join(stencil.with_neighbour(m), ["img", "y", "x"], "left_anti").select("y", "x")


def _dilate_sql(t: int) -> str:
    offsets = ", ".join(f"({dy}, {dx})" for dy, dx in stencil.stroke(t))
    return with_([E, NORM, HE, MASK], f"SELECT DISTINCT m.y + o.dy AS y, m.x + o.dx AS x FROM m, hh, (VALUES {offsets}) AS o(dy, dx) WHERE m.y + o.dy BETWEEN 0 AND h AND m.x + o.dx BETWEEN 0 AND 63")


def _dilate(t: int):
    def f(spark, d):
        return stencil.spread_mask(mask(spark, d), stencil.stroke(t), height(spark, d), W).select("y", "x")

    f.__name__ = f"dilate_{t}"
    return query(_dilate_sql(t))(f)


dilate_1, dilate_2, dilate_3, dilate_4 = (_dilate(t) for t in (1, 2, 3, 4))


@query(with_([E, NORM], "SELECT y, x, CASE WHEN v >= 0.7 THEN 2 ELSE 1 END AS label FROM n WHERE v >= 0.7 * 0.4::DOUBLE"))
def edge_thresholds(spark, d):
    return edges.thresholds(normalised(spark, d), 0.7).select("y", "x", "label")


@query(f"""WITH RECURSIVE {E}, {NORM}, t AS (SELECT y * 64 + x AS i, y, x, v >= 0.8 AS strong FROM n WHERE v >= 0.55),
adj AS (SELECT a.i AS a, b.i AS b FROM t a JOIN t b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND NOT b.strong),
reach(i) AS (SELECT i FROM t WHERE strong UNION SELECT adj.b FROM reach JOIN adj ON adj.a = reach.i)
SELECT CAST(i // 64 AS INT) AS y, CAST(i % 64 AS INT) AS x FROM reach""")
def hysteresis(spark, d):
    cells = normalised(spark, d)
    return regions.grow(cells.where("v >= 0.8"), cells.where("v >= 0.55 and v < 0.8")).select("y", "x")


CLEAN = f"""WITH RECURSIVE {E}, {NORM}, m AS (SELECT y, x FROM n WHERE v >= 0.8),
br AS (SELECT y, x FROM m UNION SELECT a.y + sign(b.y - a.y), a.x + sign(b.x - a.x) FROM m a JOIN m b ON greatest(abs(b.y - a.y), abs(b.x - a.x)) = 2),
iso AS (SELECT DISTINCT CAST(a.y * 64 + a.x AS INT) AS i, a.y, a.x FROM br a JOIN br b ON greatest(abs(b.y - a.y), abs(b.x - a.x)) = 1),
adj AS (SELECT a.i AS a, b.i AS b FROM iso a JOIN iso b ON greatest(abs(b.y - a.y), abs(b.x - a.x)) = 1),
reach(i, r) AS (SELECT i, i FROM iso UNION SELECT adj.b, reach.r FROM reach JOIN adj ON adj.a = reach.i WHERE reach.r < adj.b),
comp AS (SELECT i, min(r) AS c FROM reach GROUP BY i), big AS (SELECT c FROM comp GROUP BY c HAVING count(*) >= 6)
SELECT CAST(i // 64 AS INT) AS y, CAST(i % 64 AS INT) AS x FROM comp JOIN big USING (c)"""


@query(CLEAN)
def cleanup(spark, d):
    """ITR04, ITR08: gaps bridged, isolated cells and components under 6 dropped."""
    return edges.cleanup(mask(spark, d, 0.8), (height(spark, d), W), 6).select("y", "x")


@query()
def thin(spark, d):
    """ITR02."""
    return edges.thin(mask(spark, d, 0.6), (height(spark, d), W)).select("y", "x")


SPAN = "sp AS (SELECT y, x, min(v) <> max(v) AS outline, max(v) AS mx FROM nb GROUP BY y, x)"


def _classify_sql(mode: str) -> str:
    keep = {"outlines": "outline", "internal": "NOT outline", "both": "true"}[mode]
    return with_([E, NORM, MASK, "q AS (SELECT y, x, CAST(region AS DOUBLE) AS v FROM e)", NB.format(s="q"), SPAN], f"SELECT m.y, m.x FROM m JOIN sp USING (y, x) WHERE {keep}")


def _classify(mode: str):
    def f(spark, d):
        return edges.classify(mask(spark, d), (height(spark, d), W), mode, labels=scalar_cells(spark, d)).select("y", "x")

    f.__name__ = f"classify_{mode}"
    return query(_classify_sql(mode))(f)


classify_outlines, classify_internal, classify_both = (_classify(m) for m in ("outlines", "internal", "both"))


@query(with_([E, NORM, MASK, "q AS (SELECT y, x, CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END AS v FROM n)", NB.format(s="q"), SPAN], "SELECT m.y, m.x FROM m JOIN sp USING (y, x) WHERE outline"))
def classify_segmentation(spark, d):
    return edges.classify(mask(spark, d), (height(spark, d), W), "outlines", seg=normalised(spark, d)).select("y", "x")


@query(with_([E, NORM, MASK, HE], "SELECT y, x FROM m, hh WHERE y = 0 OR x = 0 OR y = h OR x = 63 OR (SELECT count(*) FROM m b WHERE abs(b.y - m.y) + abs(b.x - m.x) = 1) < 4"))
def classify_fallback(spark, d):
    return edges.classify(mask(spark, d), (height(spark, d), W), "internal", warnings=[]).select("y", "x")


BIL = """tp AS (SELECT o.y AS ty, p.x AS tx, {fy} AS fy, {fx} AS fx FROM (SELECT unnest(range(90)) AS y) o, (SELECT unnest(range(45)) AS x) p, hh),
t2 AS (SELECT *, CAST(floor(fy) AS INT) AS y0, least(CAST(floor(fy) AS INT) + 1, h) AS y1, CAST(floor(fx) AS INT) AS x0, least(CAST(floor(fx) AS INT) + 1, 63) AS x1 FROM tp, hh)"""
BIL_OUT = """SELECT CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, round((a.v * (1 - (fx - x0)) + b.v * (fx - x0)) * (1 - (fy - y0)) + (c.v * (1 - (fx - x0)) + e2.v * (fx - x0)) * (fy - y0), 6) + 0.0 AS v
FROM t2 JOIN e a ON a.y = y0 AND a.x = x0 JOIN e b ON b.y = y0 AND b.x = x1 JOIN e c ON c.y = y1 AND c.x = x0 JOIN e e2 ON e2.y = y1 AND e2.x = x1"""


@query(with_([E, HE, BIL.format(fy="o.y * (h / 89.0::DOUBLE)", fx="p.x * (63 / 44.0::DOUBLE)")], BIL_OUT))
def resample_bilinear(spark, d):
    return geometry.resample_bilinear(scalar_rows(spark, d), (height(spark, d), W), (90, 45)).select("y", "x", r6("v").alias("v"))


@query(with_([E, HE, BIL.format(fy="least(o.y / (90.0::DOUBLE / (h + 1)), h)", fx="least(p.x / (45.0::DOUBLE / 64), 63)")], BIL_OUT))
def upsample_model(spark, d):
    return geometry.upsample_model(scalar_rows(spark, d), (height(spark, d), W), (90, 45)).select("y", "x", r6("v").alias("v"))


NEAR = "nr AS (SELECT o.y AS y, p.x AS x, e.region FROM (SELECT unnest(range(90)) AS y) o, (SELECT unnest(range(45)) AS x) p, hh, e WHERE e.y = floor((o.y + 0.5) * (h + 1) / 90.0::DOUBLE) AND e.x = floor((p.x + 0.5) * 64 / 45.0::DOUBLE))"


@query(with_([E, HE, BIL.format(fy="o.y * (h / 89.0::DOUBLE)", fx="p.x * (63 / 44.0::DOUBLE)"), f"bl AS ({BIL_OUT})", NEAR], "SELECT y, x, v, region FROM bl JOIN nr USING (y, x)"))
def resample_layers(spark, d):
    """GEO13: depth bilinear, regions nearest."""
    from .stylise import Layers, resample_layers

    cells = scalar_cells(spark, d)
    near = resample_layers(Layers(depth=cells.select("img", "y", "x", "v"), region=cells.select("img", "y", "x", "region")), (height(spark, d), W), (90, 45))
    return near.depth.join(near.region, ["img", "y", "x"]).select("y", "x", r6("v").alias("v"), "region")


@query(with_([E, HE], "SELECT CAST(o.y AS INT) AS y, CAST(p.x AS INT) AS x, round(e.v, 6) + 0.0 AS v FROM (SELECT unnest(range(90)) AS y) o, (SELECT unnest(range(45)) AS x) p, hh, e WHERE e.y = floor((o.y + 0.5) * (h + 1) / 90.0::DOUBLE) AND e.x = floor((p.x + 0.5) * 64 / 45.0::DOUBLE)"))
def resample_nearest(spark, d):
    return geometry.resample_nearest(scalar_rows(spark, d), (height(spark, d), W), (90, 45)).select("y", "x", r6("v").alias("v"))


@query(with_([R, HR], "SELECT CAST(o.y AS INT) AS y, CAST(p.x AS INT) AS x, r, g, b, a FROM (SELECT unnest(range(90)) AS y) o, (SELECT unnest(range(11)) AS x) p, hh, r WHERE r.y = floor((o.y + 0.5) * (h + 1) / 90.0::DOUBLE) AND r.x = floor((p.x + 0.5) * 16 / 11.0::DOUBLE)"))
def downsample_nearest(spark, d):
    return geometry.downsample_nearest(rgba_cells(spark, d), (height(spark, d), 16), (90, 11)).select("y", "x", "r", "g", "b", "a")


def _filter_sql(oh: int, ow: int, weight: str) -> str:
    s = lambda i, o: f"greatest({i} / {o}.0::DOUBLE, 1.0::DOUBLE)"
    wy = weight.format(d=f"(abs(r.y + 0.5 - (o.y + 0.5) * ((h + 1) / {oh}.0::DOUBLE)) / {s('(h + 1)', oh)})")
    wx = weight.format(d=f"(abs(r.x + 0.5 - (p.x + 0.5) * (16 / {ow}.0::DOUBLE)) / {s('16', ow)})")
    chan = ", ".join(f"CAST(greatest(0, least(255, floor(sum(w * {c}) / sum(w) + 0.5))) AS INT) AS {c}" for c in "rgba")
    return with_(
        [R, HR, f"wy AS (SELECT o.y AS oy, r.y AS ry, {wy} AS w FROM (SELECT unnest(range({oh})) AS y) o, (SELECT DISTINCT y FROM r) r, hh)", f"wx AS (SELECT p.x AS ox, r.x AS rx, {wx} AS w FROM (SELECT unnest(range({ow})) AS x) p, (SELECT DISTINCT x FROM r) r)",
         "k AS (SELECT oy, ox, wy.w * wx.w AS w, r, g, b, a FROM r JOIN wy ON wy.ry = r.y AND wy.w <> 0 JOIN wx ON wx.rx = r.x AND wx.w <> 0)"],
        f"SELECT CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, {chan} FROM k GROUP BY oy, ox",
    )


@query(_filter_sql(50, 8, "greatest(0.0::DOUBLE, 1 - {d})"))
def downsample_triangle(spark, d):
    return geometry.downsample_triangle(rgba_cells(spark, d), (height(spark, d), 16), (50, 8)).select("y", "x", "r", "g", "b", "a")


@query(_filter_sql(50, 8, "CASE WHEN {d} < 1e-9 THEN 1.0::DOUBLE WHEN {d} < 3 THEN sin({d} * pi()) * sin({d} * pi() / 3) * 3 / pow({d} * pi(), 2) ELSE 0 END"))
def resize_lanczos(spark, d):
    return geometry.resize_lanczos(rgba_cells(spark, d), (height(spark, d), 16), (50, 8)).select("y", "x", "r", "g", "b", "a")


@query(with_([R, HR], "SELECT CAST(h - y AS INT) AS y, 15 - x AS x, r, g, b, a FROM r, hh"))
def flip(spark, d):
    return geometry.flip(rgba_cells(spark, d), (height(spark, d), 16), True, True).select("y", "x", "r", "g", "b", "a")


@query(with_([R, HR], "SELECT a.y, a.x, " + ", ".join(f"coalesce(b.{c}, 0) AS {c}" for c in "rgba") + " FROM r a CROSS JOIN hh LEFT JOIN r b ON b.x = a.x - 4 AND b.y = a.y + CAST(trunc(0.1 * (h + 1)) AS INT)"))
def offset(spark, d):
    return geometry.offset(rgba_cells(spark, d), (height(spark, d), 16), 0.25, -0.1).select("y", "x", "r", "g", "b", "a")


@query(with_([R, HR], "SELECT CAST(y - floor(0.2 * (h + 1)) AS INT) AS y, x - 4 AS x, r, g, b, a FROM r, hh WHERE x BETWEEN 4 AND 11 AND y >= floor(0.2 * (h + 1)) AND y < floor(0.2 * (h + 1)) + floor(0.5 * (h + 1))"))
def clip(spark, d):
    return geometry.clip(rgba_cells(spark, d), (height(spark, d), 16), 0.25, 0.2, 0.5, 0.5).select("y", "x", "r", "g", "b", "a")


ROT = """p AS MATERIALIZED (SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, r, g, b, a FROM r), k AS (SELECT cos(radians(30)) AS c, sin(radians(30)) AS s, h + 1 AS ih FROM hh),
z AS (SELECT *, CAST(floor(16 * s + ih * c + 1e-9) AS INT) AS oh, CAST(floor(16 * c + ih * s + 1e-9) AS INT) AS ow FROM k),
o AS (SELECT y, x, (x - ow / 2.0::DOUBLE) * c + (y - oh / 2.0::DOUBLE) * s + 8 AS sx, (x - ow / 2.0::DOUBLE) * -s + (y - oh / 2.0::DOUBLE) * c + ih / 2.0::DOUBLE AS sy, ih FROM z, (SELECT unnest(range(oh)) AS y FROM z) oy, (SELECT unnest(range(ow)) AS x FROM z) ox),
t AS MATERIALIZED (SELECT *, CAST(floor(sx) AS BIGINT) AS x0, CAST(floor(sy) AS BIGINT) AS y0, CAST(ih - 1 AS BIGINT) AS last, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM o WHERE sx >= 0 AND sx < 16 AND sy >= 0 AND sy < ih),
q AS (SELECT t.y, t.x, """ + ", ".join(f"CAST(floor(p00.{c} * (1 - fx) * (1 - fy) + p10.{c} * fx * (1 - fy) + p01.{c} * (1 - fx) * fy + p11.{c} * fx * fy + 5e-7) AS INT) AS {c}" for c in "rgba") + """ FROM t
  LEFT JOIN p p00 ON p00.x = x0 AND p00.y = y0 LEFT JOIN p p10 ON p10.x = least(x0 + 1, 15) AND p10.y = y0 LEFT JOIN p p01 ON p01.x = x0 AND p01.y = least(y0 + 1, last) LEFT JOIN p p11 ON p11.x = least(x0 + 1, 15) AND p11.y = least(y0 + 1, last))"""


@query(with_([R, HR, ROT], "SELECT CAST(o.y AS INT) AS y, CAST(o.x AS INT) AS x, " + ", ".join(f"coalesce(q.{c}, 0) AS {c}" for c in "rgba") + " FROM o LEFT JOIN q ON q.y = o.y AND q.x = o.x"))
def rotate(spark, d):
    return geometry.rotate(rgba_cells(spark, d), (height(spark, d), 16), 30.0).select("y", "x", "r", "g", "b", "a")


#: Centres lie SPACING apart over the whole raster, three in a row of centres.
SPACING = 20
CENTERS = f"c AS (SELECT i * 3 + j AS c, {SPACING // 2} + {SPACING} * i AS cy, {SPACING // 2} + {SPACING} * j AS cx FROM (SELECT unnest(range((h + {SPACING // 2}) // {SPACING})) AS i FROM hh), (SELECT unnest(range(3)) AS j))"


@query(with_([E, HE, CENTERS, "cc AS (SELECT c.*, e.v AS cv FROM c JOIN e ON e.y = cy AND e.x = cx)", f"d AS (SELECT e.y, e.x, c, (v - cv) * (v - cv) + ((e.x - cx) / 64.0::DOUBLE) * ((e.x - cx) / 64.0::DOUBLE) AS d FROM e JOIN cc ON cy BETWEEN e.y - {SPACING} AND e.y + {SPACING} AND cx BETWEEN e.x - {SPACING} AND e.x + {SPACING})", "n AS (SELECT y, x, arg_min(c, round(d, 12) * 100000000 + c / 1e6) AS c FROM d GROUP BY y, x)"], "SELECT CAST(c AS INT) AS region, count(*) AS n, round(avg(y), 6) + 0.0 AS cy, round(avg(x), 6) + 0.0 AS cx FROM n GROUP BY c"))
def slic_assign(spark, d):
    """JOI06, AGG11: one windowed assignment and the centroids' new positions; the centres and
    their windows cover the whole raster."""
    cells = scalar_cells(spark, d)
    feats = cells.select("img", "y", "x", F.array("v", F.col("x") / 64.0).alias("f"))
    rows = spark.range((height(spark, d) - 1 + SPACING // 2) // SPACING).withColumn("j", F.explode(F.array(*map(F.lit, range(3)))))
    c = rows.select((F.col("id") * 3 + F.col("j")).cast("int").alias("c"), *[(F.col(k) * SPACING + SPACING // 2).cast("int").alias(n) for k, n in (("id", "cy"), ("j", "cx"))])
    centers = c.join(feats, (feats["y"] == c["cy"]) & (feats["x"] == c["cx"])).select("img", "c", "cy", "cx", "f")
    near = regions.assign(feats, centers, SPACING)
    return near.groupBy(F.col("c").alias("region")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("cy"), r6(F.avg("x")).alias("cx"))


@query()
def slic(spark, d):
    """CLU01, PRJ11: superpixels of the RGBA raster."""
    c = rgba_cells(spark, d)
    return regions.slic(c, (height(spark, d), 16), k=16).select("y", "x", "region")


@query()
def edge_mask(spark, d):
    """CMP03."""
    edge = normalised(spark, d).select("img", "y", "x", "v")
    return edges.edge_mask(edge, (height(spark, d), W), (40, 24), 0.9).select("y", "x")

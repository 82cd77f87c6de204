"""Queries on colours, palettes and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color
from ..operators import blocks, palette, stencil
from ..sources.palettes import PALETTES, palette_frame, palette_values
from ..sources.tables import rgba_cells, scalar_cells
from .registry import E, R, lab_ctes, palette_ctes, query, r6, rgb_ctes, with_
from .stat_queries import NORM, W, height, normalised

PRESET = "pico8"
COLORS = PALETTES[PRESET]
LAB = lab_ctes("r", "lab")


def lab_cells(spark, d):
    """(y, x, r, g, b, a, l, la, lb)."""
    return color.with_lab(rgba_cells(spark, d), LABS)


LABS = ("l", "la", "lb")


def lab_of(c):
    return tuple(F.col(k) for k in LABS)


@query(with_([R, LAB], "SELECT y, x, round(l, 6) + 0.0 AS l, round(la, 6) + 0.0 AS la, round(lb, 6) + 0.0 AS lb FROM lab"))
def to_lab(spark, d):
    return lab_cells(spark, d).select("y", "x", *[r6(k).alias(k) for k in LABS])


@query(with_([R, LAB, rgb_ctes("lab", "back")], "SELECT y, x, nr AS r, ng AS g, nb AS b FROM back"))
def lab_roundtrip(spark, d):
    return color.with_rgb(lab_cells(spark, d), lab=LABS).select("y", "x", *"rgb")


@query(with_([R, LAB], "SELECT y, x, round(1 + sqrt(la * la + lb * lb), 6) + 0.0 AS w FROM lab"))
def chroma_weight(spark, d):
    return lab_cells(spark, d).select("y", "x", r6(color.chroma_weight(F.col("la"), F.col("lb"))).alias("w"))


@query(with_([R], "SELECT y, x, CAST((r * 2126 + g * 7152 + b * 722) // 10000 AS INT) AS v FROM r"))
def luma(spark, d):
    return rgba_cells(spark, d).select("y", "x", color.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))


@query(with_([R, LAB], "SELECT y, x, round(sqrt(pow(l - 50, 2) + pow(la - 10, 2) + pow(lb + 10, 2)), 6) + 0.0 AS d FROM lab"))
def delta_e(spark, d):
    return lab_cells(spark, d).select("y", "x", r6(color.delta_e(lab_of(None), (F.lit(50.0), F.lit(10.0), F.lit(-10.0)))).alias("d"))


#: A shading value per pixel for the queries: (r - g) / 255.
@query(with_([R, LAB, "s AS (SELECT y, x, la, lb, CASE WHEN abs((r - g) / 255.0::DOUBLE) < 0.001 THEN l ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, l + sign(r - g) * pow(abs((r - g) / 255.0::DOUBLE), 0.8::DOUBLE) * (0.6::DOUBLE * 40))) END AS l FROM lab)", rgb_ctes("s", "o")], "SELECT y, x, nr AS r, ng AS g, nb AS b FROM o"))
def fg_shade(spark, d):
    s = (F.col("r") - F.col("g")) / 255.0
    lit = lab_cells(spark, d).withColumn("l", color.foreground_lightness(F.col("l"), s, 0.6, 0.8, 40.0))
    return color.with_rgb(lit, lab=LABS).select("y", "x", *"rgb")


@query(with_([R, LAB, "s AS (SELECT y, x, greatest(0.0::DOUBLE, least(100.0::DOUBLE, l + -0.08::DOUBLE * 100)) AS l, la * (1 - 0.65::DOUBLE) AS la, lb * (1 - 0.65::DOUBLE) AS lb FROM lab)", rgb_ctes("s", "o")], "SELECT y, x, nr AS r, ng AS g, nb AS b FROM o"))
def bg_treat(spark, d):
    toned = lab_cells(spark, d).withColumns(dict(zip(LABS, color.background_lab(*lab_of(None), 0.65, -0.08), strict=True)))
    return color.with_rgb(toned, lab=LABS).select("y", "x", *"rgb")


@query(with_([R, LAB], "SELECT y, x, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, l - 25)), 6) + 0.0 AS l, round(sqrt(la * la + lb * lb) * cos(atan2(lb, la) + radians(30)), 6) + 0.0 AS la, round(sqrt(la * la + lb * lb) * sin(atan2(lb, la) + radians(30)), 6) + 0.0 AS lb FROM lab"))
def hue_shift(spark, d):
    out = color.shift_lab(*lab_of(None), -25.0, 30.0)
    return lab_cells(spark, d).select("y", "x", *[r6(c).alias(k) for c, k in zip(out, LABS, strict=True)])


@query(with_([R], "SELECT y, x, " + ", ".join(f"CAST(floor({a} * (1 - 0.3::DOUBLE) + {b} * 0.3::DOUBLE + 0.5) AS INT) AS {a}" for a, b in (("r", "g"), ("g", "b"), ("b", "r"))) + " FROM r"))
def blend(spark, d):
    return rgba_cells(spark, d).select("y", "x", *[color.blend(F.col(p), F.col(q), 0.3).alias(p) for p, q in (("r", "g"), ("g", "b"), ("b", "r"))])


HUES = ((15, "RED"), (45, "ORANGE"), (75, "YELLOW"), (105, "YELLOW-GREEN"), (165, "GREEN"), (195, "CYAN"), (255, "BLUE"), (285, "PURPLE"))


def hue_name(h):
    out = F.when((h < 15) | (h >= 345), "RED")
    for top, name in HUES[1:]:
        out = out.when(h < top, name)
    return out.otherwise("MAGENTA")


HSL = """hs AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS mx, least(r, g, b) / 255.0::DOUBLE AS mn FROM r),
hsl AS (SELECT y, x, r, g, b, CASE WHEN mx = mn THEN 0.0::DOUBLE WHEN r >= g AND r >= b THEN (g - b) / 255.0::DOUBLE / (mx - mn) + CASE WHEN g < b THEN 6 ELSE 0 END
  WHEN g >= b THEN (b - r) / 255.0::DOUBLE / (mx - mn) + 2 ELSE (r - g) / 255.0::DOUBLE / (mx - mn) + 4 END * 60 AS h,
  CASE WHEN mx = mn THEN 0.0::DOUBLE ELSE (mx - mn) / CASE WHEN (mx + mn) / 2 > 0.5 THEN 2 - mx - mn ELSE mx + mn END END AS s, (mx + mn) / 2 AS li FROM hs)"""


@query(with_([R, HSL], "SELECT y, x, round(h, 6) + 0.0 AS h, round(s, 6) + 0.0 AS s, round(li, 6) + 0.0 AS li FROM hsl"))
def to_hsl(spark, d):
    h, s, li = color.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))
    return rgba_cells(spark, d).select("y", "x", r6(h).alias("h"), r6(s).alias("s"), r6(li).alias("li"))


@query(with_([R, HSL], "SELECT CASE WHEN h < 15 - 1e-9 OR h >= 345 - 1e-9 THEN 'RED' " + " ".join(f"WHEN h < {t} - 1e-9 THEN '{n}'" for t, n in HUES[1:]) + " ELSE 'MAGENTA' END AS hue, count(*) AS n, count(DISTINCT (r, g, b)) AS colors FROM hsl GROUP BY 1"))
def hsl_hue_counts(spark, d):
    """PRJ13, AGG13; hues within 1e-9 below a bound count as on it."""
    h = color.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))[0] + 1e-9
    return rgba_cells(spark, d).groupBy(hue_name(h).alias("hue")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("r", "g", "b").alias("colors"))


@query(with_([R, HSL], "SELECT hue, string_agg(hex, ' ' ORDER BY hex) AS colors FROM (SELECT DISTINCT CASE WHEN h < 15 - 1e-9 OR h >= 345 - 1e-9 THEN 'RED' " + " ".join(f"WHEN h < {t} - 1e-9 THEN '{n}'" for t, n in HUES[1:]) + " ELSE 'MAGENTA' END AS hue, '#' || printf('%02X%02X%02X', r, g, b) AS hex FROM hsl) GROUP BY hue"))
def hue_colors(spark, d):
    """AGG13: the distinct colours of each hue, of which there are 2^24 at most."""
    h = color.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))[0] + 1e-9
    each = rgba_cells(spark, d).select(hue_name(h).alias("hue"), color.hex_color(F.col("r"), F.col("g"), F.col("b")).alias("hex")).distinct()
    return each.groupBy("hue").agg(F.array_join(F.sort_array(F.collect_list("hex")), " ").alias("colors"))


PAL = palette_ctes(palette_values(PRESET))
DIST = "dist AS (SELECT lab.y, lab.x, lab.a, pal.idx, pal.r, pal.g, pal.b, pow(lab.l - pal.l, 2) + pow(lab.la - pal.la, 2) + pow(lab.lb - pal.lb, 2) AS d FROM lab, pal)"


@query(with_([R, LAB, PAL, DIST], "SELECT y, x, CAST(arg_min(idx, round(d, 9) * 1000000 + idx / 1000.0) AS INT) AS idx FROM dist GROUP BY y, x"))
def nearest_palette(spark, d):
    return lab_cells(spark, d).select("y", "x", palette.nearest_index(lab_of(None), COLORS).alias("idx"))


@query(with_([R, LAB, PAL, DIST], "SELECT y, x, CAST(arg_max(idx, round(d, 9) * 1000000 - idx / 1000.0) AS INT) AS idx FROM dist GROUP BY y, x"))
def furthest_palette(spark, d):
    return lab_cells(spark, d).select("y", "x", palette.furthest_index(lab_of(None), COLORS).alias("idx"))


@query(with_([R, LAB, PAL, DIST, "best AS (SELECT y, x, arg_min(idx, round(d, 9) * 1000000 + idx / 1000.0) AS idx FROM dist GROUP BY y, x)"], "SELECT y, x, r, g, b, 255 AS a FROM best JOIN pal USING (idx)"))
def quantise(spark, d):
    return palette.quantise(rgba_cells(spark, d), COLORS).select("y", "x", "r", "g", "b", "a")


@query("SELECT 1 AS k")
def quantise_empty(spark, d):
    """CMP06: an empty palette changes nothing (AGG17: no byte differs)."""
    before = rgba_cells(spark, d)
    after = palette.quantise(before, ()).select("y", "x", *[F.col(c).alias(f"n{c}") for c in "rgba"])
    differing = before.join(after, ["y", "x"]).where(" or ".join(f"{c} <> n{c}" for c in "rgba")).count()
    return spark.range(1).select(F.lit(1 if differing == 0 else 0).alias("k"))


def _all_palettes() -> str:
    rows = [f"('{name}', {i}, {r}, {g}, {b})" for name, colors in PALETTES.items() for i, (r, g, b) in enumerate(colors)]
    return ", ".join(rows)


@query(f"WITH p AS (SELECT * FROM (VALUES {_all_palettes()}) AS t(name, idx, r, g, b)),\n" + lab_ctes("p", "lab") + "\nSELECT name, CAST(count(*) AS BIGINT) AS n, CAST(arg_min(idx, round(l, 9) * 1000 + idx / 1000000.0) AS INT) AS darkest FROM lab GROUP BY name")
def preset_palettes(spark, d):
    """SRC09, JOI05: size and darkest entry of each preset (the empty one has no row)."""
    parts = [palette_frame(spark, colors).withColumn("name", F.lit(name)) for name, colors in PALETTES.items() if colors]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    l = color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))[0]  # noqa: E741
    return whole.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(l.alias("l"), "idx"))["idx"].alias("darkest"))


@query(with_([R], "SELECT r, g, b, count(*) AS n FROM r WHERE y BETWEEN 10 AND 200 AND x BETWEEN 2 AND 13 GROUP BY r, g, b ORDER BY n DESC, r, g, b LIMIT 8"))
def color_topk(spark, d):
    """AGG12, TOP01, FIL06: the 8 most frequent colours of a window."""
    from ..operators.stats import top_k

    return top_k(rgba_cells(spark, d).where(F.col("y").between(10, 200) & F.col("x").between(2, 13)), ["r", "g", "b"], 8)


@query(with_([R, LAB, f"""s AS (SELECT y, x, ln(((((y * 100003::BIGINT + x) * {palette.HASH_A} + {palette.HASH_B}) % {palette.HASH_M}) * {palette.HASH_A} % {palette.HASH_M} + 1) / {palette.HASH_M + 1}.0::DOUBLE) / (1 + sqrt(la * la + lb * lb)) AS s FROM lab)"""], "SELECT y, x FROM s ORDER BY s DESC, y, x LIMIT 500"))
def weighted_sample(spark, d):
    key = F.col("y").cast("long") * 100_003 + F.col("x")
    return palette.weighted_sample(lab_cells(spark, d), key, color.chroma_weight(F.col("la"), F.col("lb")), 500).select("y", "x")


@query(with_([R, f"s AS (SELECT y, x, (((y * 100003::BIGINT + x) * {palette.HASH_A} + {palette.HASH_B}) % {palette.HASH_M}) * {palette.HASH_A} % {palette.HASH_M} AS s FROM r)"], "SELECT y, x FROM s ORDER BY s, y, x LIMIT 100"))
def uniform_sample(spark, d):
    return palette.uniform_sample(rgba_cells(spark, d), F.col("y").cast("long") * 100_003 + F.col("x"), 100).select("y", "x")


@query(with_([R, LAB, "d AS (SELECT y, x, y * 16 + x AS k, floor((l - 50) * (l - 50) + la * la + lb * lb) AS q FROM lab), a AS (SELECT *, sum(q) OVER (ORDER BY k) AS acc, sum(q) OVER () AS t FROM d)"], "SELECT y, x FROM a WHERE acc >= t * 0.375::DOUBLE ORDER BY k LIMIT 1"))
def kmeans_pp_step(spark, d):
    """CLU03: the pick of k-means++ for a given draw, over integer distances so that the
    running sum has one value in any order of addition."""
    base = lab_cells(spark, d).withColumn("k", F.col("y").cast("long") * 16 + F.col("x"))
    dist = F.floor((F.col("l") - 50) * (F.col("l") - 50) + F.col("la") * F.col("la") + F.col("lb") * F.col("lb"))
    return palette.plus_plus_pick(base.withColumn("q", dist), "q", "k", 0.375).select("y", "x")


@query(with_([R, LAB, PAL, DIST, "n AS (SELECT y, x, arg_min(idx, round(d, 9) * 1000000 + idx / 1000.0) AS c, min(d) AS d FROM dist GROUP BY y, x)"], "SELECT CAST(c AS INT) AS cluster, CAST(arg_min(y * 16 + x, round(d, 9) * 1000000 + (y * 16 + x) / 100000.0) AS BIGINT) AS k FROM n GROUP BY c"))
def medoid(spark, d):
    """CLU04: with palette entries as centroids."""
    near = lab_cells(spark, d).withColumn("cluster", palette.nearest_index(lab_of(None), COLORS))
    gaps = [color.delta_squared(lab_of(None), tuple(F.lit(v) for v in e)) for e in palette.lab_palette(COLORS)]
    rows = near.withColumn("d", F.round(F.element_at(F.array(*gaps), F.col("cluster") + 1), 9)).withColumn("k", F.col("y").cast("long") * 16 + F.col("x"))
    return palette.medoids(rows, "cluster", "d", "k")


@query()
def palette_kmeans(spark, d):
    """CLU02, CMP05: the generated palette."""
    colors = palette.generate(rgba_cells(spark, d), "auto", 16)
    return palette_frame(spark, colors)


# The colormap's polynomial, as in functions.color, nested for SQL.
TURBO = {
    "r": "0.13572138 + v * (4.61539260 + v * (-42.66032258 + v * (132.13108234 + v * (-152.94239396 + v * 59.28637943))))",
    "g": "0.09140261 + v * (2.19418839 + v * (4.84296658 + v * (-14.18503333 + v * (4.27729857 + v * 2.82956604))))",
    "b": "0.10667330 + v * (12.64194608 + v * (-60.58204836 + v * (110.36276771 + v * (-89.90310912 + v * 27.34824973))))",
}


@query(with_([E, NORM], "SELECT y, x, " + ", ".join(f"CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, ({p}) * 255)) + 5e-7) AS INT) AS {c}" for c, p in TURBO.items()) + " FROM n"))
def turbo(spark, d):
    return normalised(spark, d).select("y", "x", *[c.alias(k) for c, k in zip(color.turbo(F.col("v")), "rgb", strict=True)])


@query(with_([E, NORM], "SELECT y, x, CAST(floor(v * 255 + 5e-7) AS INT) AS v FROM n"))
def grayscale(spark, d):
    return normalised(spark, d).select("y", "x", color.gray(F.col("v")).alias("v"))


def _region_color_sql(k: int) -> str:
    return "CASE WHEN region = 9 THEN 30 ELSE [" + ", ".join(str(c[k]) for c in color.REGION_COLORS) + "][CAST((region * 3) % 16 + 1 AS INT)] END"


@query(with_([E], "SELECT y, x, " + ", ".join(f"CAST({_region_color_sql(k)} AS INT) AS {c}" for k, c in enumerate("rgb")) + " FROM e"))
def categorical_colors(spark, d):
    """SNK05: labels (three times the class, so that they wrap) coloured; class 9 is background."""
    label = F.when(F.col("region") != 9, F.col("region") * 3)
    return scalar_cells(spark, d).select("y", "x", *[c.alias(k) for c, k in zip(color.region_color(label), "rgb", strict=True)])


@query(with_([R], "SELECT DISTINCT '#' || printf('%02X%02X%02X', r, g, b) AS hex FROM r"))
def hex_colors(spark, d):
    return rgba_cells(spark, d).select(color.hex_color(F.col("r"), F.col("g"), F.col("b")).alias("hex")).distinct()


BLK = "blk AS (SELECT i.*, bo.o AS oy, bx.o AS ox FROM {src} i, hh, (SELECT unnest(range(40)) AS o) bo, (SELECT unnest(range({ow})) AS o) bx WHERE i.y >= floor(bo.o * ((h + 1) / 40.0::DOUBLE)) AND i.y < ceil((bo.o + 1) * ((h + 1) / 40.0::DOUBLE)) AND i.x >= floor(bx.o * ({w} / {ow}.0::DOUBLE)) AND i.x < ceil((bx.o + 1) * ({w} / {ow}.0::DOUBLE)))"
HR = "hh AS (SELECT max(y) AS h FROM r)"
HE = "hh AS (SELECT max(y) AS h FROM e)"


@query(with_([R, LAB, HR, BLK.format(src="lab", w=16, ow=7), "s AS (SELECT oy, ox, sum(l * (1 + b / 255.0::DOUBLE)) / sum(1 + b / 255.0::DOUBLE) AS l, sum(la * (1 + b / 255.0::DOUBLE)) / sum(1 + b / 255.0::DOUBLE) AS la, sum(lb * (1 + b / 255.0::DOUBLE)) / sum(1 + b / 255.0::DOUBLE) AS lb, sum(a * (1 + b / 255.0::DOUBLE)) / sum(1 + b / 255.0::DOUBLE) AS al FROM blk GROUP BY oy, ox)", rgb_ctes("s", "o")], "SELECT CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, nr AS r, ng AS g, nb AS b, CAST(round(al) AS INT) AS a FROM o"))
def block_mean_weighted(spark, d):
    c = rgba_cells(spark, d).withColumn("w", F.col("b") / 255.0 + 1)
    return blocks.block_mean_weighted(c, (height(spark, d), 16), (40, 7), "w").select("oy", "ox", "r", "g", "b", "a")


@query(with_([R, LAB, HR, BLK.format(src="lab", w=16, ow=7)], "SELECT CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, round(median(l), 6) + 0.0 AS l, round(median(la), 6) + 0.0 AS la, round(median(lb), 6) + 0.0 AS lb FROM blk GROUP BY oy, ox"))
def block_median(spark, d):
    m = blocks.block_median(rgba_cells(spark, d), (height(spark, d), 16), (40, 7))
    return m.select("oy", "ox", r6("l").alias("l"), r6("a").alias("la"), r6("b").alias("lb"))


@query(with_([R, LAB, HR, BLK.format(src="lab", w=16, ow=7), PAL, "m AS (SELECT oy, ox, median(l) AS l, median(la) AS la, median(lb) AS lb FROM blk GROUP BY oy, ox)", "dd AS (SELECT oy, ox, idx, pow(m.l - pal.l, 2) + pow(m.la - pal.la, 2) + pow(m.lb - pal.lb, 2) AS d FROM m, pal)"], "SELECT CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, CAST(arg_min(idx, round(d, 9) * 1000000 + idx / 1000.0) AS INT) AS idx FROM dd GROUP BY oy, ox"))
def palette_mode(spark, d):
    """AGG02 then JOI03: the median colour of each block, snapped to the palette."""
    m = blocks.block_median(rgba_cells(spark, d), (height(spark, d), 16), (40, 7))
    return m.select("oy", "ox", palette.nearest_index((F.col("l"), F.col("a"), F.col("b")), COLORS).alias("idx"))


@query(with_([R, HR, BLK.format(src="r", w=16, ow=7)], "SELECT CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, " + ", ".join(f"CAST(sum({c}) // count(*) AS INT) AS {c}" for c in "rgba") + " FROM blk GROUP BY oy, ox"))
def block_area(spark, d):
    return blocks.block_area(rgba_cells(spark, d), (height(spark, d), 16), (40, 7)).select("oy", "ox", "r", "g", "b", "a")


@query(with_([E, HE, BLK.format(src="e", w=64, ow=24)], "SELECT CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, round(greatest(max(v), 0), 6) + 0.0 AS v FROM blk GROUP BY oy, ox"))
def block_max(spark, d):
    return blocks.block_max(scalar_cells(spark, d), "v", (height(spark, d), W), (40, 24)).select("oy", "ox", r6("v").alias("v"))


def luma_rows(spark, d):
    c = rgba_cells(spark, d).select("img", "y", "x", color.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    return stencil.rows_of(c)

"""Queries on composite operators, sources, tensors and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PRESETS, PaletteConfig, TransformConfig, from_json, to_json
from ..functions import tensors, text
from ..functions.glyphs import GLYPHS
from ..operators import edges, geometry, regions
from ..operators.edges import EdgeConfig
from ..sources import fixtures, models
from ..sources.images import differing
from ..sources.palettes import PALETTES
from ..sources.tables import rgba_cells, scalar_cells, table
from . import stylise
from .registry import E, R, lab_ctes, nearest_rank_sql, query, r6, rgb_ctes, with_
from .stat_queries import MED5, W, height, normalised


def gray_pixels(spark, d):
    """A 64-wide colour raster from the scalar one: (n, 1 - n, 1/2) as bytes."""
    byte = lambda c: F.floor(c * 255).cast("int")
    return normalised(spark, d).select("img", "y", "x", byte(F.col("v")).alias("r"), byte(1 - F.col("v")).alias("g"), F.lit(127).alias("b"), F.lit(255).alias("a"))


def layers(spark, d, region=True):
    n = normalised(spark, d)
    return stylise.Layers(depth=n.select("img", "y", "x", "v"), edge=n.select("img", "y", "x", (1 - F.col("v")).alias("v")), region=n.select("img", "y", "x", "region") if region else None)


FLAT_SQL = with_(
    [
        E.replace("e AS", "e0 AS", 1),
        "ends AS (SELECT min(v) AS lo, max(v) AS hi FROM e0)",
        "e AS (SELECT y, x, region, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v - lo) / greatest(hi - lo, 1e-6))) AS v FROM e0, ends)",
        MED5,
        "st AS (SELECT region, median(v) AS med FROM med5 GROUP BY region)",
        "mads AS (SELECT m.region, any_value(st.med) AS med, median(abs(m.v - st.med)) AS mad FROM med5 m JOIN st USING (region) GROUP BY m.region)",
        f"pc AS (SELECT {nearest_rank_sql('v', 0.02)} AS lo, {nearest_rank_sql('v', 0.98)} AS hi FROM med5)",
        """sh AS (SELECT m.y, m.x, m.region, greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
          (0.5 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, (m.v - lo) / (hi - lo)))) * 2 * 0.6::DOUBLE
          + CASE WHEN mad < 0.02 THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (med - m.v) / (1.4826::DOUBLE * mad))) END * (1 - 0.6::DOUBLE))) * CASE WHEN mad < 0.02 THEN 0.0 ELSE 1.0 END AS s
        FROM med5 m JOIN mads USING (region), pc)""",
        "rs AS (SELECT region, avg(v) AS mean, count(*) AS n, bool_or(x = 0 OR y = 0 OR x = 63 OR y = h) AS border FROM med5, hw GROUP BY region)",
        f"p7 AS (SELECT {nearest_rank_sql('mean', 0.7)} AS p70 FROM rs)",
        "bgr AS (SELECT region, mean > p70 AND (border OR n > CAST(floor((h + 1) * 64 * 0.15::DOUBLE) AS INT)) AS bg FROM rs, p7, hw)",
        "px AS (SELECT e.y, e.x, CAST(floor(e.v * 255) AS INT) AS r, CAST(floor((1 - e.v) * 255) AS INT) AS g, 127 AS b, s, bg FROM e JOIN sh USING (y, x) JOIN bgr ON bgr.region = e.region)",
        lab_ctes("px", "lab"),
        """adj AS (SELECT y, x, r, g, b, s, bg, CASE WHEN bg THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, l + -0.08::DOUBLE * 100)) ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, l + sign(s) * pow(abs(s), 0.8::DOUBLE) * (0.6::DOUBLE * 40))) END AS l,
          CASE WHEN bg THEN la * (1 - 0.65::DOUBLE) ELSE la END AS la, CASE WHEN bg THEN lb * (1 - 0.65::DOUBLE) ELSE lb END AS lb FROM lab)""",
        rgb_ctes("adj", "o"),
    ],
    "SELECT y, x, " + ", ".join(f"CASE WHEN NOT bg AND abs(s) < 0.001 THEN {c} ELSE n{c} END AS {c}" for c in "rgb") + " FROM o",
)


@query(FLAT_SQL)
def depth_to_flat(spark, d):
    """CMP02, CMP01, PRJ06-PRJ08."""
    return stylise.depth_to_flat(gray_pixels(spark, d), (height(spark, d), W), layers(spark, d)).select("y", "x", "r", "g", "b")


LUMA = "lu AS (SELECT y, x, CAST((r * 2126 + g * 7152 + b * 722) // 10000 AS DOUBLE) AS v FROM r)"


@query(with_([R, LUMA, "hh AS (SELECT max(y) + 1 AS h FROM r)", "q AS (SELECT y, x, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 - least(1.0::DOUBLE, sqrt(pow(x - 8, 2) + pow(y - h / 2.0::DOUBLE, 2)) / greatest(1.0::DOUBLE, sqrt(64 + pow(h / 2.0::DOUBLE, 2))) * 0.5)) * 0.7 + (1 - v / 255) * 0.3)) AS d FROM lu, hh)", "k AS (SELECT min(d) AS lo, max(d) AS hi FROM q)"], "SELECT y, x, round((d - lo) / greatest(hi - lo, 1e-6), 6) + 0.0 AS v FROM q, k"))
def placeholder_depth(spark, d):
    """PRJ14, CMP08."""
    found = stylise.analyse(rgba_cells(spark, d), (height(spark, d), 16), edge=False, segmentation=False)
    return found.depth.select("y", "x", r6("v").alias("v"))


@query(with_([R], "SELECT y, x, 1.0::DOUBLE AS v FROM r"))
def placeholder_segmentation(spark, d):
    """PRJ15."""
    return stylise.analyse(rgba_cells(spark, d), (height(spark, d), 16), depth=False, edge=False).seg.select("y", "x", "v")


@query(with_([E, "n AS (SELECT y, x, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - v)) AS v FROM e)"], "SELECT y, x, round(v, 6) + 0.0 AS v FROM n"))
def inverted(spark, d):
    """PRJ16."""
    from ..functions.color import clamp

    return scalar_cells(spark, d).select("y", "x", r6(clamp(1 - F.col("v"), 0, 1)).alias("v"))


@query(with_([R], "SELECT c, CAST(count(*) AS BIGINT) AS n, round(sum(v), 3) + 0.0 AS total FROM (SELECT 0 AS c, (r / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE AS v FROM r UNION ALL SELECT 1, (g / 255.0::DOUBLE - 0.456::DOUBLE) / 0.224::DOUBLE FROM r UNION ALL SELECT 2, (b / 255.0::DOUBLE - 0.406::DOUBLE) / 0.225::DOUBLE FROM r) GROUP BY c"))
def tensor_channels(spark, d):
    """PRJ12: the tensor, summed by channel (values are floats)."""
    h = height(spark, d)
    t = tensors.tensor(rgba_cells(spark, d), (h, 16))
    flat = t.select(F.posexplode("data").alias("i", "v"))
    return flat.groupBy(F.floor(F.col("i") / (h * 16)).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.col("v").cast("double")), 3) + 0.0).alias("total"))


LOGITS = "lg AS (SELECT y, x // 4 AS x, x % 4 AS c, v FROM e)"


@query(with_([E, LOGITS], "SELECT y, CAST(x AS INT) AS x, CAST(arg_max(c, v) AS INT) AS c, round(max(v), 6) + 0.0 AS v FROM lg GROUP BY y, x"))
def class_argmax(spark, d):
    """AGG18: four classes a cell."""
    return tensors.class_argmax(logits(spark, d)).select("y", "x", "c", r6("v").alias("v"))


def logits(spark, d):
    return scalar_cells(spark, d).select("img", "y", F.floor(F.col("x") / 4).cast("int").alias("x"), (F.col("x") % 4).cast("int").alias("c"), "v")


@query(with_([E, LOGITS, "hh AS (SELECT max(y) + 1 AS h FROM e)", "k AS (SELECT y, x, arg_max(c, v) AS c FROM lg GROUP BY y, x)"], "SELECT CAST(o.y AS INT) AS y, CAST(p.x AS INT) AS x, CAST(c AS INT) AS c FROM (SELECT unnest(range(120)) AS y) o, (SELECT unnest(range(40)) AS x) p, hh, k WHERE k.y = least(floor(o.y * h / 120.0::DOUBLE + 0.5), h - 1) AND k.x = least(floor(p.x * 16 / 40.0::DOUBLE + 0.5), 15)"))
def class_map(spark, d):
    """GEO04."""
    return tensors.class_map(tensors.class_argmax(logits(spark, d)), (height(spark, d), 16), (120, 40)).select("y", "x", "c")


def _files(spark):
    return spark.createDataFrame([("dexined.onnx",), ("other.bin",)], "filename string")


_MODELS = "m AS (SELECT * FROM (VALUES ('depth_anything', 'depth_anything_v2_vits.onnx', 94.4::DOUBLE), ('edge_detection', 'dexined.onnx', 133.8::DOUBLE), ('segmentation', 'anime_segment.onnx', 168.0::DOUBLE)) AS m(id, filename, size_mb)), f AS (SELECT * FROM (VALUES ('dexined.onnx'), ('other.bin')) AS f(filename))"


@query(f"WITH {_MODELS} SELECT id FROM m ANTI JOIN f USING (filename)")
def missing_models(spark, d):
    return models.missing(models.registry(spark), _files(spark))


@query(f"WITH {_MODELS} SELECT id, f.filename IS NOT NULL AS downloaded FROM m LEFT JOIN f USING (filename) ORDER BY id")
def model_status(spark, d):
    return models.status(models.registry(spark), _files(spark))


@query(f"WITH {_MODELS} SELECT count(*) AS n, round(sum(size_mb), 3) AS size_mb FROM m")
def model_size(spark, d):
    return models.total_size(models.registry(spark))


@query("SELECT * FROM (VALUES ('absent', false), ('nation', true), ('region', true)) AS f(id, downloaded)")
def model_files(spark, d):
    """SRC08, JOI10: files looked for in a real folder, that of the tables."""
    wanted = spark.createDataFrame([(n, n, f"{n}.parquet", 1.0, True) for n in ("region", "nation", "absent")], models.MODEL)
    return models.status(wanted, models.files(spark, f"{d}/*n.parquet"))


_BOX = ["v[1] * 320 + 320", "v[2] * 240 + 240", "v[3] * 320 + 320", "v[4] * 240 + 240"]


@query("SELECT vec_id, " + ", ".join(f"round((CAST({b.split(' ')[0].replace('v', 'embedding')} AS DOUBLE) * {m} + {m}) * ({o} / {i}.0::DOUBLE) / {o}, 6) + 0.0 AS {c}" for b, m, o, i, c in zip(_BOX, (320, 240, 320, 240), (1920, 1080, 1920, 1080), (640, 480, 640, 480), ("x1", "y1", "x2", "y2"), strict=True)) + " FROM embeddings")
def scaled_boxes(spark, d):
    """PRJ17: boxes in a model's input (four floats of a vector) as fractions of the original."""
    v = lambda k, half: F.get("embedding", F.lit(k)).cast("double") * half + half
    box = tensors.Scale((1080, 1920), (480, 640)).box(v(0, 320), v(1, 240), v(2, 320), v(3, 240))
    return table(spark, d, "embeddings").select("vec_id", *[r6(b).alias(c) for b, c in zip(box, ("x1", "y1", "x2", "y2"), strict=True)])


_SIZES = [(h, w, t) for h, w in ((480, 640), (640, 480), (100, 100), (9, 1000), (1000, 9)) for t in (16, 64)]


@query(f"""WITH s AS (SELECT * FROM (VALUES {', '.join(map(str, _SIZES))}) AS s(h, w, t))
SELECT h, w, t, 'square' AS mode, t AS oh, t AS ow FROM s UNION ALL
SELECT h, w, t, 'preserve', CASE WHEN w >= h THEN greatest(8, CAST(floor(t / (w / h::DOUBLE) + 0.5) AS INT)) ELSE t END, CASE WHEN w >= h THEN t ELSE greatest(8, CAST(floor(t * (w / h::DOUBLE) + 0.5) AS INT)) END FROM s UNION ALL
SELECT h, w, t, 'custom', greatest(8, t // 4), greatest(8, t * 2) FROM s""")
def output_sizes(spark, d):
    """PRJ18."""
    rows = [(h, w, t, m, *geometry.output_size((h, w), t, m, (t // 4, t * 2))) for h, w, t in _SIZES for m in ("square", "preserve", "custom")]
    return spark.createDataFrame(rows, "h int, w int, t int, mode string, oh int, ow int")


@query("SELECT CAST(i AS INT) AS i, i / 12.0::DOUBLE AS band FROM (SELECT unnest(range(12)) AS i)")
def even_bands(spark, d):
    """PRJ19."""
    return spark.createDataFrame(list(enumerate(tensors.even_bands(12))), "i int, band double")


@query("SELECT * FROM (VALUES ('Game Boy Style', 48, 'nearest', 'preset', 4), ('Portrait - Detailed', 64, 'weighted', 'auto', 32), ('Portrait - Minimal', 32, 'weighted', 'auto', 12)) AS p(name, output_size, method, palette_mode, max_colors)")
def presets(spark, d):
    """SRC04, SRC10, SNK06: the built-in presets, written as JSON and read again by Spark."""
    rows = spark.createDataFrame([(to_json(from_json(to_json(p))),) for p in PRESETS], "j string")
    p = rows.select(F.from_json("j", "name string, transform struct<output_size int, method string>, palette struct<mode string, max_colors int>").alias("p"))
    return p.select("p.name", "p.transform.output_size", "p.transform.method", F.col("p.palette.mode").alias("palette_mode"), "p.palette.max_colors")


@query("SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN disc THEN 220 ELSE v END AS r, CASE WHEN disc THEN 180 ELSE v // 2 END AS g, CASE WHEN disc THEN 150 ELSE 255 - v END AS b FROM (SELECT y, x, CAST((xor(x, y) * 7 + (x * y) % 13) % 256 AS INT) AS v, pow((x - 32) / 32.0::DOUBLE, 2) + pow((y - 32) / 32.0::DOUBLE, 2) < 0.25 AS disc FROM (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x))")
def fixture_busy(spark, d):
    """SRC11."""
    return fixtures.busy(spark, 64).select("y", "x", "r", "g", "b")


@query("SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(floor(x * 255 / 64.0::DOUBLE) AS INT) AS r, CAST(floor(y * 255 / 64.0::DOUBLE) AS INT) AS g, CAST(floor((x + y) * 255 / 128.0::DOUBLE) AS INT) AS b FROM (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x)")
def fixture_gradient(spark, d):
    return fixtures.gradient(spark, 64).select("y", "x", "r", "g", "b")


_GLYPH_ROWS = ", ".join(f"('{ch if ch != chr(39) else chr(39) * 2}', {sum(row << (6 - k) * 5 for k, row in enumerate(bits))})" for ch, bits in GLYPHS.items())


@query(f"WITH g AS (SELECT * FROM (VALUES {_GLYPH_ROWS}) AS g(ch, bits)), s AS (SELECT n_nationkey AS line, upper(substr(n_name, CAST(i + 1 AS BIGINT), 1)) AS ch, i FROM nation, (SELECT unnest(range(16)) AS i) WHERE i < length(n_name)) SELECT line, CAST(4 + k // 5 AS INT) AS y, CAST(6 + i * 6 + k % 5 AS INT) AS x FROM s JOIN g USING (ch), (SELECT unnest(range(35)) AS k) WHERE (i = 0 OR 6 + i * 6 + 5 <= 60) AND (bits >> (34 - k)) & 1 = 1 AND 6 + i * 6 + k % 5 < 60")
def draw_text(spark, d):
    """SNK04: the nations' names, cut at 60 pixels."""
    lines = table(spark, d, "nation").select(F.col("n_nationkey").alias("line"), F.col("n_name").alias("text"), F.lit(4).alias("y0"), F.lit(6).alias("x0"), F.lit(60).alias("max_x"))
    return text.draw(lines, text.glyph_frame(spark), 16)


@query()
def contact_sheet(spark, d):
    """SNK03."""
    img = fixtures.gradient(spark, 32)
    rows = [text.SheetRow("Input", (32, 32), "gradient", "gradient 32 x 32"), text.SheetRow("Depth"), text.SheetRow("Settings", settings=(("k", "32"), ("mode", "auto")))]
    return text.contact_sheet(spark, img, rows, 96)[0]


@query(with_([R], "SELECT CAST(count(*) FILTER (WHERE r <> 255 - r) + count(*) FILTER (WHERE g <> 255 - g) AS BIGINT) AS n FROM r"))
def byte_difference(spark, d):
    """AGG17: between the raster and its copy with red and green inverted."""
    a = rgba_cells(spark, d)
    return differing(a, a.withColumn("r", 255 - F.col("r")).withColumn("g", 255 - F.col("g")))


FEATURES = with_(
    [R, lab_ctes("r", "lab"), "hh AS (SELECT greatest(max(y) + 1, 16) AS big FROM r)",
     "gr AS (SELECT *, coalesce(abs(lead(l) OVER (PARTITION BY y ORDER BY x) - l), 0) AS dx, coalesce(abs(lead(l) OVER (PARTITION BY x ORDER BY y) - l), 0) AS dy FROM lab)",
     f"p AS (SELECT greatest({nearest_rank_sql('v', 0.95)}, 1e-6) AS p FROM (SELECT dx AS v FROM gr UNION ALL SELECT dy AS v FROM gr))"],
    "SELECT y, x, round(l / 50 - 1, 6) + 0.0 AS f0, round(la / 128, 6) + 0.0 AS f1, round(lb / 128, 6) + 0.0 AS f2, round(least(dx / p, 1), 6) + 0.0 AS f4, round(least(dy / p, 1), 6) + 0.0 AS f5, round((x / CAST(big AS DOUBLE) * 2 - 1) * 0.7::DOUBLE, 6) + 0.0 AS f8, round((y / CAST(big AS DOUBLE) * 2 - 1) * 0.7::DOUBLE, 6) + 0.0 AS f9 FROM gr, p, hh",
)


@query(FEATURES)
def slic_features(spark, d):
    """PRJ11, without depth (features 3, 6 and 7 are 0)."""
    f = regions.features(rgba_cells(spark, d), (height(spark, d), 16))
    return f.select("y", "x", *[r6(F.get("f", F.lit(k))).alias(f"f{k}") for k in (0, 1, 2, 4, 5, 8, 9)])


@query()
def dither(spark, d):
    """ITR06."""
    return edges.dither(rgba_cells(spark, d), (height(spark, d), 16), (40, 8), PALETTES["pico8"]).select("y", "x", "r", "g", "b", "a")


@query()
def paint_edges(spark, d):
    """ITR05, ITR07, STN12, STN14 over the RGBA raster."""
    px = rgba_cells(spark, d)
    mask = edges.sobel_mask(px, 0.6)
    return edges.paint(px, mask, mask, (height(spark, d), 16), EdgeConfig(style="contrast", thickness=2, anti_alias=True), PALETTES["pico8"]).select("y", "x", "r", "g", "b", "a")


@query()
def image_state(spark, d):
    """GEO11, GEO06: flips, a quarter turn and the size limit."""
    state = geometry.ImageState((height(spark, d), 16), most=100).flipped(True).turned(450.0)
    return state.apply(rgba_cells(spark, d))[0].select("y", "x", "r", "g", "b", "a")


@query()
def transforms(spark, d):
    """GEO12."""
    return geometry.apply_transforms(rgba_cells(spark, d), (height(spark, d), 16), 0.5, 0.0, 0.1, 0.0, True, False)[0].select("y", "x", "r", "g", "b", "a")


def _stylised(method: str, **edge):
    def f(spark, d):
        out = stylise.run(gray_pixels(spark, d), (height(spark, d), W), (32, 32), layers(spark, d), TransformConfig(method=method), edge=EdgeConfig(**edge), colors=PaletteConfig("preset", preset="pico8"))
        return out.image.select("y", "x", "r", "g", "b", "a")

    f.__name__ = f"stylise_{method}"
    return query()(f)


stylise_palette = _stylised("palette")
stylise_dither = _stylised("dither", style="black", thickness=2)
stylise_weighted = _stylised("weighted", mode="both", style="contrast", anti_alias=True)
stylise_nearest = _stylised("nearest", mode="internal")
stylise_bilinear = _stylised("bilinear", mode="none")

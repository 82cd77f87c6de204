"""SNK03, SNK04: text drawn with a bitmap font and contact sheets, as pixel DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .glyphs import GLYPHS

LABEL_HEIGHT, SUBTITLE_HEIGHT, GAP, LINE, LEAST_WIDTH = 22, 14, 8, 11, 64
BACKGROUND, LABEL, PLACEHOLDER, SETTINGS = (24, 24, 28), (40, 40, 46), (44, 44, 52), (28, 28, 34)
INK, INK_SMALL = (235, 235, 240), (160, 160, 170)
ADVANCE, GLYPH_W, GLYPH_H = 6, 5, 7


def glyph_frame(spark: SparkSession) -> DataFrame:
    """(ch, bits): bit (6 - row) * 5 + 4 - column of a character's 35."""
    rows = [(ch, sum(row << (GLYPH_H - 1 - k) * GLYPH_W for k, row in enumerate(bits))) for ch, bits in GLYPHS.items()]
    return spark.createDataFrame(rows, "ch string, bits long")


def draw(lines: DataFrame, glyphs: DataFrame, most: int = 64) -> DataFrame:
    """The set pixels (line, y, x) of texts (line, text, y0, x0, max_x): characters are
    upper-cased, unknown ones blank; the text stops once a glyph would start too near max_x."""
    chars = lines.select("line", "y0", "x0", "max_x", F.posexplode(F.split(F.substring("text", 1, most), "")).alias("i", "c"))
    left = F.col("x0") + F.col("i") * ADVANCE
    fits = (F.col("i") == 0) | (left + GLYPH_W <= F.col("max_x"))
    ascii_upper = F.translate("c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    put = chars.where(fits).withColumn("ch", ascii_upper).withColumn("left", left).join(F.broadcast(glyphs), "ch")
    cells = put.select("line", "y0", "left", "max_x", "bits", F.explode(F.sequence(F.lit(0), F.lit(GLYPH_W * GLYPH_H - 1))).alias("k"))
    on = cells.where(F.expr("(shiftright(bits, 34 - k) & 1) = 1"))
    out = on.select("line", (F.col("y0") + F.floor(F.col("k") / GLYPH_W)).cast("int").alias("y"), (F.col("left") + F.col("k") % GLYPH_W).cast("int").alias("x"), "max_x")
    return out.where("x < max_x").drop("max_x")


@dataclass(frozen=True)
class SheetRow:
    label: str
    size: tuple[int, int] | None = None  # height and width of the image, if there is one
    img: str | None = None
    subtitle: str | None = None
    settings: tuple[tuple[str, str], ...] | None = None


def layout(rows: list[SheetRow], width: int) -> tuple[list[dict], int, int]:
    """Rows with their offsets (a running sum), the sheet's height and its width."""
    width, y, out = max(width, LEAST_WIDTH), GAP, []
    for row in rows:
        sub = SUBTITLE_HEIGHT if row.subtitle is not None else 0
        if row.settings is not None:
            content = len(row.settings) * LINE + 8
        else:
            h, w = row.size or (64, width)
            content = max(8, math.floor(width * h / w + 0.5)) if w > 0 else 64
        out.append({"row": row, "label_y": y, "sub_y": y + LABEL_HEIGHT, "y": y + LABEL_HEIGHT + sub, "h": content})
        y += LABEL_HEIGHT + sub + content + GAP
    return out, y, width


def contact_sheet(spark: SparkSession, images: DataFrame | None, rows: list[SheetRow], width: int) -> tuple[DataFrame, tuple[int, int]]:
    """SNK03: the sheet's pixels (y, x, r, g, b, a) and its size. images (img, y, x, r, g, b, a)
    are scaled to the sheet's width by nearest pixels; a later layer covers an earlier one."""
    placed, height, width = layout(rows, width)
    boxes, lines = [], []
    for p in placed:
        row = p["row"]
        boxes.append((1, p["label_y"], LABEL_HEIGHT, *LABEL))
        lines.append((0, row.label, p["label_y"] + 4, 6, *INK))
        if row.subtitle is not None:
            lines.append((1, row.subtitle, p["sub_y"] + 3, 6, *INK_SMALL))
        if row.settings is not None:
            boxes.append((1, p["y"], p["h"], *SETTINGS))
            lines += [(1, f"{k}: {v}", p["y"] + 4 + i * LINE, 8, *INK_SMALL) for i, (k, v) in enumerate(row.settings)]
        elif row.img is None:
            boxes.append((1, p["y"], p["h"], *PLACEHOLDER))
            lines.append((1, "(not available)", p["y"] + max(0, p["h"] // 2 - 6), 8, *INK_SMALL))
    grid = spark.range(height).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    base = spark.createDataFrame([(0, 0, height, *BACKGROUND), *boxes], "z int, top int, h int, r int, g int, b int")
    parts = grid.join(F.broadcast(base), (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + F.col("h"))).select("y", "x", "z", "r", "g", "b")
    shown = [(p["row"].img, p["y"], p["h"], p["row"].size[0], p["row"].size[1]) for p in placed if p["row"].img is not None and p["row"].settings is None]
    if shown and images is not None:
        where = F.broadcast(spark.createDataFrame(shown, "img string, top int, h int, ih int, iw int"))
        cell = where.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("oy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("ox"))
        at = cell.select("img", (F.col("top") + F.col("oy")).alias("ty"), F.col("ox").alias("tx"), F.floor((F.col("oy") + 0.5) * F.col("ih") / F.col("h")).cast("int").alias("y"), F.floor((F.col("ox") + 0.5) * F.col("iw") / width).cast("int").alias("x"))
        parts = parts.unionByName(at.join(images, ["img", "y", "x"]).select(F.col("ty").alias("y"), F.col("tx").alias("x"), F.lit(2).alias("z"), "r", "g", "b"))
    glyphs = glyph_frame(spark)
    for small, most in ((0, 64), (1, 96)):
        own = [(i, t, y, x, width, r, g, b) for i, (s, t, y, x, r, g, b) in enumerate(lines) if s == small]
        if own:
            frame = spark.createDataFrame(own, "line int, text string, y0 int, x0 int, max_x int, r int, g int, b int")
            parts = parts.unionByName(draw(frame, glyphs, most).where(F.col("y") < height).join(frame.select("line", "r", "g", "b"), "line").select("y", "x", F.lit(3).alias("z"), "r", "g", "b"))
    top = parts.groupBy("y", "x").agg(F.max(F.struct("z", "r", "g", "b")).alias("p"))
    return top.select("y", "x", "p.r", "p.g", "p.b", F.lit(255).alias("a")), (height, width)
